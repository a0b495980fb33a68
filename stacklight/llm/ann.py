"""Approximate nearest neighbours by multi-index hashing.

Codes: the sample's principal rotation, refined so that signs lose least (iterative quantisation), gives a bit for each rotated
dimension. A code is cut into m substrings, and each substring is indexed (its values, each with its codes). Two codes within
radius r differ by at most t_i bits in some substring i where the t_i add up to r - m + 1, so probing all values that near, then
testing the whole codes, retrieves every code within r. Few near values are enumerated by their differences; where they are more
than the block has, its values are tested instead. The candidates' distances are then computed on the original vectors.

The index is cut into blocks of at most `block_rows` vectors, the queries likewise, and both are dealt to a grid of groups: an index
block goes to the cells of its row, a query block to those of its column, so each pair meets in one cell and nothing is broadcast.
With T cells, q queries and n vectors, sqrt(T q / n) columns keep the copies of both sides level. A cell holds its column's
queries (`query_rows` in the mean at most) and streams index blocks, which give at most k rows a query each; so no bucket, however
hot, is ever gathered, and copies of one vector cost their number once. The radius is the one that holds `target` of the true
neighbours of sampled vectors within the sample (bounded by sample_rows); a query with fewer than k codes within it takes the
nearest codes left, by a radius that grows until k are found.

What the radius prunes depends on the vectors: where the nearest are hardly nearer than the rest, near codes are not rare and the
probes visit most of them; share() measures it.

Cases: vectors that are null, zero or hold null or non-finite components take no part; vectors of another length than the
query's are no candidates; rows with the query's id are its own and no candidates; an id that queries twice queries with its
least vector; equal vectors tie by id; repeated rows are candidates each; null ids take no part; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE_ROWS, BLOCK_ROWS, QUERY_ROWS, SUBSTRING_BITS = 4096, 16_384, 32_768, 16
#: Pairs of a query and a vector for one task.
CELL_PAIRS = 2_000_000_000
_differences = np.argsort(np.bitwise_count(np.arange(1 << SUBSTRING_BITS, dtype=np.uint32)), kind="stable").astype(np.uint16)
_near = np.cumsum([math.comb(SUBSTRING_BITS, i) for i in range(SUBSTRING_BITS + 1)])


class Codes:
    """A learned rotation to bits, the cut into substrings, and the search radius."""

    def __init__(self, sample: np.ndarray, k: int, target: float, seed: int = 3, rounds: int = 30):
        self.mean = sample.mean(0)
        x, dim = sample - self.mean, sample.shape[1]
        axes = np.linalg.svd(x, full_matrices=False)[2] if len(x) >= dim else np.eye(dim)
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]
        v = x @ axes.T
        for _ in range(rounds):
            a, _, b = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (a @ b).T
        self.rotation = axes.T @ r
        self.parts = max(1, math.ceil(dim / SUBSTRING_BITS))
        codes, probe = self.encode(sample), sample[: min(len(sample), 256)]
        d = ((probe**2).sum(1)[:, None] - 2 * probe @ sample.T + (sample**2).sum(1)).argsort(1, kind="stable")[:, 1 : k + 1]
        far = np.array([self.hamming(codes[i], codes[d[i]]) for i in range(len(probe))])
        self.radius = int(np.quantile(far, target)) if far.size else dim

    def encode(self, x: np.ndarray) -> np.ndarray:
        """uint16 substrings, a column for each."""
        bits = (x - self.mean) @ self.rotation > 0
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % SUBSTRING_BITS)))
        return np.packbits(bits, axis=1).view(np.uint16)

    @staticmethod
    def hamming(q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return np.bitwise_count(codes ^ q).sum(1, dtype=np.int64)


class Block:
    """The substring indexes of a block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for s in codes.T:
            order = np.argsort(s, kind="stable")
            values, first, count = np.unique(s[order], return_index=True, return_counts=True)
            self.tables.append((values, first, count, order))

    def probed(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Every row that some substring's probes visit."""
        m, hit = self.codes.shape[1], np.zeros(len(self.codes), bool)
        for i, ((values, first, count, order), part) in enumerate(zip(self.tables, q, strict=True)):
            near = min((radius + 1 + i) // m - 1, SUBSTRING_BITS)  # these add up to radius - m + 1
            if near < 0:
                continue
            if _near[near] < len(values):
                wanted = _differences[: _near[near]] ^ part
                at = np.searchsorted(values, wanted)
                at = at[values[np.minimum(at, len(values) - 1)] == wanted]
            else:
                at = np.flatnonzero(np.bitwise_count(values ^ part) <= near)
            n = count[at]
            hit[order[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        return np.flatnonzero(hit)

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code lies within the radius."""
        rows = self.probed(q, radius)
        return rows[Codes.hamming(q, self.codes[rows]) <= radius]


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    e = F.col(vector).cast("array<double>")
    # null components make `forall` null, which filters too
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), e.alias("v")).where(F.col("id").isNotNull() & fine)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(dim, ids, vectors): rows of one dimension, packed, at most `size` in a row."""

    def run(batches):
        held: dict[int, list] = {}

        def emit(dim):
            x = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int64()), pa.array([np.array([i for i, _ in x], np.int64).tobytes()], pa.binary()), pa.array([np.array([v for _, v in x], np.float64).tobytes()], pa.binary())], names=["dim", "ids", "vectors"])

        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= size:
                    yield emit(len(v))
        for dim in list(held):
            yield emit(dim)

    return rows.select("id", "v").mapInArrow(run, "dim long, ids binary, vectors binary")


def fit(rows: DataFrame, k: int, target: float, sample_rows: int) -> dict[int, Codes]:
    """The codes of each dimension, from a bounded sample of usable vectors."""
    by_dim: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(sample_rows).collect():
        by_dim.setdefault(len(r.v), []).append(r.v)
    return {dim: Codes(np.array(x), k, target) for dim, x in by_dim.items()}


def share(vectors: np.ndarray, queries: np.ndarray, model: Codes) -> tuple[float, float]:
    """The mean shares of the vectors that probing visits, and that lie within the radius."""
    block = Block(model.encode(vectors))
    codes = model.encode(queries)
    return np.mean([len(block.probed(q, model.radius)) for q in codes]) / len(vectors), np.mean([len(block.within(q, model.radius)) for q in codes]) / len(vectors)


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", target: float = 0.95, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query (a function of the id column) holds, the k nearest found."""
    rows = usable(vectors, id_col, vector)
    models = fit(rows, k, target, sample_rows)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query(F.col("id"))).alias("q")).first()
    at_least = rows.sparkSession.sparkContext.defaultParallelism
    cells = max(4 * at_least, math.ceil(size.n * size.q / cell_pairs))
    columns = max(1, round(math.sqrt(cells * size.q / max(1, size.n))), math.ceil(size.q / query_rows))
    lines = math.ceil(cells / columns)
    # blocks small enough to occupy every core, dealt by what they hold
    block_rows = min(block_rows, max(1024, math.ceil(size.n / (4 * at_least))))
    packed = lambda df, size, n, side: materialize(blocks(df, size).select("dim", "ids", "vectors", F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int").alias("group"), F.lit(side).alias("side")), "ann-blocks")
    index = packed(rows, block_rows, lines, 1)
    queries = packed(rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")), query_rows, columns, 0)

    def search(batches):
        cell, asked, held = None, [], []
        for b in batches:
            for now, side, dim, ids, vecs in zip(*(b.column(c).to_pylist() for c in ("cell", "side", "dim", "ids", "vectors")), strict=True):
                if now != cell:
                    cell, asked = now, []
                ids, x = np.frombuffer(ids, np.int64), np.frombuffer(vecs, np.float64).reshape(-1, dim)
                if side == 0:
                    asked.append((dim, ids, x))
                    continue
                model = models.get(dim)
                held = Block(model.encode(x)) if model else None
                for _, q_ids, q in (a for a in asked if a[0] == dim):
                    yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(_best(model, held, ids, x, q_ids, q, k), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    spread = lambda df, cell, n: df.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell)).alias("cell"), "side", "dim", "ids", "vectors")
    both = spread(index, lambda c: F.col("group") * columns + c, columns).union(spread(queries, lambda r: r * columns + F.col("group"), lines))
    found = both.repartition(cells, "cell").sortWithinPartitions("cell", "side").mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(model: Codes | None, held: Block | None, ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k nearest found of one block for each query: query ids, vector ids, distances."""
    out: tuple[list, list, list] = ([], [], [])
    codes = model.encode(q) if model else None
    for i, own in enumerate(q_ids.tolist()):
        radius = model.radius if model else 0
        rows = held.within(codes[i], radius) if model else np.arange(len(ids))
        rows = rows[ids[rows] != own]
        want = min(k, int((ids != own).sum()))
        while len(rows) < want:  # too few codes in the radius: widen it
            radius += 4
            rows = held.within(codes[i], radius)
            rows = rows[ids[rows] != own]
        d = np.sqrt(((x[rows] - q[i]) ** 2).sum(1))
        if len(d) > k:
            few = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
            rows, d = rows[few], d[few]
        best = np.lexsort((ids[rows], d))[:k]
        out[0].extend([own] * len(best))
        out[1].extend(ids[rows[best]].tolist())
        out[2].extend(d[best].tolist())
    return out
