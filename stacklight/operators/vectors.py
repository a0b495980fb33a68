"""Similarity search over unit vectors: masks before top-k, batched over any number of probes.

Vectors are packed into blocks, a matrix each, of one source and dimension, and stored; a VectorCache keeps them from read to read
until the vectors change. Blocks of rows and of probes are dealt to a grid of cells in which each pair meets once, and a pair gives
the best k of each probe from one product; no pair of vectors is a row. With T cells, q probes and n rows, sqrt(T q / n) columns
keep the copies of both sides level. Every read takes this way, few probes or many."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .catalog import freshness, live
from .state import checkpoint

#: Vectors of a block, and pairs of vectors for one task.
BLOCK_ROWS, CELL_PAIRS = 4096, 500_000_000
_PACKED = "dims int, source long, ids binary, titles binary, vectors binary, shown array<array<long>>"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(a: Column) -> Column:
    """The unit vector; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(a)


def of_live_works(vectors: DataFrame, works: DataFrame) -> DataFrame:
    """The vectors (work_id, ...) of works that are not deleted."""
    return vectors.join(live(works).select(F.col("id").alias("work_id")), "work_id")


@dataclass(frozen=True)
class Blocks:
    """Stored blocks: table (dims, source, -1 if unknown, and for each vector its id, whether only a title is known, and itself), and
    how many vectors they hold."""

    table: DataFrame
    n: int


def _pack(rows: DataFrame) -> DataFrame:
    """rows (id, source, title, v, shown) as blocks of one source and dimension."""

    def run(batches):
        held: dict[tuple[int, int], list] = {}

        def emit(key):
            ids, titles, vectors, shown = zip(*held.pop(key), strict=True)
            own = [x for part in shown for x in part]
            cells = [[key[0]], [key[1]], [np.concatenate(ids).tobytes()], [np.concatenate(titles).tobytes()], [np.concatenate(vectors).tobytes()], [own]]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["dims", "source", "ids", "titles", "vectors", "shown"])

        for b in batches:
            ids, source, title = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "source", "title"))
            lists, shown = b.column("v"), b.column("shown")
            flat, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(lists.offsets))
            start = np.cumsum(size) - size
            order = np.lexsort((size, source))
            cuts = np.flatnonzero(np.diff(source[order], prepend=-2) | np.diff(size[order], prepend=-1))
            for at in np.split(order, cuts[1:]):
                if not len(at):
                    continue
                key = (int(size[at[0]]), int(source[at[0]]))
                for lo in range(0, len(at), BLOCK_ROWS):
                    some = at[lo : lo + BLOCK_ROWS]
                    part = (ids[some].astype(np.int64), title[some].astype(np.uint8), flat[start[some][:, None] + np.arange(key[0])].astype(np.float64), [shown[int(i)].as_py() for i in some])
                    held.setdefault(key, []).append(part)
                    if sum(len(p[0]) for p in held[key]) >= BLOCK_ROWS:
                        yield emit(key)
        for key in list(held):
            yield emit(key)

    return rows.mapInArrow(run, _PACKED)


def blocks_of(rows: DataFrame) -> Blocks:
    """rows (work_id, vector, source_id and, on request, is_title_only and shown, an array of ids) as stored blocks; null ids and
    vectors take no part."""
    given = lambda c, kind, default: F.coalesce(F.col(c), default).cast(kind) if c in rows.columns else default.cast(kind)
    v = F.col("vector").cast("array<double>")
    full = rows.select(F.col("work_id").cast("long").alias("id"), given("source_id", "long", F.lit(-1)).alias("source"), given("is_title_only", "boolean", F.lit(False)).alias("title"), v.alias("v"), given("shown", "array<long>", F.array()).alias("shown"))
    seen = Observation()  # counted as they are packed
    full = full.where("id IS NOT NULL AND v IS NOT NULL").observe(seen, F.count(F.lit(1)).alias("n"))
    return Blocks(checkpoint(_pack(full), "vector-blocks"), seen.get.get("n") or 0)


class VectorCache:
    """Blocks by name, packed once and kept until the count or the newest time of their vectors changes."""

    def __init__(self):
        self._held: dict[str, tuple[tuple, Blocks]] = {}

    def blocks(self, name: str, rows: DataFrame, at: str) -> Blocks:
        """The blocks of rows; at: the column of the time of their last change."""
        if name in self._held and self._held[name][0] == tuple(freshness(rows, at).first()):
            return self._held[name][1]
        seen = Observation()
        blocks = blocks_of(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.max(at).alias("newest")))
        self._held[name] = ((seen.get.get("n") or 0, seen.get.get("newest")), blocks)
        return blocks


def best_of(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, shown: list, k: int) -> list[tuple[int, int, float]]:
    """(probe, place in x, score) of the k best rows of each probe but itself and those shown; ties by id."""
    scores = q @ x.T
    scores[q_ids[:, None] == ids] = -np.inf
    out = []
    for i, own in enumerate(q_ids.tolist()):
        if shown[i]:
            scores[i, np.isin(ids, shown[i])] = -np.inf
        s = scores[i]
        at = np.flatnonzero(s >= np.partition(s, -k)[-k] - 1e-9) if len(s) > k else np.arange(len(s))
        at = at[s[at] > -np.inf]
        exact = (x[at] * q[i]).sum(1)  # the same for equal vectors, wherever they lie
        for j in np.lexsort((ids[at], -exact))[:k]:
            out.append((own, int(at[j]), float(exact[j])))
    return out


def nearest(probes: DataFrame, rows: DataFrame | Blocks, k: int, same_source: bool = False, exclude_title_only: bool = False) -> DataFrame:
    """probes (probe, probe_vector, probe_source, and shown, an array of work ids, on request) x rows (work_id, vector, source_id,
    is_title_only), or their blocks -> probe, work_id, source_id, score, rank: the k best by inner product; ties by work_id.
    same_source: rows of the probe's source only. Null vectors take no part."""
    held = rows if isinstance(rows, Blocks) else blocks_of(rows)
    renamed = probes.withColumnsRenamed({"probe": "work_id", "probe_vector": "vector", "probe_source": "source_id"})
    asked = blocks_of(renamed.drop("is_title_only"))
    n, q = held.n, asked.n
    cells = max(2 * probes.sparkSession.sparkContext.defaultParallelism, math.ceil(n * q / CELL_PAIRS))
    columns = min(max(1, round(math.sqrt(cells * q / max(1, n)))), max(1, math.ceil(q / BLOCK_ROWS)))
    lines = math.ceil(cells / columns)
    grp = ["dims", "source"] if same_source else ["dims"]
    known = (lambda df: df.where("source <> -1")) if same_source else (lambda df: df)

    def spread(df, side, own, copies, cell):
        at = F.pmod(F.xxhash64("ids"), F.lit(own)).cast("int")
        dealt = known(df).select("*", F.lit(side).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
        return dealt.withColumn("cell", F.xxhash64(*grp, *cell(at, F.col("copy")))).drop("copy")

    both = spread(asked.table, 0, columns, lines, lambda at, copy: (copy, at)).union(spread(held.table, 1, lines, columns, lambda at, copy: (at, copy)))

    def search(batches):
        cell, waiting = None, []
        for b in batches:
            for now, side, source, ids, titles, v, shown in zip(*(b.column(c).to_pylist() for c in ("cell", "side", "source", "ids", "titles", "vectors", "shown")), strict=True):
                if now != cell:
                    cell, waiting = now, []
                ids = np.frombuffer(ids, np.int64)
                x = np.frombuffer(v, np.float64).reshape(len(ids), -1)
                if side == 0:
                    waiting.append((x, ids, shown))
                    continue
                if exclude_title_only:
                    keep = np.frombuffer(titles, np.uint8) == 0
                    ids, x = ids[keep], x[keep]
                for y, q_ids, hidden in waiting:
                    found = best_of(x, ids, y, q_ids, hidden, k)
                    at = np.array([f[1] for f in found], np.int64)
                    cols = (pa.array([f[0] for f in found], pa.int64()), pa.array(ids[at]), pa.array(np.full(len(at), source)), pa.array([f[2] for f in found], pa.float64()))
                    yield pa.RecordBatch.from_arrays(list(cols), names=["probe", "work_id", "source_id", "score"])

    found = both.repartition(cells, "cell").sortWithinPartitions("cell", "side").mapInArrow(search, "probe long, work_id long, source_id long, score double")
    return top_k(found, k)


def similar(probes: DataFrame, embeddings: DataFrame | Blocks, k: int, cross_source: bool = False, exclude_title_only: bool = False) -> DataFrame:
    """The k works nearest to each probe (see nearest), of its own source unless cross_source; exclusions remove before any top-k."""
    return nearest(probes, embeddings, k, not cross_source, exclude_title_only)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each probe with their rank; ties by work_id. The limit is pushed below the shuffle."""
    w = Window.partitionBy("probe").orderBy(F.desc("score"), "work_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def semantic_search(probes: DataFrame, embeddings: DataFrame | Blocks, keys: DataFrame, limit: int = 10, min_score: float = 0.55, **masks) -> DataFrame:
    """Top 4 x limit, score floor, one edition per canonical key (work_id, key), top limit."""
    best = similar(probes, embeddings, 4 * limit, **masks).where(F.col("score") >= min_score)
    first = Window.partitionBy("probe", "key").orderBy("rank")
    kept = best.join(keys, "work_id").withColumn("edition", F.row_number().over(first)).where("edition = 1").drop("edition", "rank")
    return top_k(kept, limit)


def tiers(probes: DataFrame, embeddings: DataFrame | Blocks, keys: DataFrame, limit: int = 5, floor: float = 0.55) -> DataFrame:
    """What a search page shows, for probes (probe, probe_vector, probe_source, hits, shown): the rescue tier where the catalogue
    found nothing (the best `limit` above the floor), else the related tier: a floor 0.05 higher (0.95 at most), three times as
    many asked for, those already shown left out, cut at limit. -> probe, tier, work_id, score, rank."""
    none = F.col("hits") == 0
    strict = min(round(floor + 0.05, 2), 0.95)
    kept = lambda df, n, low: semantic_search(df.drop("shown"), embeddings, keys, n, low, cross_source=True)
    rescue = kept(probes.where(none), limit, floor).select("probe", F.lit("rescue").alias("tier"), "work_id", "score", "rank")
    page = probes.where(~none).select("probe", F.explode("shown").alias("work_id"))
    related = kept(probes.where(~none), 3 * limit, strict).drop("rank").join(page, ["probe", "work_id"], "left_anti")
    return rescue.unionByName(top_k(related, limit).select("probe", F.lit("related").alias("tier"), "work_id", "score", "rank"))
