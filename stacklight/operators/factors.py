"""Implicit-feedback matrix factors by alternating least squares with plain regularisation and a start that depends on the ids alone.

With weights c and all preferences 1 where there is an interaction, 0 elsewhere, one side's vector is
    x = (G + sum (c - 1) y y' + lambda I)^-1 sum c y,   G = sum y y' over all of the other side,
the sums running over its own interactions. G is a matrix of the rank's size. The rows of a side come together by their number; of a
vertex with over PART_ROWS interactions the rows are dealt to parts, whose sums are added up, so that nobody's heavy use is one
task's. Every half round is written to the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import checkpoint

PART_ROWS = 4096
#: Doubles of sums that a task holds before it solves them.
HELD_SUMS = 1_000_000


def start_vectors(ids: DataFrame, rank: int, seed: int) -> DataFrame:
    """ids (id) with a vector of numbers in (0, 1) / rank, from the md5 of seed, id and place."""
    digest = lambda d: F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), d.cast("string")).cast("binary")), F.lit(8))
    value = lambda d: (F.conv(digest(d), 16, 10).cast("double") + 0.5) / float(rank << 32)
    return ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), value).alias("vector"))


def _matrix(column: pa.Array, rank: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, rank)


def gram(vectors: DataFrame, rank: int) -> np.ndarray:
    """The sum of y y' over the vectors (vector): added up in the tasks, then by a few, so that few matrices come to the driver."""

    def each(batches):
        total = np.zeros((rank, rank))
        for b in batches:
            y = _matrix(b.column("vector"), rank)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(batches):
        total = sum((np.frombuffer(m) for b in batches for m in b.column("m").to_pylist()), np.zeros(rank * rank))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = vectors.select("vector").mapInArrow(each, "m binary").repartition(4).mapInArrow(add, "m binary").collect()
    return sum(np.frombuffer(r["m"]) for r in parts).reshape(rank, rank)


def dealt(rows: DataFrame, own: str, other: str) -> tuple[DataFrame, bool]:
    """rows (own, other, c) as id, other, c, part, parts: in how many parts a vertex of the side `own` is summed, and in which each row;
    and whether any has several."""
    parts = rows.groupBy(own).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(other), F.col("parts")).cast("int").alias("part")
    table = checkpoint(rows.join(parts.hint("merge"), own).select(F.col(own).alias("id"), F.col(other).alias("other"), "c", part, "parts"), "ratings")
    return table, not table.where("parts > 1").isEmpty()


def solve_side(side: tuple[DataFrame, bool], vectors: DataFrame, rank: int, regularization: float) -> DataFrame:
    """id, vector of one side, written, from its dealt() rows and the other side's vectors (id, vector)."""
    rows, parted = side
    base = gram(vectors, rank) + regularization * np.eye(rank)
    # of a stack of sums; the matrices of many vertices are solved in one call
    solutions = lambda sums: np.linalg.solve(base + sums[:, :, :-1], sums[:, :, -1:])[:, :, 0]
    names = ["id", "vector", "sums"]

    def run(batches):
        now, split, sums = None, False, np.zeros((rank, rank + 1))
        ids, whole, parted = [], [], []

        def keep():
            if split:
                parted.append((now[0], sums.tobytes()))
            else:
                ids.append(now[0])
                whole.append(sums.copy())

        def held():
            if ids:
                x = pa.array(solutions(np.stack(whole)).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, rank), pa.int32()), x)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.nulls(len(ids), pa.binary())], names=names)
            if parted:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parted], pa.int64()), pa.nulls(len(parted), pa.list_(pa.float64())), pa.array([m for _, m in parted], pa.binary())], names=names)
            ids.clear(), whole.clear(), parted.clear()

        for b in batches:
            own, part, parts, c = (b.column(n).to_numpy() for n in ("id", "part", "parts", "c"))
            y = _matrix(b.column("vector"), rank)
            less = y * (c[:, None] - 1)
            cuts = np.flatnonzero(np.diff(own, prepend=-1) | np.diff(part, prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(own)], strict=True):
                if (key := (int(own[lo]), int(part[lo]))) != now:
                    if now is not None:
                        keep()
                        if (len(ids) + len(parted)) * sums.size >= HELD_SUMS:
                            yield from held()
                    now, split = key, bool(parts[lo] > 1)
                    sums[:] = 0
                sums[:, :-1] += less[lo:hi].T @ y[lo:hi]
                sums[:, -1] += c[lo:hi] @ y[lo:hi]
        if now is not None:
            keep()
        yield from held()

    # not broadcast: what goes through the driver would grow with the vectors, in each half round
    met = rows.join(vectors.withColumnRenamed("id", "other").hint("merge"), "other").select("id", "part", "parts", "c", "vector")
    # the rows of a vertex's part come together, whichever task had its other side
    first = checkpoint(met.repartition("id", "part").sortWithinPartitions("id", "part").mapInArrow(run, "id long, vector array<double>, sums binary"), "half-round")

    def add(key, pdf):
        import pandas as pd

        return pd.DataFrame({"id": [key[0]], "vector": [solutions(sum(np.frombuffer(s) for s in pdf["sums"]).reshape(1, rank, rank + 1))[0].tolist()]})

    whole = first.where("sums IS NULL").select("id", "vector")
    if not parted:
        return whole
    return checkpoint(whole.unionByName(first.where("sums IS NOT NULL").groupBy("id").applyInPandas(add, "id long, vector array<double>")), "half-round")


def alternate(rows: DataFrame, rank: int, iterations: int = 15, regularization: float = 0.1, seed: int = 1) -> DataFrame:
    """rows (patron, work: numbers; c, a double) -> id, vector of the works. The patrons' vectors are not kept."""
    rows = checkpoint(rows.select("patron", "work", "c"), "ratings")
    by_patron, by_work = dealt(rows, "patron", "work"), dealt(rows, "work", "patron")
    works = checkpoint(start_vectors(rows.select(F.col("work").alias("id")).distinct(), rank, seed), "start")
    for _ in range(iterations):
        works = solve_side(by_work, solve_side(by_patron, works, rank, regularization), rank, regularization)
    return works
