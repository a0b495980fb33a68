"""Loans to interactions, confidence, k-core, matrix statistics, and the factor models."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import scope
from .state import checkpoint, task_count

FACTORISER_VERSION = 1
#: Doubles that a task of fold_in() holds before it passes its sums on.
PARTIAL_SUMS = 4_000_000


def interactions(loans: DataFrame) -> DataFrame:
    """patron_ref, work_id, n_loans, n_renewals; loans without a work are left out."""
    return loans.where(F.col("work_id").isNotNull()).groupBy("patron_ref", "work_id").agg(F.count(F.lit(1)).alias("n_loans"), F.coalesce(F.sum("renewals"), F.lit(0)).cast("long").alias("n_renewals"))


def of_patron(loans: DataFrame, patron_ref: str, source_id: int | None = None) -> DataFrame:
    """The interactions of one patron."""
    return interactions(scope(loans, source_id).where(F.col("patron_ref") == patron_ref))


def confidence(n_loans: Column, n_renewals: Column, base=1.0, loan=1.0, renewal=2.0, repeat=4.0, ceiling=40.0) -> Column:
    value = F.lit(base) + loan * n_loans + renewal * n_renewals + repeat * F.greatest(n_loans - 1, F.lit(0))
    return F.least(F.greatest(value, F.lit(1.0)), F.lit(ceiling))


def k_core(rows: DataFrame, min_works: int = 2, min_patrons: int = 2, rounds: int = 5) -> DataFrame:
    """Interactions of patrons with min_works works and works with min_patrons patrons: rarely borrowed works go, then patrons,
    at most `rounds` times. Counts are combined before the shuffle, so a work that everybody borrows is one row."""
    rows = checkpoint(rows)
    for _ in range(rounds):
        works = rows.groupBy("work_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_patrons).select("work_id")
        rows = rows.join(works.hint("merge"), "work_id", "left_semi")
        patrons = rows.groupBy("patron_ref").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_works).select("patron_ref")
        before, rows = rows, checkpoint(rows.join(patrons.hint("merge"), "patron_ref", "left_semi"))
        if rows.count() == before.count():  # settled: further rounds would drop nothing
            break
    return rows


def training_stats(rows: DataFrame) -> DataFrame:
    n = rows.agg(F.count(F.lit(1)).alias("n_interactions"), F.count_distinct("patron_ref").alias("n_patrons"), F.count_distinct("work_id").alias("n_works"))
    return n.withColumn("density", F.when(F.col("n_works") > 0, 100.0 * F.col("n_interactions") / (F.col("n_patrons") * F.col("n_works"))).otherwise(0.0))


def choose_factors(n_patrons: Column, n_works: Column, n_interactions: Column, least: int = 16, most: int = 128) -> Column:
    per = 4 * (n_patrons + n_works)
    return F.greatest(F.lit(least), F.least(F.lit(most), F.when(per > 0, F.floor(n_interactions / per)).otherwise(0))).cast("int")


def index(rows: DataFrame, column: str) -> DataFrame:
    """A gapless number from 0 for each value, in its order: range partitions, then their starts (no single-task sort)."""
    values = rows.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    # written once: both reads below see the same partitions
    numbered = checkpoint(values.select(column, F.spark_partition_id().alias("part")))
    numbered = numbered.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1)
    starts = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    return numbered.join(starts, "part").select(column, (F.col("start") + F.col("i")).cast("long").alias(f"{column}_idx"))


def patrons_per_work(rows: DataFrame) -> DataFrame:
    return rows.groupBy("work_id").agg(F.count(F.lit(1)).alias("n_patrons"))


def fit_als(rows: DataFrame, rank: int, iterations: int = 15, regularization: float = 0.1, seed: int = 1) -> DataFrame:
    """work_id, vector (unit length), n_patrons from implicit-feedback least squares (see factors). User factors are discarded:
    nobody's reading is kept."""
    from .factors import alternate
    from .vectors import normalize

    # merged, here and in k_core(): a broadcast would send through the driver what grows with patrons and works
    p, w = checkpoint(index(rows, "patron_ref")), checkpoint(index(rows, "work_id"))
    weights = confidence(F.col("n_loans"), F.col("n_renewals")).cast("double")
    data = rows.join(p.hint("merge"), "patron_ref").join(w.hint("merge"), "work_id").select(F.col("patron_ref_idx").alias("patron"), F.col("work_id_idx").alias("work"), weights.alias("c"))
    fitted = alternate(data, rank, iterations, regularization, seed)
    items = fitted.select(F.col("id").alias("work_id_idx"), normalize(F.col("vector")).cast("array<float>").alias("vector"))
    return items.join(w.hint("merge"), "work_id_idx").join(patrons_per_work(rows).hint("merge"), "work_id").select("work_id", "vector", "n_patrons")


def factorise(loans: DataFrame, source_id: int | None = None, min_works: int = 2, min_patrons: int = 2, factors: int | None = None, iterations: int = 15, regularization: float = 0.1, seed: int = 1) -> DataFrame:
    """The whole refit: loans -> work_id, vector, dimensions, factoriser_version, n_patrons. The result replaces all stored factors,
    of other sources too: vectors of two fits are not comparable. Raises without interactions."""
    rows = k_core(interactions(scope(loans, source_id)), min_works, min_patrons)
    size = training_stats(rows).first()  # a row
    if not size["n_interactions"]:
        raise ValueError("no circulation history to learn from")
    if factors is None:
        chosen = rows.sparkSession.range(1).select(choose_factors(*[F.lit(size[c]) for c in ("n_patrons", "n_works", "n_interactions")]).alias("k"))
        factors = chosen.first()["k"]
    fitted = fit_als(rows, factors, iterations, regularization, seed)
    return fitted.select("work_id", "vector", F.size("vector").alias("dimensions"), F.lit(FACTORISER_VERSION).alias("factoriser_version"), "n_patrons")


def _pieces(batch: pa.RecordBatch):
    """Slices of a batch of sums that hold about PARTIAL_SUMS doubles at most."""
    if batch.num_rows:
        step = max(1, PARTIAL_SUMS * 8 // max(1, len(batch.column("sums")[0].as_py())))
        yield from (batch.slice(lo, step) for lo in range(0, batch.num_rows, step))


def fold_in(rows: DataFrame, factors: DataFrame, regularization: float = 0.1, min_works: int = 3) -> DataFrame:
    """patron_ref, vector (null under min_works usable works), n_works, n_loans: a patron's vector from their loans alone.

    The normal equations are sums over works, so each partition adds up its part of a patron first, and a heavy patron is a row of
    each partition in the shuffle."""
    known = rows.join(factors.select("work_id", "vector"), "work_id").select("patron_ref", F.col("vector").cast("array<double>").alias("vector"), "n_loans", confidence(F.col("n_loans"), F.col("n_renewals")).alias("confidence"))

    def add(batches):
        held: dict[str, list] = {}

        def emit():
            out = [(p, np.concatenate([a.ravel(), b]).tobytes(), n, loans) for p, (a, b, n, loans) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64(), pa.int64()))], names=["patron_ref", "sums", "n_works", "n_loans"])

        for batch in batches:
            who = batch.column("patron_ref").dictionary_encode()
            names, number = who.dictionary.to_pylist(), who.indices.to_numpy()
            order = np.argsort(number, kind="stable")
            vectors = batch.column("vector")
            y = vectors.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[order]
            c, loans = (batch.column(n).to_numpy()[order] for n in ("confidence", "n_loans"))
            starts = np.flatnonzero(np.diff(number[order], prepend=-1))
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                weighted = y[lo:hi] * c[lo:hi, None]
                k = y.shape[1]
                old = held.setdefault(names[number[order[lo]]], [np.zeros((k, k)), np.zeros(k), 0, 0])
                old[0] += weighted.T @ y[lo:hi]
                old[1] += weighted.sum(0)
                old[2] += int(hi - lo)
                old[3] += int(loans[lo:hi].sum())
                if len(held) * k * (k + 1) > PARTIAL_SUMS:
                    yield emit()
        if held:
            yield emit()

    def solve(batches):
        held = None  # the patron met last, of whom more rows may come

        def solved(names, sums, n, loans):
            k, some = (math.isqrt(4 * sums.shape[1] + 1) - 1) // 2, n >= min_works
            vectors = np.zeros((len(n), k))
            vectors[some] = np.linalg.solve(sums[some, : k * k].reshape(-1, k, k) + regularization * np.eye(k), sums[some, k * k :, None])[:, :, 0]
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            flat = pa.array((vectors / np.where(norm > 0, norm, 1)).astype(np.float32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * k, pa.int32()), flat, mask=pa.array(~some))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), lists, pa.array(n), pa.array(loans)], names=["patron_ref", "vector", "n_works", "n_loans"])

        for batch in (part for whole in batches for part in _pieces(whole)):
            names = batch.column("patron_ref").to_pylist()
            rows = [np.frombuffer(b"".join(batch.column("sums").to_pylist())).reshape(len(names), -1), *(batch.column(c).to_numpy() for c in ("n_works", "n_loans"))]
            if held:
                names, rows = held[0] + names, [np.concatenate(x) for x in zip(held[1], rows, strict=True)]
            starts = [i for i, p in enumerate(names) if not i or p != names[i - 1]]
            names, rows = [names[i] for i in starts], [np.add.reduceat(x, starts) for x in rows]
            held = names[-1:], [x[-1:] for x in rows]
            if len(names) > 1:
                yield solved(names[:-1], *(x[:-1] for x in rows))
        if held:
            yield solved(held[0], *held[1])

    parts = known.mapInArrow(add, "patron_ref string, sums binary, n_works long, n_loans long")
    # a patron's rows follow one another; many patrons are solved at once, since a call for each costs far more than their sums
    dealt = parts.repartition(task_count(rows.sparkSession), "patron_ref").sortWithinPartitions("patron_ref")
    return dealt.mapInArrow(solve, "patron_ref string, vector array<float>, n_works long, n_loans long")


def folded_ranking(patrons: DataFrame, factors: DataFrame, rows: DataFrame, limit: int = 10) -> DataFrame:
    """Works by the patron's vector, without those borrowed already. patrons: the stated probes."""
    from .vectors import nearest

    some = checkpoint(patrons.where(F.col("vector").isNotNull()).select("patron_ref", F.xxhash64("patron_ref").alias("probe"), F.col("vector").alias("probe_vector"), F.lit(0).alias("probe_source")))
    # a patron's own works are masked, so they come with the probe; of patrons that are asked for only
    seen = rows.join(some.select("patron_ref", "probe"), "patron_ref").groupBy("probe").agg(F.collect_set(F.col("work_id").cast("long")).alias("shown"))
    found = nearest(some.join(seen, "probe", "left"), factors.select("work_id", "vector", F.lit(0).alias("source_id")), limit)
    return found.join(some.select("probe", "patron_ref"), "probe").select("patron_ref", "work_id", "score", "rank")
