"""Measures of a catalogue's recommendations, seeded samples, and a synthetic loan plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import subject_head
from .catalog import live
from .vectors import dot


#: Works of a patron that one task pairs.
PAIR_BLOCK = 500


def shared_isbns(works: DataFrame) -> DataFrame:
    """isbn, n: the ISBNs that more than one live work holds."""
    rows = live(works).select("id", F.explode(F.array_distinct("isbns")).alias("isbn"))
    return rows.groupBy("isbn").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def agreement(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Two rankings (probe, work_id, rank) of the same probes -> one row: probes, overlap (the mean share of a's first k that b's
    first k hold) and top1 (the share of probes with the same first work)."""
    left = a.where(F.col("rank") <= k).select("probe", "work_id", F.col("rank").alias("rank_a"))
    right = b.where(F.col("rank") <= k).select("probe", "work_id", F.col("rank").alias("rank_b"))
    per = left.join(right, ["probe", "work_id"], "left").groupBy("probe").agg(F.avg(F.col("rank_b").isNotNull().cast("double")).alias("share"), F.max(((F.col("rank_a") == 1) & F.col("rank_b").eqNullSafe(F.lit(1))).cast("double")).alias("first"))
    return per.agg(F.count(F.lit(1)).alias("probes"), F.avg("share").alias("overlap"), F.avg("first").alias("top1"))


def popular_patrons(loans: DataFrame, factors: DataFrame, limit: int = 2) -> DataFrame:
    """patron_ref, n: the patrons with the most different works that have factors; ties by patron."""
    rows = loans.join(factors.select("work_id").distinct(), "work_id", "left_semi").select("patron_ref", "work_id").distinct()
    return rows.groupBy("patron_ref").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "patron_ref").limit(limit)


def co_borrow_gap(loans: DataFrame, factors: DataFrame) -> DataFrame:
    """One row: linked_pairs, linked_mean, other_mean, gap: the mean cosine of the pairs of works that some patron borrowed both
    of, and of all other pairs; null where there are none. factors(work_id, factors) holds unit vectors, a row for each work.

    The other pairs are never formed: the sum over all pairs follows from the sum of the vectors. The linked ones are what is asked
    for; a patron's works are cut into blocks of about PAIR_BLOCK, and each pair of blocks is a key of its own, so that a heavy
    patron is spread over tasks.
    """
    own = loans.join(factors.select("work_id"), "work_id", "left_semi").select("patron_ref", "work_id").distinct()
    heavy = own.groupBy("patron_ref").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("cut"))
    own = own.join(heavy, "patron_ref").withColumn("block", F.pmod(F.xxhash64("work_id"), F.col("cut")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("cut") - 1))
    left = own.select("patron_ref", F.col("block").alias("i"), every.alias("j"), F.col("work_id").alias("a"))
    right = own.select("patron_ref", every.alias("i"), F.col("block").alias("j"), F.col("work_id").alias("b"))
    pair = left.join(right, ["patron_ref", "i", "j"]).where("a < b").select("a", "b").distinct()
    vector = lambda k: factors.select(F.col("work_id").alias(k), F.col("factors").alias(f"v{k}"))
    linked = pair.join(vector("a"), "a").join(vector("b"), "b").agg(F.count(F.lit(1)).alias("linked_pairs"), F.coalesce(F.sum(dot(F.col("va"), F.col("vb"))), F.lit(0.0)).alias("linked"))
    x = F.col("x").cast("double")
    summed = factors.select("work_id", F.posexplode("factors").alias("d", "x")).groupBy("d").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.count(F.lit(1)).alias("n"))
    whole = summed.agg(((F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)) - F.coalesce(F.sum("q"), F.lit(0.0))) / 2).alias("every"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    others = F.col("n") * (F.col("n") - 1) / 2 - F.col("linked_pairs")
    mean = lambda total, count: F.when(count > 0, total / count)
    both = linked.crossJoin(whole)  # a row each
    both = both.select("linked_pairs", mean(F.col("linked"), F.col("linked_pairs")).alias("linked_mean"), mean(F.col("every") - F.col("linked"), others).alias("other_mean"))
    return both.withColumn("gap", F.col("linked_mean") - F.col("other_mean"))


def uniform(seed: int, purpose: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, so that retried tasks draw the same."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), *keys), F.lit(1 << 52)) / float(1 << 52)


def sample(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows of equal chance by the md5 of the seed and their keys; the same rows at any partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).cast("binary"))
    return rows.orderBy(digest, *keys).limit(n)


def loan_plan(works: DataFrame, patrons: int, first_patron: int = 0, seed: int = 1, min_topic: int = 8, active_topics: int = 60, topic_head: int = 40, global_head: int = 2000) -> DataFrame:
    """patron, work_id, renewed, returned, repeated: synthetic loans, distinct by patron and work.

    Activity is Pareto (1.3) + 6, capped at 50. Three draws of four come from one of the patron's one to three topics, by a Zipf
    law (0.6) in the topic's head; the rest from the global head (0.5). A quarter are renewed, 85 % returned, 8 % of those repeated.
    Topics are drawn evenly; only the heads, of bounded size, are ranked as a whole."""
    u = lambda purpose, *keys: uniform(seed, purpose, *map(F.col, keys))
    w = live(works).select(F.col("id").alias("work_id"), F.explode_outer("subjects").alias("subject"))
    w = w.select("work_id", subject_head(F.col("subject")).alias("topic"))
    topical = w.where("topic <> ''").distinct()
    sizes = topical.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_topic)
    chosen = sample(sizes, active_topics, seed, "topic").select("topic", (F.row_number().over(Window.orderBy("topic")) - 1).alias("list"))
    ranked = topical.join(F.broadcast(chosen), "topic").withColumn("slot", F.row_number().over(Window.partitionBy("list").orderBy(u("topic", "work_id", "topic"), "work_id")) - 1)
    heads = ranked.where(F.col("slot") < topic_head).select("list", "slot", "work_id")
    everywhere = sample(w.select("work_id").distinct(), global_head, seed, "work_id")
    everywhere = everywhere.select(F.lit(-1).alias("list"), (F.row_number().over(Window.orderBy(u("rank", "work_id"), "work_id")) - 1).alias("slot"), "work_id")
    heads = heads.unionByName(everywhere)
    lengths = heads.groupBy("list").agg(F.count(F.lit(1)).alias("length"))
    n_topics = chosen.agg(F.count(F.lit(1)).alias("n_topics"))

    p = works.sparkSession.range(first_patron, first_patron + patrons).withColumnRenamed("id", "patron")
    activity = F.least(F.floor(F.pow(1 - u("activity", "patron"), -1 / 1.3)) + 6, F.lit(50)).cast("int")
    draws = p.select("patron", F.explode(F.sequence(F.lit(1), activity)).alias("draw")).crossJoin(F.broadcast(n_topics))  # one row
    kinds = F.element_at(F.array(*map(F.lit, (1, 1, 2, 2, 3))), (F.floor(u("kinds", "patron") * 5) + 1).cast("int"))
    which = F.floor(u("which", "patron", "draw") * kinds)
    topic = F.floor(uniform(seed, "interest", F.col("patron"), which) * F.col("n_topics"))
    draws = draws.withColumn("list", F.when((F.col("n_topics") > 0) & (u("local", "patron", "draw") < 0.75), topic).otherwise(-1).cast("int"))
    # the inverse of the distribution r ** (1 - s) of a Zipf law of exponent s < 1
    power = F.when(F.col("list") < 0, 1 / 0.5).otherwise(1 / 0.4)
    draws = draws.join(F.broadcast(lengths), "list").withColumn("slot", F.floor(F.col("length") * F.pow(u("slot", "patron", "draw"), power)).cast("int"))
    pairs = draws.join(F.broadcast(heads), ["list", "slot"]).select("patron", "work_id").distinct()  # at most active_topics * topic_head + global_head rows
    back = (u("returned", "patron", "work_id") < 0.85).cast("int")
    return pairs.select("patron", "work_id", (u("renewed", "patron", "work_id") < 0.25).cast("int").alias("renewed"), back.alias("returned"), (back * (u("repeated", "patron", "work_id") < 0.08).cast("int")).alias("repeated"))
