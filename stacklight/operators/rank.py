"""Hybrid re-ranking: content candidates re-ordered by co-borrowing evidence, with abstention."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import dot


@dataclass(frozen=True)
class Weights:
    content: float = 0.7
    collaborative: float = 0.3
    min_patrons: int = 3
    min_scored: int = 3
    pool: int = 50

    def __post_init__(self):
        if min(self.content, self.collaborative) < 0 or self.content + self.collaborative == 0:
            raise ValueError("weights are at least 0 and not both 0")
        if min(self.min_patrons, self.min_scored, self.pool) < 1:
            raise ValueError("floors are at least 1")


def rerank(candidates: DataFrame, probe_factors: DataFrame, weights: Weights = Weights(), limit: int = 10) -> DataFrame:
    """candidates (probe, work_id, content_score, factors, n_patrons), probe_factors (probe, probe_vector, probe_patrons) ->
    probe, work_id, rank, score, content_score, collaborative_score, signal.

    The pool is the best by content. Work factors count with min_patrons patrons behind both sides; with fewer than min_scored
    such candidates the content order stands; a candidate without counts takes the median of those with."""
    by = Window.partitionBy("probe")
    pool = candidates.withColumn("place", F.row_number().over(by.orderBy(F.desc("content_score"), "work_id"))).where(F.col("place") <= weights.pool)
    evidence = F.col("factors").isNotNull() & (F.col("n_patrons") >= weights.min_patrons) & F.col("probe_vector").isNotNull() & (F.col("probe_patrons") >= weights.min_patrons)
    pool = pool.join(probe_factors, "probe", "left").withColumn("own", F.when(evidence, dot(F.col("factors"), F.col("probe_vector"))))
    pool = pool.withColumn("n_scored", F.count("own").over(by)).withColumn("fallback", F.percentile("own", F.lit(0.5)).over(by))
    hybrid = F.col("n_scored") >= weights.min_scored
    blend = (weights.content * F.col("content_score") + weights.collaborative * F.coalesce("own", "fallback")) / (weights.content + weights.collaborative)
    out = pool.select("probe", "work_id", "content_score", F.when(hybrid, blend).otherwise(F.col("content_score")).alias("score"), F.when(hybrid, F.col("own")).alias("collaborative_score"), F.when(hybrid & F.col("own").isNotNull(), "hybrid").otherwise("content").alias("signal"))
    order = by.orderBy(F.desc("score"), F.desc("content_score"), "work_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def borrowed_heading(ranked: DataFrame) -> DataFrame:
    """Per probe: hybrid results, whether any score differs from content, and whether the heading may say "borrowed"."""
    return ranked.groupBy("probe").agg(F.count_if(F.col("signal") == "hybrid").alias("hybrid_count"), F.bool_or(F.col("score") != F.col("content_score")).alias("collaborative_applied"), F.bool_and(F.col("signal") == "hybrid").alias("borrowed"))
