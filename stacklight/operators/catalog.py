"""Catalogue reads: works with availability, look-up by record id, coverage and health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import biblionumber, iso_time, or_empty


def live(works: DataFrame) -> DataFrame:
    return works.where(F.col("deleted_at").isNull())


def scope(df: DataFrame, source_id: int | None = None, column: str = "source_id") -> DataFrame:
    """The rows of one source, or all."""
    return df if source_id is None else df.where(F.col(column) == source_id)


def availability(items: DataFrame) -> DataFrame:
    """work_id, copies_total, copies_available; aggregated before any join, so no fan-out."""
    return items.groupBy("work_id").agg(F.count(F.lit(1)).alias("copies_total"), F.count_if(F.col("due_date").isNull()).alias("copies_available"))


def work_summary(works: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Live works with their source and availability, null texts as '' and null arrays as empty. An unknown last_had_items counts as
    true. A score that the works carry stays."""
    zero = F.lit(0).cast("long")
    src = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "last_had_items")
    out = live(works).join(availability(items).withColumnRenamed("work_id", "id"), "id", "left").join(src, "source_id")
    total = F.coalesce("copies_total", zero)
    lists = [or_empty(F.col(c), trimmed=c == "languages").alias(c) for c in ("authors", "languages", "subjects", "isbns")]
    score = [F.col("score")] if "score" in works.columns else []
    return out.select("id", "source_id", "source_name", "source_record_id", biblionumber(F.col("source_record_id")).alias("biblionumber"), "title", F.coalesce("publisher", F.lit("")).alias("publisher"), "publication_year", *lists, total.alias("copies_total"), F.coalesce("copies_available", zero).alias("copies_available"), (F.coalesce("last_had_items", F.lit(True)) | (total > 0)).alias("has_holdings"), *score)


def work(works: DataFrame, items: DataFrame, sources: DataFrame, id_: int) -> DataFrame:
    """The summary of one work; no row if it is unknown or deleted."""
    return work_summary(works.where(F.col("id") == id_), items, sources)


def payload_of(summary: DataFrame, *extras) -> DataFrame:
    """id and payload, a struct of what the interface returns: availability is null where no holdings are known, score (rounded to
    four places) where there is none. extras: further columns of the payload."""
    stock = F.when(F.col("has_holdings"), F.struct(F.col("copies_total").alias("total"), F.col("copies_available").alias("available"), (F.col("copies_available") > 0).alias("is_available")))
    score = [F.round("score", 4).alias("score")] if "score" in summary.columns else []
    return summary.select("id", F.struct("id", "source_record_id", "biblionumber", "title", "authors", "publisher", "publication_year", "languages", "subjects", "isbns", F.struct(F.col("source_id").alias("id"), F.col("source_name").alias("name")).alias("source"), stock.alias("availability"), *score, *extras).alias("payload"))


def payload(summary: DataFrame) -> DataFrame:
    """id and the payload as a JSON string; to_json leaves out what is null."""
    return payload_of(summary).select("id", F.to_json("payload").alias("payload"))


def similar_payload(ranked: DataFrame, summary: DataFrame) -> DataFrame:
    """ranked (probe, work_id, rank, score, content_score, collaborative_score, signal) -> a row for each probe: results, an array
    of payloads in order, hybrid_count, collaborative_applied. Results that are not in the summary are left out."""
    extras = [F.col("signal"), F.round("content_score", 4).alias("content_score"), F.round("collaborative_score", 4).alias("collaborative_score")]
    with_work = ranked.withColumnRenamed("work_id", "id").join(summary.drop("score"), "id")
    moved = (F.col("score") != F.col("content_score")).alias("moved")
    rows = payload_of(with_work, *extras, F.col("probe"), F.col("rank"), moved).select("payload")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("payload.rank").alias("rank"), F.col("payload").dropFields("probe", "rank", "moved").alias("p"))))
    applied = F.bool_or("payload.moved")
    return rows.groupBy(F.col("payload.probe").alias("probe")).agg(F.transform(ordered, lambda x: x["p"]).alias("results"), F.count_if(F.col("payload.signal") == "hybrid").alias("hybrid_count"), applied.alias("collaborative_applied"))


def by_record_id(works: DataFrame, wanted: DataFrame, source_id: int | None = None) -> DataFrame:
    """wanted (query) -> query, id: the exact record id, or for digits the only record that ends in them, of one source or of all.
    Both are equi-joins."""
    rows = scope(live(works), source_id).select("id", "source_record_id")
    exact = wanted.join(rows, F.col("query") == F.col("source_record_id")).select("query", "id")
    digits = wanted.where(F.col("query").rlike("^[0-9]+$")).join(exact.select("query"), "query", "left_anti")
    numbered = rows.where(F.contains("source_record_id", F.lit(":"))).select("id", biblionumber(F.col("source_record_id")).alias("query"))
    single = digits.join(numbered, "query").groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").select("query", "id")
    return exact.union(single)


def source_breakdown(sources: DataFrame, works: DataFrame, embeddings: DataFrame, factors: DataFrame) -> DataFrame:
    """Per source: live works, embedded works, factorised works. Flags are joined per work, then counted once."""
    flag = lambda df, name: df.select(F.col("work_id").alias("id"), F.lit(1).alias(name)).distinct()
    per = live(works).join(flag(embeddings, "embedded"), "id", "left").join(flag(factors, "factorised"), "id", "left")
    per = per.groupBy("source_id").agg(F.count(F.lit(1)).alias("works"), F.count("embedded").alias("embedded"), F.count("factorised").alias("factorised"))
    zero = F.lit(0).cast("long")
    out = sources.select("id", "name").join(per.withColumnRenamed("source_id", "id"), "id", "left")
    return out.select("id", "name", *[F.coalesce(c, zero).alias(c) for c in ("works", "embedded", "factorised")])


def health(works: DataFrame, items: DataFrame, embeddings: DataFrame, factors: DataFrame, sources: DataFrame) -> DataFrame:
    """One row of counts and of times (ISO 8601), with the status, which is ok if the row comes at all. unembedded = works - embeddings, so vectors of deleted works count against it."""
    n = lambda df, name, *more: df.agg(F.count(F.lit(1)).alias(name), *more)
    last = sources.agg(iso_time(F.max("last_harvest")).alias("last_harvest"))
    out = n(live(works), "works").crossJoin(n(items, "items")).crossJoin(n(embeddings, "embeddings")).crossJoin(n(factors, "factors", iso_time(F.max("trained_at")).alias("trained_at"))).crossJoin(last)  # a row each
    return out.withColumns({"unembedded": F.col("works") - F.col("embeddings"), "status": F.lit("ok")})


def duplicate_titles(works: DataFrame) -> DataFrame:
    return live(works).groupBy(F.lower("title").alias("title_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def topic_counts(works: DataFrame, least: int = 8, most: int = 400, pattern: str = ".*") -> DataFrame:
    """Subjects of middling frequency, of 4 to 40 characters, that match the pattern."""
    rows = live(works).select(F.explode("subjects").alias("topic")).where(F.length("topic").between(4, 40) & F.col("topic").rlike(pattern))
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most))


def stale_works(works: DataFrame, embeddings: DataFrame, model: str, version: int, source_id: int | None = None) -> DataFrame:
    """What is encoded of live works whose vector is missing, of another content, model or version."""
    e = embeddings.select(F.col("work_id").alias("id"), "source_hash", "model", "embedder_version")
    old = F.col("source_hash").isNull() | ~F.col("source_hash").eqNullSafe(F.col("content_hash")) | ~F.col("model").eqNullSafe(F.lit(model)) | ~F.col("embedder_version").eqNullSafe(F.lit(version))
    return scope(live(works), source_id).join(e, "id", "left").where(old).select("id", "title", "title_alternate", "subjects", "summary", "contents", "content_hash")


def embedding_backlog(works: DataFrame, embeddings: DataFrame, model: str, version: int, source_id: int | None = None) -> DataFrame:
    """One row: pending, total: how many of the live works await encoding."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(stale_works(works, embeddings, model, version, source_id), "pending").crossJoin(n(scope(live(works), source_id), "total"))  # a row each


def freshness(df: DataFrame, at: str) -> DataFrame:
    """One row: n, newest: what tells a cache of df that it is stale."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("newest"))


def rescue_rate(runs: DataFrame) -> DataFrame:
    """runs (kind, exact_hits, rescued_hits) -> per kind: queries, zero results, rescued, rate in percent."""
    zero = F.col("exact_hits") == 0
    out = runs.groupBy("kind").agg(F.count(F.lit(1)).alias("queries"), F.count_if(zero).alias("zero_results"), F.count_if(zero & (F.col("rescued_hits") > 0)).alias("rescued"))
    return out.withColumn("rate", F.round(F.when(F.col("zero_results") > 0, 100.0 * F.col("rescued") / F.col("zero_results")), 4))


def already_shown(results: DataFrame, shown: DataFrame) -> DataFrame:
    return results.join(shown, "work_id", "left_anti")
