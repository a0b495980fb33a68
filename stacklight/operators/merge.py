"""Upserts as pure functions merge(target, batch) -> new state, each key judged by its own rows; buckets.BucketTable applies them to
a stored table, to the buckets of a batch's keys alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import live

MAPPER_VERSION, EMBEDDER_VERSION = 4, 2


def latest(batch: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in the order, which should be unique."""
    return batch.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("place = 1").drop("place")


def merge_works(target: DataFrame, batch: DataFrame) -> DataFrame:
    """target and batch (source_id, source_record_id, title, content_hash, items_hash, deleted) -> the merged rows, with action
    (inserted, updated, unchanged, deleted, ignored, kept) and items_changed. The content hash gates: equal content keeps the
    stored row but clears its deletion and takes the items hash; a deletion marks the row."""
    keys = ["source_id", "source_record_id"]
    old = target.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("title", "content_hash", "items_hash", "deleted")], F.lit(True).alias("stored"))
    new = batch.select(*keys, "title", "content_hash", "items_hash", "deleted", F.lit(True).alias("arrived"))
    both = old.join(new, keys, "full")
    gone, same = F.coalesce("deleted", F.lit(False)), F.col("old_content_hash").eqNullSafe(F.col("content_hash"))
    stored, arrived = F.col("stored").isNotNull(), F.col("arrived").isNotNull()
    action = F.when(~arrived, "kept").when(gone & stored, "deleted").when(gone, "ignored").when(~stored, "inserted").when(same, "unchanged").otherwise("updated")
    fresh = F.col("action").isin("inserted", "updated")
    take = lambda c: F.when(fresh, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
    out = both.withColumn("action", action)
    items_hash = F.when(F.col("action").isin("inserted", "updated", "unchanged"), F.col("items_hash")).otherwise(F.col("old_items_hash"))
    changed = fresh | ((F.col("action") == "unchanged") & ~F.col("old_items_hash").eqNullSafe(F.col("items_hash")))
    deleted = F.when(F.col("action") == "deleted", True).when(F.col("action") == "kept", F.col("old_deleted")).otherwise(False)
    return out.where("action <> 'ignored'").select(*keys, take("title"), take("content_hash"), items_hash.alias("items_hash"), deleted.alias("deleted"), "action", changed.alias("items_changed"))


def replace_items(items: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Items of the changed works (work_id) replaced by the fresh ones."""
    return items.join(changed.select("work_id").distinct(), "work_id", "left_anti").unionByName(fresh.join(changed.select("work_id").distinct(), "work_id", "left_semi"))


def merge_loans(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Keyed by (source_id, source_loan_id): work, patron and start stay as first seen; return and renewals are renewed."""
    keys, first, last = ["source_id", "source_loan_id"], ["work_id", "patron_ref", "checked_out_at"], ["checked_in_at", "renewals"]
    old = target.select(*keys, *[F.col(c).alias(f"old_{c}") for c in first + last], F.lit(True).alias("stored"))
    both = old.join(batch.select(*keys, *first, *last, F.lit(True).alias("arrived")), keys, "full")
    arrived, stored = F.col("arrived").isNotNull(), F.col("stored").isNotNull()
    keep = [F.when(stored, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in first]
    renew = [F.when(arrived, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in last]
    return both.select(*keys, *keep, *renew, F.when(~stored, "inserted").when(arrived, "updated").otherwise("kept").alias("action"))


def merge_by_key(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's row where it has the key, else the stored one (ratings, embeddings)."""
    return target.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)


def merge_by(keys: list[str]):
    """merge_by_key() with these keys, as a merge of a table in buckets."""
    return lambda target, batch: merge_by_key(target, batch, keys)


def merge_sources(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Keyed by (base_url, metadata_prefix): a null flavour and empty headers leave the stored ones."""
    keys = ["base_url", "metadata_prefix"]
    old = target.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("name", "marc_flavour", "request_headers")])
    both = old.join(batch.select(*keys, "name", "marc_flavour", "request_headers"), keys, "full")
    headers = F.when(F.size(F.coalesce("request_headers", F.create_map().cast("map<string,string>"))) > 0, F.col("request_headers")).otherwise(F.col("old_request_headers"))
    return both.select(*keys, F.coalesce("name", "old_name").alias("name"), F.coalesce("marc_flavour", "old_marc_flavour").alias("marc_flavour"), headers.alias("request_headers"))


def numbered_works(works: DataFrame) -> DataFrame:
    """source_id, biblio_id, work_id: live works by the number (digits only, read as a number) that ends their record id within their
    source; of colliding ones the first by id."""
    from ..functions.text import biblionumber

    number = biblionumber(F.col("source_record_id"))
    # as a number without its leading zeros; of any length
    rows = live(works).where(number.rlike("^[0-9]+$")).select("source_id", F.regexp_replace(number, "^0+(?=[0-9])", "").alias("biblio_id"), "id")
    return rows.groupBy("source_id", "biblio_id").agg(F.min("id").alias("work_id"))


def resolve_loans(loans: DataFrame, works: DataFrame) -> DataFrame:
    """loans (source_id, loan_id, biblio_id) -> loan_id, work_id by numbered_works(); null if unresolved."""
    return loans.join(numbered_works(works), ["source_id", "biblio_id"], "left").select("loan_id", "work_id")


def resolve_exact(loans: DataFrame, works: DataFrame) -> DataFrame:
    """loans (source_id, loan_id, biblio_id) -> loan_id, work_id of the live work whose whole record id is the biblio id, as works
    that were read from the library's database have it; null if unresolved."""
    own = live(works).select("source_id", F.col("source_record_id").alias("biblio_id"), F.col("id").alias("work_id"))
    return loans.join(own, ["source_id", "biblio_id"], "left").select("loan_id", "work_id")


def resolve_ratings(ratings: DataFrame, works: DataFrame) -> DataFrame:
    """ratings (source_id, biblio_id, ...) with the work_id of the work of the source that ends in the biblio id, deleted ones too;
    of colliding ones the last by id, null if unresolved."""
    from ..functions.text import biblionumber

    last = works.groupBy("source_id", biblionumber(F.col("source_record_id")).alias("biblio_id")).agg(F.max("id").alias("work_id"))
    return ratings.join(last, ["source_id", "biblio_id"], "left")


def store_loans(target: DataFrame, loans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged loans of merge_loans(), and one row of counts: inserted, updated, unresolved, current, historical. loans: a batch
    with work_id, null where unresolved; those are dropped."""
    known = loans.where(F.col("work_id").isNotNull())
    merged = merge_loans(target, known)
    n = loans.agg(F.count_if(F.col("work_id").isNull()).alias("unresolved"), F.count_if(F.col("work_id").isNotNull() & F.col("checked_in_at").isNull()).alias("current"), F.count_if(F.col("work_id").isNotNull() & F.col("checked_in_at").isNotNull()).alias("historical"))
    done = merged.agg(F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "updated").alias("updated"))
    return merged, done.crossJoin(n)  # a row each


def store_works(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The database path: target and batch (source_id, source_record_id, title, content_hash, items_hash) -> the merged rows with
    deleted and action (new, updated, unchanged, kept). If either hash differs, the row and its items are written anew; what is
    unchanged stays, and either way what was read is no longer deleted."""
    keys = ["source_id", "source_record_id"]
    old = target.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("title", "content_hash", "items_hash", "deleted")], F.lit(True).alias("stored"))
    both = old.join(batch.select(*keys, "title", "content_hash", "items_hash", F.lit(True).alias("arrived")), keys, "full")
    stored, arrived = F.col("stored").isNotNull(), F.col("arrived").isNotNull()
    same = F.col("old_content_hash").eqNullSafe(F.col("content_hash")) & F.col("old_items_hash").eqNullSafe(F.col("items_hash"))
    out = both.withColumn("action", F.when(~arrived, "kept").when(~stored, "new").when(same, "unchanged").otherwise("updated"))
    take = [F.when(F.col("action").isin("new", "updated"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("title", "content_hash", "items_hash")]
    return out.select(*keys, *take, F.when(F.col("action") == "kept", F.col("old_deleted")).otherwise(False).alias("deleted"), "action")


def stamp_sources(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """sources with last_harvest and last_had_items of the runs (id, finished_at, n_items) that read them."""
    rows = sources.join(runs.select("id", "finished_at", "n_items"), "id", "left")
    had = F.when(F.col("n_items").isNotNull(), F.col("n_items") > 0).otherwise(F.col("last_had_items"))
    return rows.withColumns({"last_harvest": F.coalesce("finished_at", "last_harvest"), "last_had_items": had}).select(sources.columns)


def pending_migrations(known: DataFrame, ledger: DataFrame) -> DataFrame:
    """known (version, description, ...) that the ledger (version) doesn't hold, in order."""
    return known.join(ledger.select("version"), "version", "left_anti").orderBy("version")


def apply_migrations(known: DataFrame, ledger: DataFrame, run, now) -> DataFrame:
    """Runs what is pending, one after another, and returns the ledger (version, description, applied_at) with what succeeded. known
    is a list of changes that the program holds, so it is small."""
    done = ledger
    for m in pending_migrations(known, ledger).collect():
        run(m)
        done = done.unionByName(known.where(F.col("version") == m["version"]).select("version", "description", F.lit(now).cast("timestamp").alias("applied_at")))
    return done


def union_loans(current: DataFrame, history: DataFrame) -> DataFrame:
    return current.unionByName(history)
