"""A change feed of works: a stateful gate by record, and a table kept current by micro-batches. An extension: the catalogue feeds
themselves are finite pulls.

The gate keeps, for each record, the hashes of what it passed on. A delivery that brings nothing new goes no further, so what is
written downstream is in proportion to what changed; the state itself is in the state store, which writes changes only. The table
is in hash buckets, of which a batch rewrites those that it touches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.buckets import BucketTable
from ..operators.merge import latest, merge_works

KEYS = ["source_id", "source_record_id"]
WORKS = "source_id int, source_record_id string, title string, content_hash string, items_hash string, deleted boolean"
#: What a state store must be for the gate.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table(spark: SparkSession, path: str, buckets: int = 256) -> BucketTable:
    return BucketTable(spark, path, KEYS, WORKS, buckets)


def merge_feed(old: DataFrame, rows: DataFrame) -> DataFrame:
    """The works after the rows (with ts) of a batch: the last delivery of each record counts."""
    return merge_works(old, latest(rows, KEYS, [F.desc("ts"), F.desc("content_hash")]).drop("ts"))


def upsert_stream(feed: DataFrame, path: str, checkpoint: str, buckets: int = 256):
    """Starts a query that merges feed (WORKS with ts) into the table at path, a version for each micro-batch. A batch that is
    delivered again writes the same version again."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        works = table(batch.sparkSession, path, buckets)
        works.apply(batch, merge_feed, batch_id)
        works.forget()  # the version before may still be read when this batch is delivered again

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class HashGate(StatefulProcessor):
    """Of each record the state (content_hash, items_hash, deleted, ts); passes on what changes it, with the action. Deliveries older
    than the state are stale, as are those that equal it."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "content_hash string, items_hash string, deleted boolean, ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        held = self.seen.get() if self.seen.exists() else None
        before = held
        arrived = pd.concat(list(rows), ignore_index=True)
        arrived = arrived.assign(_hash=arrived["content_hash"].fillna("")).sort_values(["ts", "_hash"], kind="stable")
        last = None
        for row in arrived.itertuples(index=False):
            if held is not None and row.ts < held[3]:
                continue
            plain = lambda x: None if pd.isna(x) else x
            gone, content, items = plain(row.deleted) is True, plain(row.content_hash), plain(row.items_hash)
            if gone:
                # a deletion keeps the hashes, so that the same content brings the record back unchanged
                held = (held[0], held[1], True, int(row.ts)) if held is not None else None
            else:
                held = (content, items, False, int(row.ts))
            last = row
        if held is None or last is None:
            return
        if before is None:
            # what came and went within the batch needs no row
            action = None if held[2] else "inserted"
        elif held[2]:
            action = None if before[2] else "deleted"
        elif held[0] != before[0]:
            action = "updated"
        else:
            action = "unchanged" if before[2] or held[1] != before[1] else None
        if before is None or tuple(before) != held:
            self.seen.update(held)
        if action:
            title = None if pd.isna(last.title) else last.title
            refreshed = action in ("inserted", "updated") or (action == "unchanged" and held[1] != before[1])
            yield pd.DataFrame({"source_id": [key[0]], "source_record_id": [key[1]], "title": [title], "content_hash": [held[0]], "items_hash": [held[1]], "deleted": [held[2]], "ts": [held[3]], "action": [action], "items_changed": [refreshed]})

    def close(self) -> None:
        pass


def changes(feed: DataFrame) -> DataFrame:
    """The stream of changes in the stream feed (WORKS with ts, a long): of each record in a batch at most one row, with action
    (inserted, updated, unchanged: the content is, but it is back or its items changed, deleted) and items_changed. The session's
    state store must be STORE, which is set if none is."""
    spark = feed.sparkSession
    conf = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(conf, "").rsplit(".", 1)[-1] != STORE.rsplit(".", 1)[-1]:
        spark.conf.set(conf, STORE)
    rows = feed.where("source_id IS NOT NULL AND source_record_id IS NOT NULL AND ts IS NOT NULL")
    return rows.groupBy(*KEYS).transformWithStateInPandas(HashGate(), f"{WORKS}, ts long, action string, items_changed boolean", "Append", "None")


def activity(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Windowed counts of an event stream with a watermark for late rows."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
