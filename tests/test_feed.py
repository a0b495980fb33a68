import os
import random

import pytest
from pyspark.sql import functions as F

from stacklight.operators import merge
from stacklight.operators.buckets import BucketTable
from stacklight.streaming import feed

FEED = feed.WORKS + ", ts long"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def work(i, title="t", content="h", items="i", deleted=False):
    return (1, f"r{i}", title, content, items, deleted)


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    t = feed.table(spark, f"{tmp_path}/t", buckets=8)
    assert t.read().collect() == [] and t.versions() == []
    first = spark.createDataFrame([work(i) for i in range(200)], feed.WORKS)
    assert t.apply(first, merge.merge_works) == 0 and t.counts == {"inserted": 200}
    before = files(tmp_path)
    batch = spark.createDataFrame([work(3, "new", "h2"), work(3000), (1, "r5", None, None, None, True)], feed.WORKS)
    touched = {r[0] for r in batch.select(t.bucket()).collect()}
    assert t.apply(batch, merge.merge_works) == 1 and 0 < len(touched) <= 3
    old, new = t.manifest(0), t.manifest(1)
    assert {b for b in new if new[b] != old.get(b)} == {str(b) for b in touched}
    assert all(files(tmp_path)[f] == at for f, at in before.items())
    assert rows_of(t.read()) == rows_of(merge.merge_works(first, batch).select(first.columns)) and rows_of(t.read(0)) == rows_of(first)
    assert t.counts["updated"] == 1 and t.counts["inserted"] == 1 and t.counts["deleted"] == 1 and sum(t.counts.values()) < 202
    # an empty batch is a version too; the same version again is the same
    assert t.apply(batch.limit(0), merge.merge_works) == 2 and t.manifest(2) == new
    assert t.apply(batch, merge.merge_works, 1) == 1 and t.manifest(1) == new and t.read().count() == 201
    t.forget(1)
    assert t.versions() == [2] and rows_of(t.read()) == rows_of(merge.merge_works(first, batch).select(first.columns))
    assert len(files(tmp_path)) == len(new)
    with pytest.raises(ValueError, match="8 buckets"):
        feed.table(spark, f"{tmp_path}/t", buckets=9).read()


def test_merges_of_other_tables(spark, tmp_path):
    schema = "source_id int, source_loan_id long, work_id long, patron_ref string, checked_out_at timestamp, checked_in_at timestamp, renewals int"
    t = BucketTable(spark, f"{tmp_path}/loans", ["source_id", "source_loan_id"], schema, 4)
    one = spark.createDataFrame([(1, i, i, "p", None, None, 0) for i in range(20)], schema)
    two = spark.createDataFrame([(1, i, 99, "q", None, None, 5) for i in range(15, 25)], schema)
    t.apply(one, merge.merge_loans)
    t.apply(two, merge.merge_loans)
    assert rows_of(t.read()) == rows_of(merge.merge_loans(one, two).drop("action")) and t.read().where("work_id = 99").count() == 5


def test_a_feed_into_the_table(spark, tmp_path):
    def deliver(n, rows):
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        stream = spark.readStream.schema(FEED).parquet(f"{tmp_path}/feed")
        feed.upsert_stream(stream, f"{tmp_path}/t", f"{tmp_path}/checkpoint", buckets=4).awaitTermination(120)
        return {(r.source_record_id, r.title, r.deleted) for r in feed.table(spark, f"{tmp_path}/t", 4).read().collect()}

    assert deliver(0, [(*work("a", "A"), 1), (*work("a", "A2", "h2"), 2), (*work("b", "B"), 1)]) == {("ra", "A2", False), ("rb", "B", False)}
    assert deliver(1, [(*work("c", "C"), 3), (1, "rb", None, None, None, True, 3)]) == {("ra", "A2", False), ("rb", "B", True), ("rc", "C", False)}
    assert feed.table(spark, f"{tmp_path}/t", 4).versions() == [0, 1]


def gate(batches):
    """What the gate should pass on: (batch, record, content, items, deleted, action, items_changed)."""
    out, state = [], {}
    for n, batch in enumerate(batches):
        for key in sorted({r[1] for r in batch}):
            before = now = state.get(key)
            for r in sorted((r for r in batch if r[1] == key), key=lambda r: (r[6], r[3] or "")):
                if now and r[6] < now[3]:
                    continue
                now = ((now[0], now[1], True, r[6]) if now else None) if r[5] else (r[3], r[4], False, r[6])
            if now is None:
                continue
            state[key] = now
            if before is None:
                action = None if now[2] else "inserted"
            elif now[2]:
                action = None if before[2] else "deleted"
            else:
                action = "updated" if now[0] != before[0] else "unchanged" if before[2] or now[1] != before[1] else None
            if action:
                out.append((n, key, now[0], now[1], now[2], action, action in ("inserted", "updated") or (action == "unchanged" and now[1] != before[1])))
    return sorted(out)


def test_the_gate_passes_on_changes_only(spark, tmp_path):
    rng, batches = random.Random(8), []
    for n in range(4):
        batches.append([(1, f"r{rng.randrange(8)}", f"t{n}", *((None, None, True) if rng.random() < 0.25 else (rng.choice("xy"), rng.choice("ij"), False)), rng.randrange(n * 3, n * 3 + 6)) for _ in range(12)])
    batches.append(batches[3])  # delivered again
    got = []
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, FEED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        out = feed.changes(spark.readStream.schema(FEED).parquet(f"{tmp_path}/feed"))
        # one query goes on from batch to batch
        q = out.writeStream.foreachBatch(lambda df, _, n=n: got.extend((n, r.source_record_id, r.content_hash, r.items_hash, r.deleted, r.action, r.items_changed) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/gate").trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    assert sorted(got) == gate(batches) and not [g for g in got if g[0] == 4]
