from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stacklight.llm import sharding

from .util import EDGE, docs


def check(df, n, **options):
    rows = sharding.shard(df, n, **options).collect()
    assert len(rows) == df.count()
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    return rows


def test_law_and_order(spark):
    df = docs(spark, [(i, f"text {i} " * 20) for i in range(501)]).repartition(5)
    rows = check(df, 8, bucket_bytes=4000)
    again = sharding.shard(df, 8, bucket_bytes=4000).collect()
    assert {(r.row.doc_id, r.shard, r.slot) for r in rows} == {(r.row.doc_id, r.shard, r.slot) for r in again}
    order = [r.row.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order) and sorted(order) == list(range(501))
    assert {(r.row.doc_id, r.row.text) for r in rows} == {(i, f"text {i} " * 20) for i in range(501)}


def test_order_by_plain_loops(spark, monkeypatch):
    """The two passes again, on the driver: buckets by the seeded hash, each put in order and shuffled with its own seed."""
    monkeypatch.setattr(sharding, "GROUP", 3)
    df = docs(spark, [(i, f"text {i} " * 20) for i in range(300)]).repartition(3).cache()
    n = -(-sum(len(r.text) + 1 for r in df.collect()) // 4000)
    key = F.concat_ws(":", F.xxhash64(F.lit(17), "doc_id", "text"), F.col("doc_id").cast("string"))
    scattered = df.select("doc_id", F.pmod(F.xxhash64(F.lit(17), F.col("doc_id"), F.monotonically_increasing_id()), F.lit(n)).alias("b"), key.alias("k")).collect()
    want = []
    for b in range(n):
        bucket = [r.doc_id for r in sorted((r for r in scattered if r.b == b), key=lambda r: r.k)]
        order = np.arange(len(bucket))
        np.random.Generator(np.random.PCG64([17, b])).shuffle(order)
        want += [bucket[i] for i in order]
    got = sharding.shard(df, 8, bucket_bytes=4000).collect()
    assert n > 9 and [r.row.doc_id for r in sorted(got, key=lambda r: r.pos)] == want
    assert [r.pos for r in sorted(got, key=lambda r: (r.shard, r.slot))] == list(range(300))


def test_edge_cases(spark):
    check(docs(spark, EDGE), 8)
    check(docs(spark, EDGE), 2, bucket_bytes=10)
    assert sharding.digests(sharding.shard(docs(spark, []))).collect() == []
    got = sharding.digests(sharding.shard(docs(spark, EDGE))).collect()
    assert sorted(r["size"] for r in got) == sorted(1 + len((t or "").encode()) for _, t in EDGE)
