"""Two-pass external shuffle into shards.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash. Pass two puts each bucket into an order
that doesn't depend on how it arrived, shuffles it with Fisher-Yates under a seed of its own, and writes it. The buckets one
after another are the shuffled corpus; shard s of n is its s-th n-th, so counts differ by one at most (law `rows`).

Cases: null texts have no bytes; equal rows and equal texts are records of their own, spread like any others (the hash takes a
row's key, so a group of equal texts is never in one bucket; rows that are equal in key and text are dealt on by their first
position); null ids hash like any value; an empty table gives no rows. A record is carried whole, as the struct `row`, so its
columns may have any names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Text bytes that a bucket holds on average. The arrays of a bucket stay a few times this.
BUCKET_BYTES = 8 << 20
#: Buckets whose starts one task adds up.
GROUP = 4096


def two_pass_shuffle(docs: DataFrame, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, shuffled and written: row (a struct of its columns), bucket, pos (gapless from 0 over the corpus), total."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1
    total = docs.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    # a row's place among equal keys isn't known without a shuffle; the part of the scan stands in for it
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.monotonically_increasing_id()), F.lit(n_buckets)).cast("int")

    def fisher_yates(batches):
        held, now = [], None

        def emit():
            t = pa.Table.from_batches(held).combine_chunks()
            rng = np.random.Generator(np.random.PCG64([seed, now]))
            order = np.array(sorted(range(t.num_rows), key=lambda i, k=t.column("sort_key").to_pylist(): k[i]))
            rng.shuffle(order)  # Fisher-Yates
            t = t.take(pa.array(order)).append_column("bucket_pos", pa.array(np.arange(len(order), dtype=np.int64)))
            return t.drop_columns(["sort_key"]).to_batches(max_chunksize=512)

        for b in batches:
            ids = b.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if now is not None and ids[lo] != now:
                    yield from emit()
                    held.clear()
                now = int(ids[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from emit()

    parts = max(1, min(n_buckets, 1 << 16))
    order = F.concat_ws(":", F.xxhash64(F.lit(seed), F.col(key), F.col(text)), F.col(key).cast("string"))
    scattered = docs.select(F.struct("*").alias("row"), bucket.alias("bucket"), order.alias("sort_key"))
    out = T.StructType([T.StructField("row", docs.schema), T.StructField("bucket", T.IntegerType()), T.StructField("bucket_pos", T.LongType())])
    moved = scattered.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(fisher_yates, out)
    written = materialize(moved, "sharding")
    # the bucket starts: running sums over the buckets of a group, a row each, and over the groups
    counts = materialize(written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.floor(F.col("bucket") / GROUP)), "sharding-counts")
    groups = counts.groupBy("group").agg(F.sum("n").alias("group_n"))
    groups = groups.select("group", (F.sum("group_n").over(Window.orderBy("group")) - F.col("group_n")).alias("before"), F.sum("group_n").over(Window.partitionBy()).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("group").orderBy("bucket")) - F.col("n")
    base = materialize(counts.withColumn("inside", inside).join(groups, "group").select("bucket", (F.col("before") + F.col("inside")).alias("base"), "total"), "sharding-base")
    return written.join(base, "bucket").withColumn("pos", F.col("base") + F.col("bucket_pos"))


def shard(docs: DataFrame, n_shards: int = 8, **options) -> DataFrame:
    """The shuffled rows with shard and slot under law `rows`: shard s holds pos in [ceil(s N / n), ceil((s + 1) N / n))."""
    x = two_pass_shuffle(docs, **options)
    n, s = F.lit(n_shards).cast("long"), F.expr(f"cast(pos * {n_shards} div total as long)")
    return x.withColumn("shard", s.cast("int")).withColumn("slot", F.col("pos") - F.expr(f"(cast(shard as long) * total + {n_shards} - 1) div {n_shards}")).drop("base", "bucket_pos")


def digests(sharded: DataFrame) -> DataFrame:
    """The contract's row for each record of shard()."""
    return sharded.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("row.text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("row.text").cast("binary"), F.lit(b""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
