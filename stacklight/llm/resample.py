"""Target-distribution importance resampling over bucket-partitioned inverted postings.

Documents are described by hashed word n-grams. A task inverts the documents of a segment (some thousands of rows): for each
bucket, which of them hold it and how often; the lists of a range of buckets are one row of packed arrays. The rows are shuffled
by range; there they meet the gains of their buckets, log ((t + 1) (S + B) / ((s + 1) (T + B))), which come from the counts of both
corpora, brought together by bucket. The gains go to the lists' documents as contributions, added up by segment in the task that
has them, shuffled by segment and reduced by document. A draw without replacement takes the highest of weight + Gumbel noise, the
noise being a hash of the seed and the document's id.

A frequent word's bucket is no hot key: a range's rows are dealt to slices of about `slice_segments` segments, and its gains, an array
of bounded length, to as many copies; so a task has the same load at every size. Ranks are counted by ranges of the score, so
that no task orders the whole corpus.

Cases: null, empty and word-less texts hold no features (weight 0); equal rows count and are drawn each, a null id has the noise of
an empty one and comes last among ties, and rows of equal score and id are ranked in any order; an empty table gives no rows, an
empty target the gains of t = T = 0; further columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_bytes

#: Ranges of buckets; documents of a segment (65,536 at most) and the list entries after which it is full; segments of a slice.
GROUPS, SEGMENT_ROWS, SEGMENT_POSTINGS, SLICE_SEGMENTS = 16, 8192, 4_000_000, 64
#: A-Z lowered; digits, letters and bytes from 0x80 stay; the others separate words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Crcs(dict):
    """The crc32 of each word, computed once, and its value after a blank."""

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        self[word] = c = zlib.crc32(word)
        return c


def features(text: bytes, crcs: Crcs, width: int, n_buckets: int) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of each run of 1 to `width` words."""
    w = text.translate(WORD_BYTES).split()
    own = [crcs[x] for x in w]
    spaced = [b" " + x for x in w] if width > 1 else []
    out, last = list(own), own
    for k in range(1, width):
        last = [zlib.crc32(x, c) for x, c in zip(spaced[k:], last, strict=False)]  # a run goes on from the run before it
        out += last
    return len(w), np.array(out, np.int64) % n_buckets


def postings(docs: DataFrame, width: int, n_buckets: int) -> DataFrame:
    """Rows of two kinds: for each document (grp null) segment, place, doc_id, n_words, n_features; for each range of buckets of a
    segment its lists one after another: ends (of each bucket's list), places, counts (little-endian; counts of 32 bits, places of 16)."""
    fields = {"segment": pa.int64(), "place": pa.int32(), "doc_id": pa.int64(), "n_words": pa.int64(), "n_features": pa.int64(), "grp": pa.int32(), "ends": pa.binary(), "places": pa.binary(), "counts": pa.binary()}
    span = -(-n_buckets // GROUPS)

    def run(batches):
        part, made, crcs, rows, keys = TaskContext.get().partitionId(), 0, Crcs(), [], []

        def table(**cols):
            n = len(cols["segment"])
            return pa.RecordBatch.from_arrays([pa.array(cols[f], t) if f in cols else pa.nulls(n, t) for f, t in fields.items()], names=list(fields))

        def emit():
            segment = (part << 32) + made
            ids, words, sizes = zip(*rows, strict=True)
            yield table(segment=[segment] * len(rows), place=range(len(rows)), doc_id=ids, n_words=words, n_features=sizes)
            key, n = np.concatenate([k for k, _ in keys]), np.concatenate([n for _, n in keys])
            order = np.argsort(key, kind="stable")  # by bucket, then place
            bucket, place, n = key[order] // SEGMENT_ROWS, (key[order] % SEGMENT_ROWS).astype("<u2"), n[order]
            for g in range(GROUPS):
                to = np.searchsorted(bucket, np.arange(g * span, (g + 1) * span + 1))
                yield table(segment=[segment], grp=[g], ends=[(to[1:] - to[0]).astype("<i4").tobytes()], places=[place[to[0] : to[-1]].tobytes()], counts=[n[to[0] : to[-1]].tobytes()])

        held = 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                n_words, found = features(text.as_py(), crcs, width, n_buckets)
                distinct, n = np.unique(found, return_counts=True)
                keys.append((distinct * SEGMENT_ROWS + len(rows), n.astype("<u4")))
                rows.append((doc, n_words, len(found)))
                held += len(distinct)
                if len(rows) == SEGMENT_ROWS or held > SEGMENT_POSTINGS:
                    yield from emit()
                    made, held = made + 1, 0
                    rows.clear()
                    keys.clear()
        if rows:
            yield from emit()

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, ", ".join(f"{f} {kinds[t]}" for f, t in fields.items()))


def _totals(rows: DataFrame, count, n_buckets: int) -> DataFrame:
    """bucket, n: the sum over all rows of what count(batch, total) adds to total, an array by bucket; added up in the tasks first."""

    def run(batches):
        total = np.zeros(n_buckets, np.int64)
        for b in batches:
            count(b, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    return rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def text_totals(texts: DataFrame, width: int, n_buckets: int) -> DataFrame:
    """bucket, n: the features of texts (text) in each bucket."""

    def count(batch, total, crcs=None):
        crcs = crcs or Crcs()
        for text in batch.column("text"):
            total += np.bincount(features(text.as_py(), crcs, width, n_buckets)[1], minlength=n_buckets)

    return _totals(texts.select(text_bytes().alias("text")), count, n_buckets)


def list_totals(lists: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, n: the features of the lists' documents in each bucket."""
    span = -(-n_buckets // GROUPS)

    def count(batch, total):
        for g, ends, counts in zip(*(batch.column(c).to_pylist() for c in ("grp", "ends", "counts")), strict=True):
            until = np.cumsum(np.frombuffer(counts, "<u4"), dtype=np.int64)
            sums = np.diff(np.concatenate([[0], until])[np.frombuffer(ends, "<i4")], prepend=0)
            own = total[g * span : (g + 1) * span]  # the last range may be cut
            own += sums[: len(own)]

    return _totals(lists.select("grp", "ends", "counts"), count, n_buckets)


def gains(own: DataFrame, target: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, gain (in thousandths, floored) of each bucket, from the totals (bucket, n) of both corpora, which meet by bucket; the
    sums over all buckets are scalars."""
    both = own.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").na.fill(0, ["s", "t"])
    both = materialize(both, "resample-counts")
    all_s, all_t = (float((x or 0) + n_buckets) for x in both.agg(F.sum("s"), F.sum("t")).first())
    up, down = (F.col("t").cast("double") + 1) * F.lit(all_s), (F.col("s").cast("double") + 1) * F.lit(all_t)
    return both.select("bucket", F.floor(1000 * F.log(up / down)).alias("gain"))


def contributions(met: DataFrame, span: int) -> DataFrame:
    """segment, sums (little-endian 64-bit, one for each place of the segment): what the lists (segment, grp, ends, places, counts, and
    gains, of the range's buckets) add to their documents; a row for each segment and task."""

    def run(batches):
        now, sums = None, np.zeros(SEGMENT_ROWS, np.int64)

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.trim_zeros(sums, "b").astype("<i8").tobytes()], pa.binary())], names=["segment", "sums"])

        for b in batches:
            for segment, g, ends, places, counts, known in zip(*(b.column(c).to_pylist() for c in ("segment", "grp", "ends", "places", "counts", "gains")), strict=True):
                if segment != now:
                    if now is not None:
                        yield emit()
                    now = segment
                    sums[:] = 0
                gain = np.zeros(span, np.int64)
                for x in known:
                    gain[x["bucket"] - g * span] = x["gain"]
                each = np.repeat(gain, np.diff(np.frombuffer(ends, "<i4"), prepend=0)) * np.frombuffer(counts, "<u4")
                at = np.frombuffer(places, "<u2")
                sums += np.bincount(at, each, SEGMENT_ROWS).astype(np.int64)  # exact: far below 2 ** 53
        if now is not None:
            yield emit()

    return met.select("segment", "grp", "ends", "places", "counts", "gains").sortWithinPartitions("segment").mapInArrow(run, "segment long, sums binary")


def by_document(parts: DataFrame) -> DataFrame:
    """segment, place, total of the parts (segment, sums) of contributions(), which come together a segment after another."""

    def run(batches):
        now, sums = None, np.zeros(SEGMENT_ROWS, np.int64)

        def emit():
            at = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now)), pa.array(at, pa.int32()), pa.array(sums[at])], names=["segment", "place", "total"])

        for b in batches:
            for segment, own in zip(b.column("segment").to_pylist(), b.column("sums").to_pylist(), strict=True):
                if segment != now:
                    if now is not None:
                        yield emit()
                    now = segment
                    sums[:] = 0
                sums[: len(own) // 8] += np.frombuffer(own, "<i8")
        if now is not None:
            yield emit()

    return parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "segment long, place int, total long")


def weights(docs: DataFrame, target: DataFrame, width: int = 2, n_buckets: int = 10_000, slice_segments: int = SLICE_SEGMENTS) -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean gain of its features) for each row of docs (doc_id, text)."""
    stored = materialize(postings(docs, width, n_buckets), "resample-postings")
    lists, rows = stored.where("grp IS NOT NULL"), stored.where("grp IS NULL").select("segment", "place", "doc_id", "n_words", "n_features")
    span = -(-n_buckets // GROUPS)
    gain = gains(list_totals(lists, n_buckets), text_totals(target, width, n_buckets), n_buckets)
    n_slices = max(1, -(-lists.where("grp = 0").count() // slice_segments))
    ranges = gain.groupBy(F.floor(F.col("bucket") / span).cast("int").alias("grp")).agg(F.collect_list(F.struct("bucket", "gain")).alias("gains"))
    dealt = ranges.select("grp", "gains", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice"))
    slice_ = F.pmod(F.xxhash64("segment"), F.lit(n_slices)).cast("int").alias("slice")
    met = lists.select("segment", "grp", slice_, "ends", "places", "counts").hint("merge").join(dealt, ["grp", "slice"])
    sums = by_document(contributions(met, span))
    mean = F.when(F.col("n_features") > 0, F.expr("(coalesce(total, 0L) - pmod(coalesce(total, 0L), n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return rows.join(sums, ["segment", "place"], "left").select("doc_id", "n_words", "n_features", mean.alias("weight"))


def noisy(rows: DataFrame, seed: int) -> DataFrame:
    """rows (doc_id, weight) with their score: the weight plus 1000 times standard Gumbel noise by a hash of seed and id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def ranked(rows: DataFrame, take: int) -> DataFrame:
    """rows (doc_id, score, in_draw) with rank: the place of those in the draw by falling score, ties to the smaller doc_id, null
    beyond `take`. Parts are ranges of that order; a row for each part gives where it starts."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(np.arange(n, n + b.num_rows))], names=[*b.schema.names, "part", "at"])
            n += b.num_rows

    n_parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    spread = rows.where("in_draw").repartitionByRange(int(n_parts), *order).sortWithinPartitions(*order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = materialize(spread.mapInArrow(run, f"{fields}, part int, at long"), "resample-order")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # a row for each part
    rank = F.col("start") + F.col("at") + 1
    drawn = placed.join(F.broadcast(starts), "part").select(*rows.columns, F.when(rank <= take, rank).alias("rank"))
    return drawn.unionByName(rows.where("NOT in_draw").withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, **options) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a draw of `percent` of the documents with min_words or more, likelier the more a
    document reads like `target` (text) and unlike docs at large. options: those of weights()."""
    rows = materialize(noisy(weights(docs, target, **options), seed).withColumn("in_draw", F.col("n_words") >= min_words), "resample-scores")
    take = percent * rows.where("in_draw").count() // 100
    return ranked(rows, take).select("doc_id", "n_features", "weight", "score", "rank")
