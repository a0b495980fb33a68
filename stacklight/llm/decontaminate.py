"""Benchmark decontamination on a distributed positional inverted index.

The index is stored by document segments: each row holds about `segment_words` words of whole documents, with every term's
sorted positions (delta-coded) and the documents' places in the segment. A segment is searched where it lies, so postings of
frequent terms never meet in one task. Corpus counts of the test terms, summed over all segments, order the terms of a window;
a match starts from the positions of the rarest, shifted by its place in the window, and intersects the shifted lists of the
others. Documents of a segment are one position apart, which no term fills, so no match crosses documents.

Test windows are taken to the tasks in blocks of at most `block_words` words; every block is one pass over the index.

Cases: null and word-less texts have no words; items without words or id give no window; items with one id are one item; equal
rows are counted each; null doc_ids are carried; an empty table gives no rows, an empty benchmark no hits; further columns are
ignored. Whole texts are indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_bytes

#: A-Z lowered; digits, letters and bytes from 0x80 stay; the others separate words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SEGMENT_WORDS, BLOCK_WORDS = 1 << 20, 1 << 21


class Terms(dict):
    def __missing__(self, term):
        self[term] = n = len(self)
        return n


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def build_index(docs: DataFrame, text: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments: segment, doc_ids, bases (a document's first position), counts (its words), terms (joined by newlines), ends
    (of each term's postings), postings (delta-coded int32)."""
    names = ["segment", "doc_ids", "bases", "counts", "terms", "ends", "postings"]

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, counts, chunks, terms, total = [], [], [], Terms(), 0

        def emit():
            n = np.array(counts, np.int64)
            bases = np.cumsum(n + 1) - (n + 1)
            term = np.concatenate(chunks)
            at = np.arange(len(term)) + np.repeat(np.arange(len(n)), n)
            at = at[np.argsort(term, kind="stable")].astype(np.int32)
            row = [(part << 32) + made, ids, bases, n, b"\n".join(terms), np.cumsum(np.bincount(term, minlength=len(terms))).astype(np.int32).tobytes(), np.diff(at, prepend=np.int32(0)).tobytes()]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for b in batches:
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = words(t)
                ids.append(doc)
                counts.append(len(w))
                chunks.append(np.fromiter(map(terms.__getitem__, w), np.int32, len(w)))
                total += len(w) + 1
                if total >= segment_words:
                    yield emit()
                    made += 1
                    ids, counts, chunks, terms, total = [], [], [], Terms(), 0
        if ids:
            yield emit()

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes(text).alias("text")).mapInArrow(run, "segment long, doc_ids array<long>, bases array<long>, counts array<long>, terms binary, ends binary, postings binary")
    return materialize(rows, "positional-index")


class Segment:
    """A segment's postings by term."""

    def __init__(self, terms: bytes, ends: bytes, postings: bytes | None = None):
        self.number = {t: i for i, t in enumerate(terms.split(b"\n"))} if terms else {}
        self.ends = np.frombuffer(ends, np.int32)
        self.at = np.cumsum(np.frombuffer(postings, np.int32), dtype=np.int32) if postings is not None else None

    def positions(self, i: int) -> np.ndarray:
        return self.at[self.ends[i - 1] if i else 0 : self.ends[i]]

    def count(self, i: int) -> int:
        return int(self.ends[i] - (self.ends[i - 1] if i else 0))


def windows_of(benchmark: DataFrame, window: int, text: str, block_words: int):
    """Blocks of {window (tuple of terms): item ids}; the benchmark streams through the driver, a block at a time."""
    block: dict[tuple, set] = {}
    size = 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item"), text_bytes(text).alias("t")).where("item is not null").toLocalIterator():
        w = words(bytes(r.t))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            block.setdefault(tuple(w[i : i + window]), set()).add(r.item)
            size += window
        if size >= block_words:
            yield block
            block, size = {}, 0
    if block:
        yield block


def phrase_starts(seg: Segment, terms: list[int], rank: list[int]) -> np.ndarray:
    """Where the terms stand one after another. rank: the places of the terms, rarest first."""
    at = None
    for k in rank:
        p = seg.positions(terms[k]) - k
        if at is None:
            at = p
        else:
            i = np.searchsorted(p, at)
            at = at[(i < len(p)) & (p[np.minimum(i, len(p) - 1)] == at)]
        if not len(at):
            break
    return at


def proximity_spans(seg: Segment, terms: list[int], rank: list[int], slop: int) -> list[tuple[int, int]]:
    """(start, end) where the terms stand in order with at most `slop` words between them in all: from each start the earliest
    end. Starts too far from any place of the rarest term are left out first."""
    start, reach = seg.positions(terms[0]), len(terms) + slop
    rare = seg.positions(terms[rank[0]])
    i = np.searchsorted(rare, start)
    start = start[(i < len(rare)) & (rare[np.minimum(i, len(rare) - 1)] < start + reach)]
    at = start
    for t in terms[1:]:
        p = seg.positions(t)
        i = np.searchsorted(p, at, "right")
        ok = i < len(p)
        start, at = start[ok], p[i[ok]]
    near = at - start < reach
    return list(zip(start[near].tolist(), (at[near] + 1).tolist(), strict=True))


def find(index: DataFrame, benchmark: DataFrame, window: int = 10, slop: int | None = None, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """segment, doc (its number in the segment), item_id, spans (array of start, end in words): exact phrases, or with slop
    proximity matches, of each item's windows in each document."""
    spark = index.sparkSession
    schema = "segment long, doc int, item_id string, spans array<struct<start: long, end: long>>"
    found = spark.createDataFrame([], schema)
    for block in windows_of(benchmark, window, text, block_words):
        test = sorted({t for w in block for t in w})

        def count(batches, test=test):
            total: dict[bytes, int] = {}
            for b in batches:
                for terms, ends in zip(b.column("terms").to_pylist(), b.column("ends").to_pylist(), strict=True):
                    seg = Segment(terms, ends)
                    for t in test:
                        if t in seg.number:
                            total[t] = total.get(t, 0) + seg.count(seg.number[t])
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

        counts = {bytes(r.term): r.n for r in index.select("terms", "ends").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each test term of the block
        plans = [(w, sorted(range(len(w)), key=lambda k, w=w: (counts[w[k]], k)), sorted(items)) for w, items in block.items() if all(t in counts for t in w)]

        def search(batches, plans=plans):
            for b in batches:
                for segment, bases, n_words, terms, ends, postings in zip(*(b.column(c).to_pylist() for c in ("segment", "bases", "counts", "terms", "ends", "postings")), strict=True):
                    seg, bases = Segment(terms, ends, postings), np.array(bases)
                    hits: dict[tuple[int, str], list] = {}
                    for w, rank, items in plans:
                        if w[rank[0]] not in seg.number:
                            continue
                        local = [seg.number.get(t) for t in w]
                        if None in local:
                            continue
                        spans = [(s, s + len(w)) for s in phrase_starts(seg, local, rank).tolist()] if slop is None else proximity_spans(seg, local, rank, slop)
                        for s, e in spans:
                            doc = int(np.searchsorted(bases, s, "right")) - 1
                            s, e = s - int(bases[doc]), e - int(bases[doc])
                            if e <= n_words[doc]:
                                for item in items:
                                    hits.setdefault((doc, item), []).append({"start": s, "end": e})
                    cols = [[segment] * len(hits), [k[0] for k in hits], [k[1] for k in hits], list(hits.values())]
                    kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["segment", "doc", "item_id", "spans"])

        found = found.unionByName(index.select("segment", "bases", "counts", "terms", "ends", "postings").mapInArrow(search, schema))
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int | None = None, text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs(doc_id, text)."""
    index = build_index(docs, text, **options)
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "counts")).alias("doc", "x")).select("segment", "doc", F.col("x.doc_ids").alias("doc_id"), F.col("x.counts").alias("n_words"))
    hits = find(index, benchmark, window, slop, text)
    per = hits.groupBy("segment", "doc").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    # words under the union of the spans, which lie in the order of their starts
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0).cast("long"))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")), lambda a: a["n"])
    per = materialize(per.select("segment", "doc", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.concat_ws(",", "items").alias("items")), "contaminated")
    out = rows.join(per, ["segment", "doc"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
