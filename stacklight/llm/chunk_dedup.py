"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes (h = 2 h + G[byte], 32 bits, so it sees the last 32 bytes); a chunk ends where its top bits are
all zero, not before `least` bytes and at `most` at the latest. Boundaries follow content, so an insertion moves the cuts
near it only. Chunks with one 128-bit digest are one: the first by doc_id, row and place stays, the others are removed, if they
make up a run of `least_run` bytes or the whole text: shorter runs are stock phrases, which clean texts share.

Chunks are small against a passage of 50 words (about 250 bytes), which loses the two that it shares with its
neighbours: what is left in between has to make up a run.

A text's equal chunks are one row before the shuffle, and digests are counted with partial sums; a chunk that a third of all
texts share is a skewed join key, which adaptive execution splits. Rows carry a chunk's number among its text's digests;
the places are found again from the text, so that they are neither stored nor shuffled.

Cases: null text is empty (no chunks); texts shorter than `least` are one chunk; of equal rows one keeps its text; null ids come
first; an empty table gives no rows; further columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE64, materialize, mix64, powers, slices, text_bytes
from .suffix_dedup import offsets

LEAST, MOST, BITS, LEAST_RUN = 24, 1024, 4, 100
GEAR = (mix64(BYTE64) >> np.uint64(32)).astype(np.uint32)
SECOND = mix64(BYTE64 + np.uint64(1))


def cuts(text: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> np.ndarray:
    """The chunks' ends."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    h = GEAR[np.frombuffer(text, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # the sum over the last 2 k bytes from those over k
        h[k:] += h[:-k].copy() << np.uint32(k) if n > k else h[:0]
    out, last = [], 0
    for c in (np.flatnonzero(h < np.uint32(1 << (32 - bits))) + 1).tolist():
        while c - last > most:
            last += most
            out.append(last)
        if c - last >= least:
            out.append(c)
            last = c
    while n - last > most:
        last += most
        out.append(last)
    if last < n:
        out.append(n)
    return np.array(out, np.int64)


def digests(text: bytes, ends: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each chunk."""
    b, one, two = np.frombuffer(text, np.uint8), [], []
    for lo in range(0, len(ends), step):
        e = ends[lo : lo + step]
        begin = int(ends[lo - 1]) if lo else 0
        starts = np.concatenate([[begin], e[:-1]])
        p = powers(int((e - starts).max()))[np.arange(begin, e[-1]) - np.repeat(starts, e - starts)]
        part, size = b[begin : e[-1]], (e - starts).astype(np.uint64)
        one.append(mix64(np.add.reduceat(BYTE64[part] * p, starts - begin) + size))
        two.append(mix64(np.add.reduceat(SECOND[part] * p, starts - begin) ^ size))
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def distinct(text: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """A text's different digests in order (both hashes), where the places of each begin in the last array, and all places."""
    a, b = digests(text, ends)
    by = np.lexsort((np.arange(len(a)), b, a))
    a, b = a[by], b[by]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.append(first, len(by)), by


def long_runs(chunks: list[int], ends: list[int], least: int) -> set[int]:
    """Those of the sorted chunks that lie in a run of neighbours of `least` bytes, or in one that is the whole text."""
    out, lo = set(), 0
    for k in range(len(chunks)):
        if k + 1 == len(chunks) or chunks[k + 1] != chunks[k] + 1:
            size = ends[chunks[k]] - (ends[chunks[lo] - 1] if chunks[lo] else 0)
            if size >= least or size == ends[-1]:
                out.update(chunks[lo : k + 1])
            lo = k + 1
    return out


def remove_repeated_chunks(docs: DataFrame, text: str = "text", least: int = LEAST, most: int = MOST, bits: int = BITS, least_run: int = LEAST_RUN) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_removed (bytes), n_spans (maximal removed runs), kept (bytes), kept_sha256 for each row."""

    def index(batches):
        part, n, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            uid, texts, found, sizes = [], [], [], []
            for t in batch.column("text").to_pylist():
                e = cuts(t, least, most, bits)
                a, b, begin, _ = distinct(t, e)
                found.append((a, b, np.diff(begin)))
                uid.append((part << 36) + n)
                texts.append(pack.compress(t))
                sizes.append(len(e))
                n += 1
            if not uid:
                continue
            outer = offsets([len(x[0]) for x in found])
            a, b, m = (np.concatenate(x) for x in zip(*found, strict=True))
            lists = [pa.ListArray.from_arrays(outer, x) for x in (pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(m, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(uid, pa.int64()), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "uid", "text", "n_chunks", "a", "b", "m"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    table = materialize(given.mapInArrow(index, "doc_id long, uid long, text binary, n_chunks long, a array<long>, b array<long>, m array<int>"), "chunk-index")
    rows = table.select("doc_id", "uid", F.posexplode(F.arrays_zip("a", "b", "m")).alias("j", "x")).select("doc_id", "uid", "j", "x.*")
    counts = rows.groupBy("a", "b").agg(F.sum("m").alias("n"), F.min(F.struct("doc_id", "uid")).alias("first")).where("n > 1").select("a", "b", F.col("first.uid").alias("holder"))
    again = materialize(counts, "chunk-repeats")
    # a digest's number in its text; below zero (-1 - j) where it has several places
    hit = rows.select("uid", "a", "b", F.when(F.col("m") == 1, F.col("j")).otherwise(-1 - F.col("j")).alias("j")).join(again.hint("merge"), ["a", "b"])
    # below zero from here on: the first place stays
    gone = hit.where("uid <> holder or j < 0").select("uid", F.when((F.col("uid") == F.col("holder")) | (F.col("j") >= 0), F.col("j")).otherwise(-1 - F.col("j")).alias("j"))
    gone = gone.groupBy("uid").agg(F.collect_list("j").alias("gone"))

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            out = []
            for doc, t, n, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "n_chunks", "gone")), strict=True):
                t = kept = unpack.decompress(t)
                lost = ()
                if gone:
                    ends = cuts(t, least, most, bits)
                    *_, begin, by = distinct(t, ends)
                    ends, begin = ends.tolist(), begin.tolist()
                    places = [by[begin[j] : begin[j + 1]] if j >= 0 else by[begin[-1 - j] + 1 : begin[-j]] for j in gone]
                    lost = long_runs(np.sort(np.concatenate(places)).tolist(), ends, least_run)
                    kept = b"".join(t[s:e] for i, (s, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if i not in lost)
                out.append((doc, len(t), n, len(t) - len(kept), sum(i - 1 not in lost for i in lost), kept, hashlib.sha256(kept).hexdigest()))
            kinds = (*[pa.int64()] * 5, pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "n_chunks", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = table.select("uid", "doc_id", "text", "n_chunks").join(gone.hint("merge"), "uid", "left").select("doc_id", "text", "n_chunks", "gone")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_chunks long, n_removed long, n_spans long, kept binary, kept_sha256 string")
