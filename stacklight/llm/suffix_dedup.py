"""Exact removal of repeated byte strings by a column-wise multi-document suffix construction.

A byte goes if a string of `length` bytes that covers it also starts elsewhere. The construction inserts one symbol of every
string a round, right to left, and keeps the collection's suffix order, its Burrows-Wheeler column and the common prefixes
of neighbours; equal strings end up as neighbours that share `length` symbols.

So that no text meets the whole corpus, the strings are first dealt to groups in which all their copies meet:
1. The anchor of a string is the first of its 64-byte grams with the least hash. Equal strings have equal anchors at equal
   places. Runs of neighbouring strings share an anchor; such a run, the bytes that it covers, is a context.
2. Contexts whose anchor occurs once hold no repeats. Equal contexts (128 bits over anchor and content) are one row with a
   count (summed within each text first, so that a periodic text costs one row); with two or more, all their strings repeat.
3. Where an anchor has different contexts, one text of each is fetched, and the contexts, aligned at the anchor, go through
   the construction: a round takes the column of symbols before the current suffixes (the BWT column), reorders the suffixes
   stably by it, and renews the common prefixes from range minima of the last round's. Rounds: one for each aligned column.
   Groups stream through a task in batches of bounded size.
4. An anchor with more than `group_limit` different contexts is dealt to many tasks first: its strings are cut into segments of
   neighbouring columns, and a segment's contexts are dealt by the window of bytes that all of its strings cover, so equal strings
   still meet. Equal pieces of a segment become one row with a count, and what is found for it goes back to all of them. Groups
   of many different pieces are cut again, into an eighth each time; a segment of one column holds equal strings only.
The columns are arrays in memory instead of external files: a batch is bounded, and executors should keep nothing on local disk.

Cases: null text is empty; texts under `length` bytes keep everything; equal rows repeat each other and both lose their text; null
ids are carried; an empty table gives no rows; further columns are ignored. Whole texts are read, in pieces of 2**20 strings.
"""

from __future__ import annotations

import functools
import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTE64, materialize, mix64, powers, release, slices, text_bytes

GRAM, PIECE = 64, 1 << 20
BATCH_CONTEXTS, GROUP_LIMIT = 8192, 512
PIECES = "g long, h long, c long, n long, first int, at int, k int, context binary"
_inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
_inverses = np.ones(1, np.uint64)


def inverses(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        _inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _inverse, np.uint64), dtype=np.uint64)])
    return _inverses[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i, from prefix and suffix minima of blocks of `width`."""
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def contexts(text: bytes, length: int, gram: int = GRAM, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """Of each run of strings with one anchor: the anchor's hash, the context's digest, the first string's start, the anchor's
    distance from it, and the number of strings."""
    out: list[tuple] = []
    every = np.frombuffer(text, np.uint8)
    for lo in range(0, len(every) - length + 1, piece):
        b = every[lo : lo + piece + length - 1]
        n = len(b)
        pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE64[b] * powers(n), dtype=np.uint64)])
        inv = inverses(n + 1)
        h = mix64((pre[gram:] - pre[:-gram]) * inv[: n - gram + 1])
        low = np.uint64((1 << 21) - 1)
        least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        at = (least & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        count = np.diff(np.concatenate([first, [len(at)]]))
        at = at[first]
        end = first + count - 1 + length
        shape = mix64((((at - first) << 32) | count).astype(np.uint64))
        out.append((h[at], mix64(mix64((pre[end] - pre[first]) * inv[first]) + shape), first + lo, at - first, count))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def offsets(counts) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def distinct(h, c, a, d, k) -> tuple[np.ndarray, ...]:
    """A text's different contexts: h, c, d, k, how often each occurs, and the starts of all, one context after another."""
    by = np.lexsort((a, c, h))
    h, c = h[by], c[by]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[first], c[first], d[by][first], k[by][first], np.diff(np.append(first, len(h))), a[by]


def repeated(rows: list[tuple[int, int, int, bytes]], length: int, columns: int) -> np.ndarray:
    """rows: (group, column of the first string, strings, context), in any order. Which strings, by their start column (of
    `columns`), repeat inside their group: a boolean matrix."""
    width = columns - 1 + length
    m = len(rows)
    symbol = np.full((width + 1, m), 256, np.int16)  # 256 stands where a context doesn't reach
    for i, (_, at, k, text) in enumerate(rows):
        symbol[at : at + k - 1 + length, i] = np.frombuffer(text, np.uint8)
    _, group = np.unique([r[0] for r in rows], return_inverse=True)
    first = np.array([r[1] for r in rows])
    last = first + np.array([r[2] for r in rows])
    order = np.argsort(group, kind="stable")
    common = np.zeros(m + 1, np.int64)
    found = np.zeros((m, columns), bool)
    for x in range(width - 1, -1, -1):
        bwt = group[order] * 257 + symbol[x, order]
        step = np.argsort(bwt, kind="stable")
        key = bwt[step]
        same = key[1:] == key[:-1]
        pairs = np.stack([step[:-1] + 1, step[1:] + 1], 1)
        low = np.minimum.reduceat(common, pairs[same].reshape(-1))[::2] if same.any() else np.zeros(0, np.int64)
        fresh = np.zeros(m + 1, np.int64)
        fresh[1:m][same] = low + 1
        order, common = order[step], fresh
        if x < columns:
            both = np.maximum(common[:m], common[1:]) >= length
            inside = (first[order] <= x) & (x < last[order])
            found[order[both & inside], x] = True
    return found


def segments(length: int, step: int):
    """Cuts pieces into those of `step` columns; g: the segment and the bytes that all its strings cover; s: a digest of the
    piece, so that g and s together tell its content."""

    def run(batches):
        digest = lambda a, b, text: int.from_bytes(hashlib.blake2b(struct.pack("<qq", a, b) + text, digest_size=8).digest(), "little", signed=True)
        for b in slices(batches):
            out = []
            for g, h, c, n, first, k, text in zip(*(b.column(x).to_pylist() for x in ("g", "h", "c", "n", "first", "k", "context")), strict=True):
                for s in range(first - first % step, first + k, step):
                    lo, hi = max(first, s), min(first + k, s + step)
                    part = text[lo - first : hi - 1 - first + length]
                    out.append((digest(g, s, text[s + step - 1 - first : s + length - first]), h, c, n, lo - s, lo - first, hi - lo, part, digest(lo - s, hi - lo, part)))
            for lo in range(0, len(out), 4000):
                cut = out[lo : lo + 4000]
                rows = piece_batch([r[:8] for r in cut])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([r[8] for r in cut], pa.int64())], names=[*rows.schema.names, "s"])

    return run


def piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (*[pa.int64()] * 4, *[pa.int32()] * 3, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["g", "h", "c", "n", "first", "at", "k", "context"])


def ranges(flags: np.ndarray, first: int, count: int) -> list[int]:
    """Runs of true flags as start, end, start, end, ... from 0 at `first`."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags[first : first + count], [False]]).view(np.int8))).tolist()


def found_spans(docs: DataFrame, text: str, length: int, carry: list[str] | None = None, group_limit: int = GROUP_LIMIT, batch: int = BATCH_CONTEXTS, written: list | None = None) -> tuple[DataFrame, DataFrame]:
    """A row for each row of docs: uid, doc_id, text (binary, zstd), carried (a struct of the columns of `carry`); and uid, spans
    (array of start, end; unordered, overlapping) for those that have some. `written` takes the tables that both are read from."""
    span = length - GRAM
    keep = functools.partial(materialize, drop_shuffles=True, written=written)

    def index(batches):
        part, n, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            uid, texts, found = [], [], []
            for t in b.column("text").to_pylist():
                found.append(distinct(*contexts(t, length)))
                uid.append((part << 36) + n)
                texts.append(pack.compress(t))
                n += 1
            outer = offsets([len(x[0]) for x in found])
            h, c, d, k, m, a = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 6
            starts = pa.ListArray.from_arrays(offsets(m), pa.array(a, pa.int64()))
            lists = [pa.ListArray.from_arrays(outer, x) for x in (pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(d, pa.int32()), pa.array(k, pa.int32()), pa.array(m, pa.int32()), starts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("carried"), pa.array(uid, pa.int64()), pa.array(texts, pa.binary()), *lists], names=["doc_id", "carried", "uid", "text", "h", "c", "d", "k", "m", "a"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*carry or [F.lit(0).alias("none")]).alias("carried"), text_bytes(text).alias("text"))
    table = keep(given.mapInArrow(index, f"doc_id long, carried {given.schema['carried'].dataType.simpleString()}, uid long, text binary, h array<long>, c array<long>, d array<int>, k array<int>, m array<int>, a array<array<long>>"), "suffix-index")
    again = keep(table.select(F.inline(F.arrays_zip("h", "m"))).groupBy("h").agg(F.sum("m").alias("n")).where("n > 1").select("h"), "suffix-again")
    rows = table.select("uid", F.inline(F.arrays_zip("h", "c", "d", "k", "m", "a")))
    rows = keep(rows.join(again, "h", "left_semi").select("uid", "h", "c", "d", "k", "m", "a"), "suffix-rows")
    kinds = keep(rows.groupBy("h", "c").agg(F.sum("m").alias("n"), F.min(F.struct("uid", F.col("a")[0].alias("a"), "d", "k")).alias("at")).select("h", "c", "n", "at.*"), "suffix-contexts")
    mixed = keep(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "suffix-mixed")
    plain = kinds.where("n > 1").join(mixed.select("h"), "h", "left_anti").select("h", "c", F.array(F.lit(0), F.col("k")).alias("runs"))

    def fetch(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in slices(batches):
            out = []
            for t, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                t = unpack.decompress(t)
                out += [(w["h"], w["h"], w["c"], w["n"], span - w["d"], 0, w["k"], t[w["a"] : w["a"] + w["k"] - 1 + length]) for w in wanted]
            for lo in range(0, len(out), 4000):
                yield piece_batch(out[lo : lo + 4000])

    def pieces(of: DataFrame) -> DataFrame:
        wanted = kinds.join(of.select("h"), "h").groupBy("uid").agg(F.collect_list(F.struct("h", "c", "n", "a", "d", "k")).alias("wanted"))
        return table.select("uid", "text").join(wanted, "uid").select("text", "wanted").mapInArrow(fetch, PIECES)

    def construct(columns: int):
        def run(batches):
            rows: list[tuple] = []

            def emit(part):
                found = repeated([(r[0], r[4], r[6], r[7]) for r in part], length, columns)
                out = [(r[1], r[2], [r[5], r[5] + r[6]] if r[3] > 1 else [r[5] + x for x in ranges(f, r[4], r[6])]) for r, f in zip(part, found, strict=True)]
                out = [o for o in out if o[2]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["h", "c", "runs"])

            for b in batches:
                for r in zip(*(b.column(x).to_pylist() for x in ("g", "h", "c", "n", "first", "at", "k", "context")), strict=True):
                    if len(rows) >= batch and r[0] != rows[-1][0]:
                        yield from emit(rows)
                        rows = []
                    rows.append(r)
            if rows:
                yield from emit(rows)

        return run

    def built(groups: DataFrame, columns: int) -> DataFrame:
        return groups.repartition("g").sortWithinPartitions("g").mapInArrow(construct(columns), "h long, c long, runs array<int>")

    verdicts = plain.union(built(pieces(mixed.where(F.col("kinds") <= group_limit)), span + 1))
    large, step = mixed.where(F.col("kinds") > group_limit), span + 1
    hot, rounds = None if large.isEmpty() else pieces(large), []
    while hot is not None:
        step = -(-step // 8)
        parts = keep(hot.mapInArrow(segments(length, step), f"{PIECES}, s long"), "suffix-parts")
        unlike = keep(parts.groupBy("g", "s").agg(F.sum("n").alias("n"), *(F.min(x).alias(x) for x in ("first", "k", "context"))), "suffix-unlike")
        met = keep(unlike.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("copies")).where("copies > 1"), "suffix-met")
        sized = unlike.join(met.hint("merge"), "g").select("g", F.col("g").alias("h"), F.col("s").alias("c"), "n", "first", F.lit(0).alias("at"), "k", "context", "kinds")
        plain = sized.where("kinds = 1").select("h", "c", F.array(F.lit(0), F.col("k")).alias("runs"))
        rounds.append((parts, plain.union(built(sized.where((F.col("kinds") > 1) & (F.col("kinds") <= group_limit)).drop("kinds"), step))))
        hot = None if met.where(F.col("kinds") > group_limit).isEmpty() else sized.where(F.col("kinds") > group_limit).drop("kinds")
    below = None
    for parts, found in reversed(rounds):
        found = found.union(below) if below is not None else found
        found = keep(found.toDF("g", "s", "runs"), "suffix-found")
        below = parts.select("g", "s", "h", "c", "at").join(found.hint("merge"), ["g", "s"]).select("h", "c", F.expr("transform(runs, x -> x + at)").alias("runs"))
        below = below.groupBy("h", "c").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    if below is not None:
        verdicts = verdicts.union(below)
    verdicts = keep(verdicts, "suffix-verdicts")
    spans = rows.select("uid", "h", "c", "a").join(verdicts, ["h", "c"]).select("uid", F.expr(f"flatten(transform(a, x -> transform(sequence(0, size(runs) - 1, 2), i -> struct(x + runs[i] as start, x + runs[i + 1] + {length - 1} as end))))").alias("spans"))
    spans = spans.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return table.select("uid", "doc_id", "carried", "text"), spans


def runs_of(spans, text: bytes, least_words: int, sure_bytes: int) -> list[list[int]]:
    """The maximal runs that the spans cover, without those of less than `least_words` words and less than `sure_bytes` bytes."""
    merged: list[list[int]] = []
    for s in sorted((s["start"], s["end"]) for s in spans or ()):
        if merged and s[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s[1])
        else:
            merged.append(list(s))
    return [s for s in merged if s[1] - s[0] >= sure_bytes or len(text[s[0] : s[1]].split()) >= least_words]


def cut_out(rows: DataFrame, least_words: int = 0, sure_bytes: int = 400) -> DataFrame:
    """What remove_repeats returns, from doc_id, text (zstd), spans and carried."""

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in slices(batches):
            out = []
            for doc, t, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                t = unpack.decompress(t)
                merged = runs_of(spans, t, least_words, sure_bytes)
                edges = [0, *(e for s in merged for e in s), len(t)]
                kept = b"".join(t[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                whole = "".join(t[a:z].decode("utf-8", "ignore") for a, z in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc, len(t), len(t) - len(kept), len(merged), kept, whole, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)), b.column("carried")], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "kept_sha256", "carried"])

    return rows.mapInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, kept_sha256 string, carried {rows.schema['carried'].dataType.simpleString()}")


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 400, carry: list[str] | None = None, least_words: int = 0, sure_bytes: int = 400, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_text (without the bytes of cut characters),
    kept_sha256, carried (a struct of the columns of `carry`) for each row of docs(doc_id, text). A run of repeated strings of
    less than `least_words` words and less than `sure_bytes` bytes stays."""
    table, spans = found_spans(docs, text, length, carry, **options)
    return cut_out(table.join(spans, "uid", "left"), least_words, sure_bytes)


def remove_repeats_and_mark(docs: DataFrame, text: str = "text", length: int = 400, carry: list[str] | None = None, mark_bytes: int = 200, mark_words: int = 50, **options) -> DataFrame:
    """remove_repeats for strings of `length` bytes, and in `carried` also n_passages and n_passage_bytes, the repeated passages
    that are only marked: runs of repeated strings of `mark_bytes` bytes that hold `mark_words` words, or `length` bytes.

    The strings of `mark_bytes` come first. A string of `length` that repeats holds repeated ones of `mark_bytes` only, at each
    of its places, so the construction for `length` takes the marked runs of that size instead of the whole texts: the same
    strings meet, and the removal is that of remove_repeats."""
    if mark_bytes > length:
        raise ValueError("mark_bytes exceeds length")
    first: list = []
    table, spans = found_spans(docs, text, mark_bytes, carry, written=first, **options)

    def mark(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in slices(batches):
            out = []
            for t, spans in zip(*(b.column(c).to_pylist() for c in ("text", "spans")), strict=True):
                out.append(runs_of(spans, unpack.decompress(t), mark_words, length) if spans else [])
            sizes = [[z - a for a, z in runs] for runs in out]
            flat = pa.array([x for runs, n in zip(out, sizes, strict=True) for (a, _), k in zip(runs, n, strict=True) if k >= length for x in (a, a + k)], pa.int32())
            long = pa.ListArray.from_arrays(offsets([2 * sum(k >= length for k in n) for n in sizes]), flat)
            counts = [pa.array([len(n) for n in sizes], pa.int64()), pa.array([sum(n) for n in sizes], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("uid", "doc_id", "carried", "text")), *counts, long], names=["uid", "doc_id", "carried", "text", "n_passages", "n_passage_bytes", "long"])

    def take(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in slices(batches, 64):
            out = []
            for uid, t, long in zip(*(b.column(c).to_pylist() for c in ("uid", "text", "long")), strict=True):
                t = unpack.decompress(t)
                out += [(uid, a, t[a:z]) for a, z in zip(long[::2], long[1::2], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "start", "text"])

    marked = table.join(spans, "uid", "left").mapInArrow(mark, f"uid long, doc_id long, carried {table.schema['carried'].dataType.simpleString()}, text binary, n_passages long, n_passage_bytes long, long array<int>")
    marked = materialize(marked, "suffix-marked", drop_shuffles=True)
    release(first)
    runs = marked.where(F.size("long") > 0).select("uid", "text", "long").mapInArrow(take, "doc_id long, start int, text binary")
    runs, spans = found_spans(runs, "text", length, ["start"], **options)
    shifted = F.expr("transform(spans, s -> struct(s.start + start as start, s.end + start as end))").alias("spans")
    spans = spans.join(runs.select("uid", "doc_id", "carried.start"), "uid").select(F.col("doc_id").alias("uid"), shifted)
    spans = spans.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return cut_out(marked.select("uid", "doc_id", "text", F.struct("carried.*", "n_passages", "n_passage_bytes").alias("carried")).join(spans, "uid", "left"))
