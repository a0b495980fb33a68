"""Mixture-controlled packing: a deficit round-robin over source queues fills every window to target token proportions.

Each source is a queue of tokens: its documents one after another, in the order of the written token table. The scheduler
owes queue q, per token sent, its share weight_q of the queues that still hold tokens; what a window can't pay in whole
tokens is carried to the next. This recurrence has a closed form: token j of queue q is due at the virtual time
(j + 1/2) / weight_q, and the windows are the tokens in the order of their due times, `window` at a time. So any task finds
the scheduler's exact state (the tokens that each queue has sent before window w) by bisection over the virtual time, with the
queue totals alone; deficits carry across windows and partitions without any sequential pass over the corpus.

Within a window the queues' tokens lie one queue after another, so a document is cut only where its queue's allotment of a
window, or a sequence of `max_len`, ends. All sequences are full but the last one.

With more sources than `max_queues`, the smallest ones are mixed by shared queues: the target holds for each queue, named sources
included, not for each of the pooled ones.

Cases: null text packs as empty (one piece: the end id); null source is a queue of its own; equal rows are packed each; an
empty table gives no rows; further columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The queue table is sent to every task. Of more sources than MAX_QUEUES, the largest (or those with a target proportion) have a
#: queue of their own, and the rest share TAIL_QUEUES by hash.
MAX_QUEUES, TAIL_QUEUES = 1024, 64
_encoders: dict[str, object] = {}


def encoder(path: str):
    """text -> list of ids, as the vocabulary file's own library gives them without added special tokens.

    The same merges are run by tiktoken, four times as fast; a text that holds one of the file's special strings goes through
    the file's own library.
    """
    if path not in _encoders:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        own: list[Tokenizer] = []  # loaded by the first text that needs it

        def slow(text):
            if not own:
                own.append(Tokenizer.from_file(path))
            return own[0].encode(text, add_special_tokens=False).ids

        fast = None
        if spec["model"]["type"] == "BPE" and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel":
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        _encoders[path] = lambda text: slow(text) if fast is None or any(s in text for s in special) else fast(text)
    return _encoders[path]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, wide: bool) -> DataFrame:
    """doc_id, queue, part (the task), n_tokens, local_off (the queue's tokens before it in this part), ids (little-endian)."""
    kind = "<u4" if wide else "<u2"

    def run(batches):
        encode, part, sent = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for b in (whole.slice(lo, 512) for whole in batches for lo in range(0, whole.num_rows, 512)):
            queues, n, off, ids = b.column("queue").to_pylist(), [], [], []
            for text, q in zip(b.column("text").to_pylist(), queues, strict=True):
                x = encode(text) if text else []
                x.append(end_id)
                ids.append(np.array(x, kind).tobytes())
                n.append(len(x))
                off.append(sent.get(q, 0))
                sent[q] = off[-1] + len(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("queue"), pa.array([part] * len(n), pa.int32()), pa.array(n, pa.int64()), pa.array(off, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "queue", "part", "n_tokens", "local_off", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "queue", "text").mapInArrow(run, "doc_id long, queue string, part int, n_tokens long, local_off long, ids binary")


class Schedule:
    """The scheduler in closed form: how many tokens each queue has sent before window w."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, window: int):
        self.totals, self.rate, self.window = totals.astype(np.int64), weights / weights.sum(), window
        self.total = int(self.totals.sum())
        self.last = float((self.totals / self.rate).max()) + 1

    def sent_by(self, time: np.ndarray) -> np.ndarray:
        return np.clip(np.ceil(time[:, None] * self.rate - 0.5).astype(np.int64), 0, self.totals)

    def sent(self, w: np.ndarray) -> np.ndarray:
        """A row for each window of w, a column for each queue; the rows sum to w * window, or to the total at the end."""
        goal = np.minimum(w * self.window, self.total)
        lo, hi = np.zeros(len(w)), np.full(len(w), self.last)
        for _ in range(90):
            mid = (lo + hi) / 2
            under = self.sent_by(mid).sum(1) <= goal
            lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
        a, b = self.sent_by(lo), self.sent_by(hi)
        room = b - a  # tokens due at one and the same time, in the order of the queues
        left = (goal - a.sum(1))[:, None] - (np.cumsum(room, 1) - room)
        return a + np.clip(left, 0, room)

    def window_of(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The window of token `at` of queue q, or one beside it."""
        return self.sent_by((at + 0.5) / self.rate[q]).sum(1) // self.window


def pack(docs: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 1, window_sequences: int = 32, proportions: dict[str | None, float] | None = None, with_ids: bool = False, max_queues: int = MAX_QUEUES) -> DataFrame:
    """Packs docs(doc_id, text, source) into sequences of at most max_len tokens; a row for each piece of a document.

    Every window of window_sequences sequences holds the sources in `proportions` (source -> weight; default: the corpus's own,
    so that all windows look alike to the end). A source that runs out leaves its share to the others.
    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source_queue and, if with_ids, ids.
    """
    source = F.col("source").cast("string")
    queue = F.when(source.isNotNull(), F.concat(F.lit("="), source)).otherwise("null")
    n_sources = docs.select(source.alias("s")).distinct().limit(max_queues + 1).count()
    if n_sources > max_queues:
        tail = max(1, min(TAIL_QUEUES, max_queues // 2))
        own = [s for s in proportions or () if s is not None]
        if not own:
            size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
            largest = docs.where(source.isNotNull()).groupBy(source.alias("s")).agg(size.alias("n")).orderBy(F.desc("n"), "s").limit(max_queues - tail - 1)
            own = [r.s for r in largest.collect()]  # at most max_queues rows
        shared = F.concat(F.lit("#"), F.pmod(F.xxhash64(source), F.lit(tail)).cast("string"))
        queue = F.when(source.isNull() | source.isin(own), queue).otherwise(shared)
    if encoder(tokenizer) is None:
        raise ValueError(tokenizer)
    wide = _vocabulary(tokenizer, end_id) > 65_536
    tokens = materialize(tokenize(docs.select("doc_id", "text", queue.alias("queue")), tokenizer, end_id, wide), "packing-tokens")

    parts = tokens.groupBy("queue", "part").agg(F.sum("n_tokens").alias("part_tokens"))
    totals = {r.queue: r.n for r in parts.groupBy("queue").agg(F.sum("part_tokens").alias("n")).collect()}  # a row for each queue
    names = sorted(totals)
    weight = lambda q: (proportions or {}).get(None if q == "null" else q[1:], 0.0) if proportions else totals[q]
    weights = np.array([max(float(weight(q)), 1e-9 * max(1, sum((proportions or {}).values()))) for q in names], float)
    number = {q: i for i, q in enumerate(names)}
    sizes = np.array([totals[q] for q in names], np.int64)
    window, kind = window_sequences * max_len, "<u4" if wide else "<u2"
    # a part's start in its queue: a running sum over parts, a row each, not over documents
    base = materialize(parts.select("queue", "part", (F.sum("part_tokens").over(Window.partitionBy("queue").orderBy("part")) - F.col("part_tokens")).alias("base")), "packing-base")

    def cut(batches):
        plan = Schedule(sizes, weights, window)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, doc, q = batch.column("ids"), batch.column("doc_id"), np.array([number[x] for x in batch.column("queue").to_pylist()])
            n = batch.column("n_tokens").to_numpy()
            first = batch.column("base").to_numpy() + batch.column("local_off").to_numpy()
            w0, w1 = np.maximum(plan.window_of(q, first) - 1, 0), plan.window_of(q, first + n - 1) + 2
            for lo in range(0, len(n), 256):
                part = slice(lo, lo + 256)
                known = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(w0[part], w1[part], strict=True)]))
                sent = plan.sent(known)
                rows: list[tuple] = []
                for i in range(lo, min(lo + 256, len(n))):
                    raw, own = np.frombuffer(ids[i].as_py(), kind), sent[:, q[i]]
                    k = int(np.searchsorted(own, first[i], "right")) - 1
                    at, end = int(first[i]), int(first[i] + n[i])
                    while at < end:
                        if at >= own[k + 1]:
                            k += 1
                            continue
                        begun = sent[k], sent[k + 1]
                        off = int((begun[1][: q[i]] - begun[0][: q[i]]).sum()) + at - int(own[k])
                        take = min(end, int(own[k + 1])) - at
                        while take:
                            m = min(take, max_len - off % max_len)
                            piece = raw[at - first[i] : at - first[i] + m].astype("<u4")
                            rows.append((doc[i].as_py(), at - int(first[i]), m, zlib.crc32(piece.tobytes()), int(n[i]), int(known[k]) * window_sequences + off // max_len, off % max_len, names[q[i]], piece.astype(kind).tobytes() if with_ids else None))
                            at, off, take = at + m, off + m, take - m
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 7 + [pa.string()] + [pa.binary()] * with_ids
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=[*COLUMNS, "source_queue", *["ids"] * with_ids])
                yield out

    return tokens.join(base, ["queue", "part"]).select("doc_id", "queue", "n_tokens", "local_off", "base", "ids").mapInArrow(cut, ", ".join(f"{c} long" for c in COLUMNS) + ", source_queue string" + ", ids binary" * with_ids)


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _vocabulary(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
