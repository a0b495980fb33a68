"""Byte-level BPE encoding with a minimal acyclic transducer as its lexicon, and decoding.

A first pass counts the words (pre-tokens) of all texts. The most frequent ones, `size` at most, are merged once and compiled into a
transducer over their bytes: an acyclic automaton whose arcs emit token ids, each as early as its words agree on it, in which
equal states are one, so that words share prefixes and suffixes. Its arrays are one file in the shared folder, which Spark hands to
the executors; their workers map it into memory, so that all of a machine share its pages. A batch's words walk the automaton
together, a byte at a time; words that it doesn't accept are merged exactly, those of a batch side by side.

Words are split by the vocabulary's pattern; a text with characters that this Python doesn't know as assigned is split by the
vocabulary's own library, as Unicode versions differ there. The file's special strings are tokens wherever they stand in a text.

Cases: null and empty texts have no tokens; null ids are carried; equal rows are encoded each; an empty table gives no rows; further
columns are ignored. Whole texts are encoded, and words of any length: a word of n bytes takes n log n steps.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import unicodedata
import uuid
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, store_file

#: Words of the lexicon and the bytes of one; words that a worker counts before it hands them on, or keeps the ids of; no pair's rank.
LEXICON_WORDS, LEXICON_BYTES, HELD_WORDS, NONE = 1 << 17, 64, 400_000, 1 << 30
#: How byte-level vocabularies split texts (fixed value), the commonest case first, by the classes of letters, numbers and space.
PATTERN = r" ?[{L}]+| ?[{N}]+|'(?:[stmd]|re|ve|ll)| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"


@cache
def byte_of() -> dict[str, int]:
    """The bytes by the characters that stand for them in byte-level vocabularies: printable ones for themselves, the others from
    U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _ranges(points: list[int]) -> str:
    """Code points in order as the ranges of a character class."""
    starts = [c for c, last in zip(points, [-2, *points], strict=False) if c != last + 1]
    ends = [c for c, following in zip(points, [*points[1:], -2], strict=True) if c != following - 1]
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(z))}" if z > a else "") for a, z in zip(starts, ends, strict=True))


class Vocabulary:
    """A byte-level BPE file: its merges by id pair, its tokens' bytes, its special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or spec.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"added tokens with conditions: {path}")
        ids, b = model["vocab"], byte_of()
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: t.encode() if any(c not in b for c in t) else bytes(map(b.__getitem__, t)) for t, i in [*ids.items(), *self.special.items()]}
        self.first = [ids[c] for c, _ in sorted(b.items(), key=lambda x: x[1])]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(ids[x], ids[y]): (rank, ids[x + y]) for rank, (x, y) in enumerate(pairs)}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # the same for arrays of pairs: their keys in order, ranks, and what they make; of two bytes a table
        pair = np.array([x << 32 | y for x, y in self.merges], np.int64)
        order = np.argsort(pair)
        self.pairs, self.ranks = np.append(pair[order], np.int64(1) << 62), np.append(order, NONE)
        self.made = np.array([made for _, made in self.merges.values()], np.int64)
        # the classes as ranges, which Python's own expressions look up faster; those of ASCII and of the first 65,536 code points
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        members = {k: [ord(c) for c in regex.findall(kind, every)] for k, kind in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))}
        limited = lambda most: PATTERN.format(**{k: _ranges([c for c in cs if c < most]) for k, cs in members.items()})
        self.plain_word, self.basic_word = re.compile(limited(0x80)), re.compile(limited(0x10000))
        self.word, self.astral = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}", S=r"\s")), re.compile("[\U00010000-\U0010ffff]")
        # what the pattern takes for letters or numbers and this Python doesn't know
        unsure = [c for c in sorted(members["L"] + members["N"]) if unicodedata.category(chr(c)) == "Cn"]
        self.unsure = re.compile(f"[{_ranges(unsure)}]")
        # most texts lie in the widest stretches between, which are faster to tell
        gaps = sorted(((z - a, a + 1, z - 1) for a, z in zip([-1, *unsure], [*unsure, 0x110000], strict=True)), reverse=True)[:8]
        self.beyond = re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" for _, a, z in gaps) + "]")
        self._own = None

    def split(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        if text.isascii():
            return self.plain_word.findall(text)
        if not self.beyond.search(text) or not self.unsure.search(text):
            return (self.word if self.astral.search(text) else self.basic_word).findall(text)
        if self._own is None:
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:z] for _, (a, z) in self._own.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        """The words of a text; every second part of one that holds special strings is such a string."""
        if self.specials is None or not self.specials.search(text):
            return self.split(text)
        out: list[str] = []
        for i, part in enumerate(self.specials.split(text)):
            out += [part] if i % 2 else self.split(part)
        return out

    def merge(self, word: str) -> list[int]:
        """The ids of one word: the pair of lowest rank is merged, of equal ones the leftmost, until none is left."""
        if word in self.special:
            return [self.special[word]]
        ids = [self.first[b] for b in word.encode()]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, made, i, x, y = heapq.heappop(queue)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (m := self.merges.get((ids[left], ids[right]))):
                    heapq.heappush(queue, (m[0], m[1], left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)

    def merge_all(self, words: list[str]) -> list[bytes]:
        """The ids of each word (little-endian, 32 bits), as merge() gives them: in each round every word merges one pair. Special
        strings and long words are merged one by one."""
        out: list[bytes] = [b""] * len(words)
        raw = [w.encode() for w in words]
        short = []
        for i, w in enumerate(words):
            if len(raw[i]) > LEXICON_BYTES or w in self.special:
                out[i] = np.array(self.merge(w), "<u4").tobytes()
            elif w:
                short.append(i)
        word, size = np.array(short, np.int64), np.array([len(raw[i]) for i in short], np.int64)
        ids = np.array(self.first, np.int64)[np.frombuffer(b"".join(raw[i] for i in short), np.uint8)]
        rank = self.rank_of(ids, np.append(ids[1:], 0))
        rank[np.cumsum(size) - 1] = NONE
        while len(word):
            first = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, first)
            done = least == NONE
            if done.any():
                of_done = np.repeat(done, size)
                text, ends = ids[of_done].astype("<u4").tobytes(), np.cumsum(size[done]) * 4
                for i, a, z in zip(word[done].tolist(), (ends - size[done] * 4).tolist(), ends.tolist(), strict=True):
                    out[i] = text[a:z]
                word, size, least, ids, rank = word[~done], size[~done], least[~done], ids[~of_done], rank[~of_done]
                if not len(word):
                    break
                first = np.cumsum(size) - size
            hits = np.flatnonzero(rank == np.repeat(least, size))
            at = hits[np.searchsorted(hits, first)]  # the leftmost of each word
            ids[at] = self.made[least]
            rank[at] = rank[at + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # an id has gone from each word before
            ids, rank, size = ids[keep], rank[keep], size - 1
            last = np.cumsum(size) - 1
            right, left = at[at < last], at[at > last - size + 1] - 1
            rank[right] = self.rank_of(ids[right], ids[right + 1])
            rank[left] = self.rank_of(ids[left], ids[left + 1])
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _agreed(a: tuple, b: tuple) -> int:
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


class _State:
    """A state that may still change: its arcs as [label, target, ids], in the order of their labels."""

    __slots__ = ("arcs", "final", "rest")

    def __init__(self):
        self.arcs, self.final, self.rest = [], False, ()


def compile_lexicon(entries: list[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The file of the minimal transducer of (word, ids), the words being distinct. States are made from the words in order: what the
    next word doesn't share is complete, and a complete state that equals an older one is replaced by that."""
    known: dict[tuple, int] = {}
    states: list[tuple] = []

    def complete(s: _State) -> int:
        form = (s.final, s.rest, tuple(map(tuple, s.arcs)))
        if form not in known:
            known[form] = len(states)
            states.append(form)
        return known[form]

    path, last = [_State()], b""
    for word, ids in sorted(entries):
        shared = _agreed(last, word)
        while len(path) > shared + 1:
            done = complete(path.pop())
            path[-1].arcs[-1][1] = done
        for s in range(shared):
            # the arc keeps the ids that the new word has too; the rest moves on to what follows
            arc, nxt = path[s].arcs[-1], path[s + 1]
            k = _agreed(arc[2], ids)
            if moved := arc[2][k:]:
                arc[2] = arc[2][:k]
                for a in nxt.arcs:
                    a[2] = moved + a[2]
                if nxt.final:
                    nxt.rest = moved + nxt.rest
            ids = ids[k:]
        for b in word[shared:]:
            path[-1].arcs.append([b, -1, ids])
            path.append(_State())
            ids = ()
        path[-1].final, path[-1].rest = True, ids
        last = word
    while len(path) > 1:
        done = complete(path.pop())
        path[-1].arcs[-1][1] = done
    start = complete(path[0])

    pool: dict[tuple, int] = {(): 0}
    number = lambda ids: pool.setdefault(ids, len(pool))
    arcs = [(s << 8 | label, target, number(ids)) for s, (_, _, out) in enumerate(states) for label, target, ids in out]
    final = [number(rest) if done else -1 for done, rest, _ in states]
    ends = np.cumsum([len(x) for x in pool])
    parts = [np.array(x, np.int64).reshape(-1) for x in ([a[0] for a in arcs], [a[1] for a in arcs], [a[2] for a in arcs], final, ends, [i for x in pool for i in x])]
    return np.array([start, *map(len, parts)], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, file: str):
        with open(file, "rb") as f:
            held = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.int64)
        self.start, at = int(held[0]), np.cumsum([7, *held[1:7].tolist()])
        self.keys, self.targets, self.outs, self.final, self.ends, self.ids = (held[a:z] for a, z in zip(at, at[1:], strict=False))

    def look_up(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word (little-endian, 32 bits), None where the lexicon doesn't have it."""
        size = np.array([len(w) for w in words], np.int64)
        text, first = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        state = np.full(len(words), self.start, np.int64)
        emitted = []
        for step in range(int(size.max(initial=0))):
            at = np.flatnonzero((size > step) & (state >= 0))
            if not len(at):
                break
            key = state[at] << 8 | text[first[at] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key if len(self.keys) else np.zeros(len(at), bool)
            state[at] = np.where(ok, self.targets[arc], -1) if len(self.keys) else -1
            emitted.append((at[ok], self.outs[arc[ok]] if len(self.keys) else arc[:0]))
        rest = np.where(state >= 0, self.final[state], -1)
        found = rest >= 0
        emitted.append((np.flatnonzero(found), rest[found]))
        word, out = (np.concatenate(x) for x in zip(*emitted, strict=True))
        keep = found[word] & (out > 0)
        order = np.argsort(word[keep], kind="stable")  # steps are in order already
        word, out = word[keep][order], out[keep][order]
        low, n = self.ends[out - 1], self.ends[out] - self.ends[out - 1]
        ids = self.ids[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype("<u4").tobytes()
        end = np.cumsum(np.bincount(word, n, len(words))).astype(np.int64) * 4
        return [ids[a:z] if ok else None for a, z, ok in zip([0, *end.tolist()], end.tolist(), found.tolist(), strict=False)]


_mapped: dict[str, Lexicon] = {}


def mapped(name: str) -> Lexicon:
    if name not in _mapped:
        _mapped.clear()
        _mapped[name] = Lexicon(SparkFiles.get(name))
    return _mapped[name]


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """word, n: how often each word stands in docs (text); added up in the tasks first."""

    def run(batches):
        words, counts = vocabulary(tokenizer).words, Counter()

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for b in slices(batches):
            for text in b.column("text").to_pylist():
                if text:
                    counts.update(words(text))
            if len(counts) > HELD_WORDS:
                yield emit()
        yield emit()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS) -> str:
    """The name of the file, known to all executors, of the lexicon of docs' `size` most frequent words (ties by the word)."""
    vocabulary(tokenizer)

    def merged(batches):
        v = vocabulary(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(v.merge_all(b.column("word").to_pylist()), pa.binary())], names=["word", "ids"])

    frequent = word_counts(docs, tokenizer).where(F.octet_length("word") <= LEXICON_BYTES).orderBy(F.desc("n"), "word").limit(size)
    rows = frequent.select("word").mapInArrow(merged, "word string, ids binary").collect()  # `size` rows at most
    name = f"bpe-lexicon-{uuid.uuid4().hex}"
    docs.sparkSession.sparkContext.addFile(store_file(docs.sparkSession, name, compile_lexicon([(r.word.encode(), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows])))
    return name


def encode(docs: DataFrame, tokenizer: str, lexicon: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers) of each row of docs (doc_id, text)."""

    def run(batches):
        v, lex = vocabulary(tokenizer), mapped(lexicon)
        known: dict[str, bytes] = {}
        for b in slices(batches):
            texts = [v.words(t) if t else [] for t in b.column("text").to_pylist()]
            new = list(set().union(*texts) - known.keys())
            if len(known) > HELD_WORDS:
                known, new = {}, list(set().union(*texts))
            found = dict(zip(new, lex.look_up([w.encode() for w in new]), strict=True))
            unseen = [w for w, ids in found.items() if ids is None]
            known |= found | dict(zip(unseen, v.merge_all(unseen), strict=True))
            ids = [b"".join(map(known.__getitem__, words)) for words in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with its text; bytes that are no UTF-8 give the replacement character."""

    def run(batches):
        token = vocabulary(tokenizer).bytes
        for b in slices(batches):
            texts = [b"".join(map(token.__getitem__, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_tokens", "ids")), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def round_trip(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids, text: every text encoded and decoded again."""
    return decode(encode(docs, tokenizer, build_lexicon(docs, tokenizer, size)), tokenizer)
