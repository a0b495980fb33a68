"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_duplicates(docs, percent=75):
    """docs: [(doc_id, text)] with distinct ids -> {doc_id: (n_shingles, component_id)}"""
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        k = min(5, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    inv = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inv[x].append(d)
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for d, s in sets.items():
        inter = defaultdict(int)
        for x in s:
            for o in inv[x]:
                inter[o] += 1
        for o, n in inter.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = sorted((root(d), root(o)))
                up[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def remove_repeats(texts, length=400, least_words=0):
    """texts: list of str or None -> [(n_bytes, n_removed, n_spans, kept)]; runs under 400 bytes and least_words words stay"""
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[hashlib.blake2b(b[i : i + length], digest_size=16).digest()] += 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[hashlib.blake2b(b[i : i + length], digest_size=16).digest()] > 1:
                gone[i : i + length] = b"\x01" * length
        for run in re.finditer(rb"\x01+", bytes(gone)):
            if run.end() - run.start() < 400 and len(b[run.start() : run.end()].split()) < least_words:
                gone[run.start() : run.end()] = bytes(run.end() - run.start())
        out.append((len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def contamination(docs, bench, window=10):
    """docs, bench: [(id, text)] -> [(doc_id, n_words, n_hit, items)]"""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    wins = defaultdict(set)
    for i, t in bench:
        w = words(t)
        if w and i is not None:
            for k in range(max(1, len(w) - window + 1)):
                wins[tuple(w[k : k + window])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    items |= wins[x]
        out.append((d, len(w), len(hit), sorted(items)))
    return out
