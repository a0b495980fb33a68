import itertools
import random

from stacklight.llm import chunk_dedup

from .util import EDGE, docs


def gear_cuts(text, least, most, bits):
    """The rolling form, a byte at a time."""
    h, last, out = 0, 0, []
    for i, b in enumerate(text, 1):
        h = (2 * h + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        if i - last >= most or (i - last >= least and h < 1 << (32 - bits)):
            out.append(i)
            last = i
    return out + [len(text)] * (last < len(text))


def corpus():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = text(900)
    return [text(rng.randrange(700)) + shared + text(rng.randrange(300)) for _ in range(20)] + ["a" * 5000, "", None, "short", "short", text(3)]


def test_cuts_roll():
    for t in corpus():
        t = (t or "").encode()
        assert chunk_dedup.cuts(t, 32, 256, 5).tolist() == gear_cuts(t, 32, 256, 5)


def test_brute_force(spark):
    texts = corpus()
    got = {r.doc_id: r for r in chunk_dedup.remove_repeated_chunks(docs(spark, list(enumerate(texts))).repartition(3)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        t = (t or "").encode()
        ends = gear_cuts(t, chunk_dedup.LEAST, chunk_dedup.MOST, chunk_dedup.BITS)
        chunks = [t[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=False)]
        flags = []
        for c in chunks:
            flags.append(c in seen)
            seen.add(c)
        kept = []
        for again, run in itertools.groupby(zip(flags, chunks, strict=True), key=lambda x: x[0]):
            part = b"".join(c for _, c in run)
            if not again or (len(part) < chunk_dedup.LEAST_RUN and part != t):
                kept.append(part)
        assert bytes(got[i].kept) == b"".join(kept) and got[i].n_bytes == len(t) and got[i].n_chunks == len(ends)
    assert sum(got[i].n_removed > 500 for i in range(1, 20)) == 19  # the shared passage goes, shifted as it is


def test_edge_cases(spark):
    rows = chunk_dedup.remove_repeated_chunks(docs(spark, EDGE)).collect()
    assert len(rows) == len(EDGE) and sum(bytes(r.kept) == b"same text here" for r in rows) == 1
    assert chunk_dedup.remove_repeated_chunks(docs(spark, [])).collect() == []


def test_passages_just_over_50_words(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    stock = prose(12)  # some 60 bytes that every text holds
    texts = [f"{prose(rng.randrange(60, 90))} {stock} {prose(rng.randrange(20, 90))}" for _ in range(60)]
    passages = [prose(rng.randrange(51, 57)) for _ in range(40)]
    planted = [f"{prose(rng.randrange(20, 90))} {p} {prose(rng.randrange(20, 90))}" for p in passages for _ in range(3)]
    got = {r.doc_id: r for r in chunk_dedup.remove_repeated_chunks(docs(spark, list(enumerate(texts + planted))).repartition(3)).collect()}
    later = [got[60 + i] for i in range(len(planted)) if i % 3]
    assert sum(r.n_removed > 0 for r in later) >= 0.98 * len(later)
    assert sum(got[i].n_removed == 0 for i in range(60)) == 60
    assert all(got[60 + i].n_removed == 0 for i in range(0, len(planted), 3))  # the first copy stays
