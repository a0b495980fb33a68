import random

import pytest

from stacklight.llm import suffix_dedup

from . import brute
from .util import EDGE, docs


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    shared = [text(n) for n in (79, 90, 130, 400)]
    out = [text(rng.randrange(300)) + rng.choice(shared) + text(rng.randrange(100)) + rng.choice(shared) for _ in range(25)]
    out += ["a" * 500, "ab" * 200, "a" * 90, out[0], out[0], out[1][:200], text(50), "", None, "xyz" + "q" * 81, "q" * 80]
    return out


@pytest.mark.parametrize("options", [{}, {"batch": 3}, {"group_limit": 1}])
def test_brute_force(spark, options):
    texts = corpus(len(options) + 7)
    rows = suffix_dedup.remove_repeats(docs(spark, list(enumerate(texts))).repartition(3), length=80, **options).collect()
    want = brute.remove_repeats(texts, 80)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_a_hot_passage_among_many_contexts(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    line, tail = text(75), text(40)
    texts = [f"{text(60)}{line}{rng.choice(['', tail])}{text(60)}" for _ in range(60)]
    want = brute.remove_repeats(texts, 80)
    for limit in (4,):
        rows = suffix_dedup.remove_repeats(docs(spark, list(enumerate(texts))).repartition(3), length=80, group_limit=limit).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == dict(enumerate(want))


def test_short_runs_stay_by_their_words(spark):
    run = " ".join(f"w{i:02}" for i in range(30))
    texts = [f"a {run} b", f"c {run} d", "x" * 150 + "1", "x" * 150 + "2", f"e {run[:100]} f"]
    rows = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs(spark, list(enumerate(texts))), length=80, least_words=28, sure_bytes=140).collect()}
    assert rows == {0: 121, 1: 121, 2: 150, 3: 150, 4: 0}


def test_contexts_cover_every_string_in_pieces():
    text = corpus(1)[0].encode() + b"z" * 300 + corpus(2)[3].encode()
    for piece in (37, 1 << 20):
        h, _, a, d, k = suffix_dedup.contexts(text, 80, piece=piece)
        assert [i for x, n in zip(a, k, strict=True) for i in range(x, x + n)] == list(range(len(text) - 79))
        assert (d >= 0).all() and (d <= 16).all()


def test_edge_cases(spark):
    rows = suffix_dedup.remove_repeats(docs(spark, EDGE)).collect()
    assert sorted(r.n_bytes for r in rows) == sorted(len((t or "").encode()) for _, t in EDGE) and all(r.n_removed == 0 for r in rows)
    assert suffix_dedup.remove_repeats(docs(spark, [])).collect() == []
    rows = suffix_dedup.remove_repeats(docs(spark, [(1, "x" * 399 + "y"), (1, "x" * 399 + "y"), (2, "x" * 399)])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 400, 400]


def test_very_long_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefgh ", k=1_300_000))
    texts = [long, "x" * 50 + long[1_048_000:1_049_500] + "y" * 50, "z" * 10]
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs(spark, list(enumerate(texts)))).collect()}
    assert rows == {0: (1_300_000, 1500, 1), 1: (1600, 1500, 1), 2: (10, 0, 0)}


@pytest.mark.parametrize("options", [{}, {"group_limit": 1}])
def test_marked_passages_beside_the_removal(spark, options):
    rng = random.Random(11)
    texts = corpus(12)
    text = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    long = text(600)
    texts += [long, long[:450] + text(70) + long[380:], text(30) + long[100:470] + text(30), "b" * 700, "ab" * 450]
    # the two halves repeat with different partners: the whole is marked, but no string of 400 bytes in it repeats
    halves = [text(230), text(230)]
    texts += ["".join(halves), halves[0] + text(40), text(40) + halves[1]]
    rows = suffix_dedup.remove_repeats_and_mark(docs(spark, list(enumerate(texts))).repartition(3), carry=["lang"], mark_bytes=80, mark_words=20, **options).collect()
    removed, marked = brute.remove_repeats(texts, 400), brute.remove_repeats(texts, 80, least_words=20)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == removed[r.doc_id]
        assert (r.carried.n_passages, r.carried.n_passage_bytes, r.carried.lang) == (marked[r.doc_id][2], marked[r.doc_id][1], "en")
    assert removed[len(texts) - 3][1] == 0 and marked[len(texts) - 3][1] >= 460


def test_the_query_marks_passages_just_over_50_words(spark, tmp_path):
    from stacklight.llm import queries

    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(n))
    passages = [words(n) for n in (51, 52, 55, 60)]
    texts = [f"{words(40)} {passages[i % 4]} {words(30)}" for i in range(8)] + [words(120) for _ in range(8)] + [None, ""]
    # phrases of 20 words are shared by clean texts
    phrase = words(20)
    texts += [f"{words(60)} {phrase} {words(60)}" for _ in range(4)]
    docs(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op6_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts) and all(r.n_removed == 0 for r in rows.values())
    assert all((rows[i].n_passages > 0) == (i < 8) for i in rows)
    assert all(rows[i].n_passage_bytes >= len(passages[i % 4]) for i in range(8))


def test_marking_leaves_no_tables_of_its_first_pass(spark):
    import os

    from stacklight.llm import common

    text = " ".join(f"w{i:03}" for i in range(120))
    conf, before = spark.conf.get(common.SHUFFLES_GO), {p for _, p in common._written}
    rows = suffix_dedup.remove_repeats_and_mark(docs(spark, [(1, text), (2, text), (None, "x")]))
    there = {f"{common.shared_dir(spark)}/{n}" for n in os.listdir(common.shared_dir(spark).removeprefix("file://"))}
    there = {p for p in there - before if "/suffix-" in p}
    assert sum("suffix-index" in p for p in there) == 1 and there <= {p for _, p in common._written}
    assert {(r.doc_id, r.n_removed, r.carried.n_passage_bytes) for r in rows.collect()} == {(1, 599, 599), (2, 599, 599), (None, 0, 0)}
    assert spark.conf.get(common.SHUFFLES_GO) == conf
