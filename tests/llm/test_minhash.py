import random

import numpy as np

from stacklight.llm import minhash
from stacklight.llm.components import connected_components

from . import brute
from .util import EDGE, docs


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(n // 6):
        base = [word() for _ in range(rng.choice([4, 6, 40, 300]))]
        for k in range(6):
            w = list(base)
            for _ in range(k * len(w) // 40):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w).upper() if k % 2 else "\n".join(w))
    return list(enumerate(out, 10))


def verify(spark, texts, **options):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, texts).repartition(3), **options).collect()}
    assert got == brute.near_duplicates(texts)


def test_brute_force(spark):
    verify(spark, corpus())


def test_clusters_in_tiles(spark):
    # single words that all texts share tie them to a few clusters, with sets of one to hundreds of shingles
    texts = corpus(36, 5) + [(1000 + i, " ".join(["same old line of words"] * 3 + [f"w{i // 2}", *"abcdefgh"[: i % 7]])) for i in range(30)]
    verify(spark, texts, rows=1, least_block=1, most_block=700)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    b = np.concatenate([a[:600], rng.integers(0, 1 << 63, 300, dtype=np.uint64)])
    h = minhash.superminhash([a, b, a[:7]], 2048)
    assert abs((h[0] == h[1]).mean() - 600 / 1200) < 0.05
    assert (h[2] < np.iinfo(np.uint64).max).all()
    assert (minhash.superminhash([a], 240) == minhash.superminhash([a[:7], a], 240)[1]).all()


def test_linked_sizes_meet_in_a_tile(spark):
    n = list(range(1, 400, 3))
    dealt = minhash.tiles(spark.createDataFrame([(7, i, x) for i, x in enumerate(n)], "cluster long, rep long, n long"), 75, 1, 4000, 6).collect()
    tile = {r.rep: set(r.tile) for r in dealt}
    assert all(tile[i] & tile[j] for i, x in enumerate(n) for j, y in enumerate(n) if i != j and min(x, y) >= 0.75 * max(x, y))
    assert sum(bool(tile[i] & tile[j]) for i in tile for j in tile) < 0.6 * len(n) ** 2


def test_exact_groups_chain():
    sets = [np.arange(i, i + 20, dtype=np.uint64) for i in range(0, 30, 2)] + [np.arange(500, 510, dtype=np.uint64)]
    assert minhash.exact_groups(list(range(16)), sets, 75) == [0] * 15 + [15]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_edge_cases(spark):
    got = minhash.near_duplicates(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[7].n_shingles == 0 and by[2].component_id == 2 and by[2].kept
    assert by[5].component_id == 4 and not by[5].kept and by[3].n_shingles == 1
    assert by[None].component_id is None and not by[None].kept
    assert minhash.near_duplicates(docs(spark, [])).collect() == []


def test_very_long_texts(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(120_000)]
    near = list(words)
    near[::100] = ["other"] * len(near[::100])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:60_000]))])).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
