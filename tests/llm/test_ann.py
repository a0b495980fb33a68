import numpy as np
import pytest

from stacklight.llm import ann


def brute(rows, k):
    out = {}
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    for q, v in ok:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in ok if i != q and len(x) == len(v))
            out[q] = d[:k]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 32)).astype(np.float32)
    x[50:80] = x[0]  # copies of a query's vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), lambda i: i % 100 == 0, block_rows=300, query_rows=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute(rows, 10)
    assert set(got) == set(want)
    found = [len({v for _, _, v in got[q]} & {i for _, i in want[q]}) / 10 for q in want]
    assert np.mean(found) >= 0.9
    for hits in got.values():
        assert [r for r, _, _ in sorted(hits)] == list(range(1, 11)) and sorted(hits) == sorted(hits, key=lambda h: (h[1], h[2]))
    assert [v for _, _, v in sorted(got[0])] == list(range(50, 60))


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 40))
    m = ann.Codes(x, 5, 0.9)
    codes = m.encode(x)
    block = ann.Block(codes)
    for radius in (0, 3, 9, 40):
        for q in codes[:20]:
            assert set(block.within(q, radius)) == set(np.flatnonzero(ann.Codes.hamming(q, codes) <= radius))


def test_probes_visit_few_codes_of_clustered_vectors():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(200, 64))[rng.integers(0, 200, 8000)] + 0.1 * rng.normal(size=(8000, 64))).astype(float)
    m = ann.Codes(x[:3000], 10, 0.95)
    probed, near = ann.share(x, x[::100], m)
    assert m.radius < 16 and near <= probed < 0.1
    found = [len(set(np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:11]) & set(ann.Block(m.encode(x)).within(m.encode(x[i : i + 1])[0], m.radius))) / 11 for i in range(0, 8000, 400)]
    assert np.mean(found) >= 0.9


@pytest.mark.parametrize("n", [0, 1, 4])
def test_edge_cases(spark, n):
    rows = [(0, [1.0, 0.0]), (7, [0.5, 0.5]), (8, [0.5, 0.5]), (None, [1.0, 1.0])][:n]
    rows += [(100, None), (200, [0.0, 0.0]), (300, [1.0, None]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0])] if n else []
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").drop("x"), lambda i: i % 100 == 0).collect()]
    assert sorted(got) == ([(0, 1, 7), (0, 2, 8)] if n == 4 else [])


def test_a_dimension_that_the_sample_lacks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4 if i % 50 else 3).tolist()) for i in range(1, 402)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0, k=3, sample_rows=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute(rows, 3)
    assert {q: sorted(v) for q, v in got.items()} == {q: list(enumerate((i for _, i in w), 1)) for q, w in want.items()}
