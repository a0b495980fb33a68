import numpy as np
import pytest

from stacklight.operators import factors


def brute(rows, start, rounds, lam):
    """rows: (patron, work, c); start: {work: vector}. The normal equations of each vertex as a whole matrix."""
    patrons, works = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    c = np.ones((len(patrons), len(works)))
    p = np.zeros_like(c)
    for u, i, w in rows:
        c[patrons.index(u), works.index(i)], p[patrons.index(u), works.index(i)] = w, 1
    y = np.array([start[i] for i in works])
    k = y.shape[1]
    side = lambda y, c, p: np.array([np.linalg.solve(y.T @ np.diag(cu) @ y + lam * np.eye(k), y.T @ (cu * pu)) for cu, pu in zip(c, p, strict=True)])
    for _ in range(rounds):
        x = side(y, c, p)
        y = side(x, c.T, p.T)
    return dict(zip(works, y, strict=True))


@pytest.mark.parametrize("part_rows", [4096, 3])
def test_rounds_by_brute_force(spark, monkeypatch, part_rows):
    monkeypatch.setattr(factors, "PART_ROWS", part_rows)
    rng = np.random.default_rng(3)
    rows = [(u, i, float(rng.integers(2, 40))) for u in range(12) for i in range(9) if rng.random() < 0.4 or u == 0]
    df = spark.createDataFrame(rows, "patron long, work long, c double").repartition(3)
    start = {r.id: r.vector for r in factors.start_vectors(df.selectExpr("work AS id").distinct(), 3, 7).collect()}
    assert all(0 < x < 1 / 3 for v in start.values() for x in v) and len({tuple(v) for v in start.values()}) == len(start)
    got = {r.id: r.vector for r in factors.alternate(df, 3, 3, 0.1, 7).collect()}
    want = brute(rows, start, 3, 0.1)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i].tolist(), abs=1e-9) for i in want)


def test_no_rows(spark):
    assert factors.alternate(spark.createDataFrame([], "patron long, work long, c double"), 2, 1).collect() == []
