import numpy as np

from stacklight.operators import factors, interactions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_in_solves_many_patrons_at_once(spark, monkeypatch):
    monkeypatch.setattr(interactions, "PARTIAL_SUMS", 20)  # sums are passed on, and read, in pieces
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(12, 3))
    rows = [(str(p), int(w), int(n), 0) for p in range(400) for w, n in zip(rng.choice(15, 1 + p % 6, replace=False), rng.integers(1, 4, 6), strict=False)]
    works = spark.createDataFrame([(w, v.tolist()) for w, v in enumerate(vectors)], "work_id long, vector array<double>")
    got = interactions.fold_in(spark.createDataFrame(rows, "patron_ref string, work_id long, n_loans long, n_renewals long").repartition(3), works)
    assert "FlatMapGroupsInPandas" not in plan(got)  # a call for each patron
    found = {r.patron_ref: r for r in got.collect()}
    known = {}
    for p, w, n, _ in rows:
        if w < 12:
            known.setdefault(p, []).append((vectors[w], n, 1 + n + 4 * (n - 1)))
    assert found.keys() == known.keys()
    for p, own in known.items():
        assert (found[p].n_works, found[p].n_loans) == (len(own), sum(n for _, n, _ in own))
        if len(own) < 3:
            assert found[p].vector is None
            continue
        x = np.linalg.solve(sum(c * np.outer(y, y) for y, _, c in own) + 0.1 * np.eye(3), sum(c * y for y, _, c in own))
        assert np.allclose(found[p].vector, x / np.linalg.norm(x), atol=1e-6)


def test_half_round_in_stacks(spark, monkeypatch):
    monkeypatch.setattr(factors, "PART_ROWS", 6)
    monkeypatch.setattr(factors, "HELD_SUMS", 20)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(9, 2))
    rows = [(p, int(w), float(rng.integers(1, 40))) for p in range(60) for w in rng.choice(9, 1 + p % 9, replace=False)]
    side = factors.dealt(spark.createDataFrame(rows, "patron long, work long, c double"), "patron", "work")
    assert side[1]
    got = {r.id: r.vector for r in factors.solve_side(side, spark.createDataFrame([(w, v.tolist()) for w, v in enumerate(vectors)], "id long, vector array<double>"), 2, 0.1).collect()}
    base = vectors.T @ vectors + 0.1 * np.eye(2)
    for p in range(60):
        own = [(vectors[w], c) for q, w, c in rows if q == p]
        x = np.linalg.solve(base + sum((c - 1) * np.outer(y, y) for y, c in own), sum(c * y for y, c in own))
        assert np.allclose(got[p], x), p


def test_half_round_broadcasts_nothing(spark, monkeypatch):
    plans, write = [], factors.checkpoint
    monkeypatch.setattr(factors, "checkpoint", lambda df, name="checkpoint": (plans.append(plan(df)), write(df, name))[1])
    rows = spark.createDataFrame([(p, w, 2.0) for p in range(6) for w in range(4)], "patron long, work long, c double")
    works = spark.createDataFrame([(w, [1.0, float(w)]) for w in range(4)], "id long, vector array<double>")
    assert factors.solve_side(factors.dealt(rows, "patron", "work"), works, 2, 0.1).count() == 6
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)
