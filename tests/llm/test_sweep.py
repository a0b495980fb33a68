import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stacklight.llm import sweep

SCHEMA = "key int, start long, end long, value long, at string, node long"


def brute(rows, everything=None):
    """rows: (key, start, end, value); every moment by a look at all intervals."""
    valid = [(k, s, e, v or 0) for k, s, e, v in rows if s is not None and (e is None or e > s)]
    groups = {}
    for r in valid:
        for k in [*([r[0]] if r[0] is not None else []), *([everything] if everything is not None else [])]:
            groups.setdefault(k, []).append(r[1:])
    out = []
    for k, own in groups.items():
        kept, last = [], (0, 0)
        for t in sorted({t for s, e, _ in own for t in (s, e) if t is not None}):
            state = [v for s, e, v in own if s <= t and (e is None or t < e)]
            if (now := (len(state), sum(state))) != last:
                kept.append((t, *now))
                last = now
        top = max((v for _, _, v in kept), default=None)
        for i, (t, n, v) in enumerate(kept):
            out.append((k, t, n, v, kept[i + 1][0] if i + 1 < len(kept) else None, max(n for _, n, _ in kept[: i + 1]), v == top))
    return sorted(out)


def run(spark, rows, everything=None):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in sweep.concurrency(df, everything).collect())


@pytest.mark.parametrize("span", [3, 40, 6000])
def test_against_brute_force(spark, span, monkeypatch):
    monkeypatch.setattr(sweep, "BLOCK_BITS", 3)  # many blocks
    rng = random.Random(span)
    rows = []
    for _ in range(250):
        s = rng.randrange(-span, span)
        rows.append((rng.choice([1, 1, 1, 2, 7]), s, rng.choice([None, s + rng.randrange(-1, span), s + 1, span]), rng.choice([None, 0, 5, -3, 10**12])))
    assert run(spark, rows, -2) == brute(rows, -2)


def test_edge_cases(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 5, 1), (1, 5, 5, 1), (1, 6, 5, 1)], -2) == []
    rows = [(1, 0, 5, 2), (1, 0, 5, 2), (1, 5, 9, 2), (1, 5, 9, 2), (None, 3, None, None)]
    assert run(spark, rows, -2) == brute(rows, -2)
    # two end as two of the same value start: the key's state doesn't change
    assert [r[1] for r in run(spark, rows)] == [0, 9]
    assert run(spark, [(4, 77, None, 1)]) == [(4, 77, 1, 1, None, 1, True)]


def test_a_node_stands_for_its_span(spark):
    rows = [(1, s, e, 1) for s in range(0, 16) for e in [*range(s + 1, 17), None]]
    df = spark.createDataFrame([(k, s, e, v) for k, s, e, v in rows], "key int, first long, last long, value long")
    for _, s, e, _ in rows[::11]:
        nodes = [r.node for r in sweep.node_sums(df.where((F.col("first") == s) & F.col("last").eqNullSafe(F.lit(e).cast("long"))), 4).collect()]
        leaves = [x for n in nodes for x in range(16) if (x + 16) >> ((x + 16).bit_length() - n.bit_length()) == n]
        assert sorted(leaves) == list(range(s, min(e or 16, 16))) and len(nodes) <= 8


def test_sales(spark):
    day = lambda d, s=0: datetime(2024, 1, d, 10, 0, s)
    sales = spark.createDataFrame([(1, 5, 10.005, day(1, 59)), (2, 5, None, day(2)), (3, 99, float("nan"), day(3)), (4, None, 1.0, None), (None, 6, 2.0, day(3)), (5, 5, 3.0, day(30))], "sale_id long, client_id long, total double, sold_at timestamp_ntz")
    lines = spark.createDataFrame([(1, day(4, 30)), (1, day(2, 1)), (1, None), (2, None), (5, day(1)), (None, day(1))], "sale_id long, shipped_at timestamp_ntz")
    clients = spark.createDataFrame([(5, 3, "x"), (5, 2, "x"), (6, None, "y"), (None, 1, "z")], "client_id long, nation_id int, start string")
    got = {(r.key, r.start, r.end, r.value) for r in sweep.open_sales(sales, lines, clients).collect()}
    minute = lambda d: 28401120 + (d - 1) * 1440 + 600
    assert minute(1) * 60 == int(datetime.fromisoformat("2024-01-01T10:00:00+00:00").timestamp())
    assert got == {(2, minute(1), minute(9), 1001), (2, minute(2), None, None), (-1, minute(3), None, None), (-1, minute(3), None, 200)}
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert {(r.key, r.start, r.end, r.value) for r in sweep.open_sales(sales, lines, clients).collect()} == got
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
