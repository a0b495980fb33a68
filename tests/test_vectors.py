import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklight.operators import encode, vectors


def rows(spark, x, sources):
    return spark.createDataFrame([(i, v.tolist(), s, i % 3 == 0) for i, (v, s) in enumerate(zip(x, sources, strict=True))], "work_id long, vector array<double>, source_id int, is_title_only boolean")


@pytest.mark.parametrize(("same", "title", "size"), [(True, False, 40), (False, False, 40), (True, True, 7), (False, True, 4096)])
def test_nearest_by_brute_force(spark, monkeypatch, same, title, size):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", size)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    x[100:140] = x[7]  # ties
    sources = [None if i % 50 == 49 else 0 if i % 3 else i % 7 for i in range(300)]
    e = rows(spark, x, sources).union(spark.createDataFrame([(900, None, 0, False)], "work_id long, vector array<double>, source_id int, is_title_only boolean")).repartition(3)
    probes = e.where("work_id % 7 = 0 and vector is not null").select(F.col("work_id").alias("probe"), F.col("vector").alias("probe_vector"), F.col("source_id").alias("probe_source"), F.when(F.col("work_id") % 14 == 0, F.array(F.lit(101).cast("long"), F.lit(3).cast("long"))).alias("shown"))
    got = {}
    for r in vectors.nearest(probes, e, 5, same_source=same, exclude_title_only=title).collect():
        got.setdefault(r.probe, []).append((r["rank"], r.work_id))
    want = {}
    for p in range(0, 300, 7):
        fit = [i for i in range(300) if i != p and not (title and i % 3 == 0) and not (p % 14 == 0 and i in (101, 3)) and (not same or (sources[p] is not None and sources[i] == sources[p]))]
        best = sorted(fit, key=lambda i: (-(x[i] * x[p]).sum(), i))[:5]
        if best:
            want[p] = list(enumerate(best, 1))
    assert {p: sorted(v) for p, v in got.items()} == want


def test_blocks_are_packed_once(spark, monkeypatch):
    e = rows(spark, np.eye(6), [0, 0, 1, 1, 0, 2]).withColumn("at", F.col("work_id"))
    packed = []
    monkeypatch.setattr(vectors, "blocks_of", lambda df, plain=vectors.blocks_of: packed.append(1) or plain(df))
    cache = vectors.VectorCache()
    first = cache.blocks("a", e, "at")
    assert cache.blocks("a", e, "at") is first and packed == [1] and first.n == 6
    p = e.where("work_id = 1").select(F.col("work_id").alias("probe"), F.col("vector").alias("probe_vector"), F.col("source_id").alias("probe_source"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(vectors.nearest(p, first, 3)) == key(vectors.nearest(p, e, 3))
    more = e.union(e.where("work_id = 5").withColumn("work_id", F.lit(9).cast("long")).withColumn("at", F.lit(9).cast("long")))
    assert cache.blocks("a", more, "at").n == 7
    # a vector that changes without a new count
    assert cache.blocks("a", more.withColumn("at", F.col("at") + 1), "at") is not first and len([b for b in packed if b]) >= 3


def test_nearest_of_nothing(spark):
    e = rows(spark, np.ones((2, 2)), [1, 1])
    p = e.select(F.col("work_id").alias("probe"), F.col("vector").alias("probe_vector"), F.col("source_id").alias("probe_source"))
    assert vectors.nearest(p.limit(0), e, 3).collect() == [] and vectors.nearest(p, e.limit(0), 3).collect() == []


def test_encode_works(spark):
    def load():
        def encode(texts):
            hidden = np.array([[[len(t), 1.0], [1.0, t.count(" ") + 1.0], [9.0, 9.0]] for t in texts])
            return hidden, np.array([[1, 1, 0]] * len(texts))

        return encode

    works = spark.createDataFrame([(1, "ab", None, ["s"], None, None, "h"), (2, "abc d", "", None, "long text", " ", "i"), (3, "x", None, None, None, None, "j")], "id long, title string, title_alternate string, subjects array<string>, summary string, contents string, content_hash string")
    got = {r.work_id: r for r in encode.encode_works(works, load, "m", batch=2).collect()}

    def unit(v):
        return np.array(v) / np.linalg.norm(v)

    one = lambda t: unit([(len(t) + 1) / 2, (t.count(" ") + 2) / 2])
    assert got[1].vector == pytest.approx(one("ab. s").tolist(), abs=1e-6) and not got[1].is_title_only and got[3].is_title_only
    assert got[2].vector == pytest.approx(unit((one("abc d") + one("long text")) / 2).tolist(), abs=1e-6)
    assert (got[1].dimensions, got[1].model, got[1].source_hash) == (2, "m", "h")
