from pyspark.sql import functions as F

from stacklight.operators import evaluation


def test_shared_isbns_and_popular_patrons(spark):
    works = spark.createDataFrame([(1, ["a", "a", "b"], None), (2, ["b"], None), (3, ["b", "c"], None), (4, ["c"], "gone"), (5, None, None)], "id long, isbns array<string>, deleted_at string")
    assert [tuple(r) for r in evaluation.shared_isbns(works).collect()] == [("b", 3)]
    loans = spark.createDataFrame([("p", 1), ("p", 1), ("q", 1), ("q", 2), ("r", 1), ("r", 2), ("s", 9)], "patron_ref string, work_id long")
    factors = spark.createDataFrame([(1,), (2,)], "work_id long")
    assert [tuple(r) for r in evaluation.popular_patrons(loans, factors).collect()] == [("q", 2), ("r", 2)]


def test_agreement(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 12, 2)], "probe long, work_id long, rank int")
    b = spark.createDataFrame([(1, 10, 1), (1, 12, 2), (2, 12, 1), (2, 10, 2)], "probe long, work_id long, rank int")
    assert tuple(evaluation.agreement(a, b, 2).first()) == (2, 0.75, 0.5)


def test_sample_does_not_depend_on_partitions(spark):
    rows = spark.range(500)
    draw = lambda r: {x.id for x in evaluation.sample(r, 20, 3, "id").collect()}
    assert len(draw(rows)) == 20 and draw(rows) == draw(rows.repartition(7))


def test_loan_plan(spark):
    works = spark.range(400).select("id", F.array(F.concat(F.lit("t"), F.col("id") % 5, F.lit(" -- x"))).alias("subjects"), F.lit(None).cast("string").alias("deleted_at"))
    plan = evaluation.loan_plan(works, 200).toPandas()
    assert plan.patron.nunique() == 200 and not plan.duplicated(["patron", "work_id"]).any()
    assert 0.15 < plan.renewed.mean() < 0.35 and 0.78 < plan.returned.mean() < 0.92
    assert (plan.repeated <= plan.returned).all() and plan.groupby("patron").size().max() <= 50
    assert plan.work_id.value_counts().iloc[0] > 3 * plan.work_id.value_counts().median()
    assert not evaluation.loan_plan(works.where("id < 0"), 5).count()


def test_co_borrow_gap(spark):
    factors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])], "work_id long, factors array<float>")
    loans = spark.createDataFrame([("p", 1), ("p", 1), ("p", 2), ("q", 2), ("q", 1), ("q", 9), (None, 3), (None, 4)], "patron_ref string, work_id long")
    linked, mean, other, gap = evaluation.co_borrow_gap(loans, factors).first()
    assert linked == 1 and abs(mean - 0.6) < 1e-6 and abs(other - (0.0 - 1.0 + 0.8 - 0.6 + 0.0) / 5) < 1e-6 and abs(gap - mean + other) < 1e-9
    none = evaluation.co_borrow_gap(loans.limit(0), factors.limit(0)).first()
    assert none.linked_pairs == 0 and none.linked_mean is None and none.gap is None
