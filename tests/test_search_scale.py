from pyspark.sql import functions as F

from stacklight.operators import gram_index, search, state


def test_candidates_are_scored_once_over_all_tasks(spark, monkeypatch):
    titles = [f"harbour lights of town {i}" for i in range(40)]
    works = spark.createDataFrame([(i, t, ["Orvane, Tilda"], [], None) for i, t in enumerate(titles)], "id long, title string, authors array<string>, isbns array<string>, deleted_at timestamp")
    index, queries = gram_index.build(works), spark.createDataFrame([(t,) for t in titles], "query string")
    found = gram_index.candidates(gram_index.asked(queries), index, 0.45)
    # a few rows, but as many tasks as there are
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    written, write = [], state.checkpoint
    monkeypatch.setattr(search, "checkpoint", lambda df, name: (written.append(name), write(df, name))[1], raising=False)
    got = search.search_exact(queries, works, index=index)
    assert written == ["scored"] and "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.query: r.id for r in got.where("rank = 1").collect()} == {t: i for i, t in enumerate(titles)}
