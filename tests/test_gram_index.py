import random
import re

import pytest
from pyspark.sql import functions as F

from stacklight.operators import gram_index, search

SCHEMA = "id long, source_id int, title string, authors array<string>, isbns array<string>, deleted_at timestamp"


def grams(text):
    return [f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", (text or "").lower()) for i in range(len(w) + 1)]


def catalogue(rng, n=120):
    word = lambda: "".join(rng.choices("abcde", k=rng.randrange(1, 6)))
    rows = [(i, i % 3, " ".join(["the", *(word() for _ in range(rng.randrange(6)))]), [word() for _ in range(rng.randrange(3))], [], None) for i in range(n)]
    return [*rows, (900, 0, None, None, None, None), (901, 0, "", [], [], None), (902, 1, "the the", ["the"], [], None)]


@pytest.fixture(scope="module")
def works(spark):
    return spark.createDataFrame(catalogue(random.Random(4)), SCHEMA)


@pytest.mark.parametrize("list_rows", [4096, 5])
def test_candidates_by_brute_force(spark, works, monkeypatch, list_rows):
    monkeypatch.setattr(gram_index, "LIST_ROWS", list_rows)
    index = gram_index.build(works.union(spark.createDataFrame([(950, 1, "the deleted", [], [], None)], SCHEMA).withColumn("deleted_at", F.current_timestamp())), buckets=3)
    queries = ["the", "the abcde", "abc dea", "zzz the", "", None, "q", "eeee ed the the", *(r.title for r in works.where("id % 9 = 0").collect())]
    asked = spark.createDataFrame([(q,) for q in queries], "query string").repartition(2)
    for least in (0.1, 0.3, 0.45, 1.0):
        want = set()
        for q in {q for q in queries if q}:
            own = set(grams(q))
            for r in works.collect():
                for field, text in (("title", r.title), ("authors", " ".join(r.authors or []))):
                    g = set(grams(text))
                    if own & g and len(own & g) >= least * len(own):
                        want.add((q, r.id, field, len(own & g), len(g), len(own)))
        got = [(r["query"], r.id, r.field, r.shared, r.n, r.n_query) for r in search.trigram_candidates(asked, index, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_only_rare_grams_are_looked_up(spark, works):
    index = gram_index.build(works, buckets=2)
    q = gram_index.asked(spark.createDataFrame([("the abcde",)], "query string"))
    df = {r.gram: r.df for r in index.frequencies.collect()}
    looked = {r.gram for r in gram_index.rare_grams(q, index, 0.45).collect()}
    every = grams("the abcde")
    rarest = sorted(every, key=lambda g: (df.get(g, 0), g))[: len(every) - 5 + 1]  # a field must hold 5 of the 10
    assert looked == {g for g in rarest if g in df} and "  t" not in looked
    found = gram_index.candidates(q, index, 0.45)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # what is dealt anew are the search's own rows: the lists' buckets stay where they are
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan or plan.count("BroadcastHashJoin") >= 2


def test_a_search_with_a_kept_index(spark, works):
    index = gram_index.build(works)
    asked = spark.createDataFrame([("the abcde",), ("abc dea",), (works.first().title,)], "query string")
    key = lambda df: sorted(map(tuple, df.collect()))
    for source in (None, 1):
        assert key(search.search_exact(asked, works, source_id=source, index=index)) == key(search.search_exact(asked, works, source_id=source))
    some = search.search_exact(asked, works, source_id=1, index=index).collect()
    sources = {r.id: r.source_id for r in works.collect()}
    assert some and all(sources[r.id] == 1 for r in some)
    empty = gram_index.build(works.limit(0))
    assert search.search_exact(asked, works.limit(0), index=empty).collect() == []
