import re

from stacklight.operators import catalog
from stacklight.plans import adapters as A
from stacklight.plans import catalogue_queries as Q

SMALL = "/root/testdata/sf0.001"


def live(spark):
    return catalog.live(A.works(spark, SMALL)).collect()


def grams(text):
    return {f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", text.lower()) for i in range(len(w) + 1)}


def test_trigram_candidates_of_all_stated_works(spark):
    works = live(spark)
    want = set()
    for query in {w.title for w in works if w.id % 20 == 0}:
        q = grams(query)
        for w in works:
            for field, text in (("title", w.title), ("authors", " ".join(w.authors))):
                g = grams(text)
                if g & q and len(g & q) >= 0.3 * len(q):
                    want.add((query, w.id, field, len(g), len(q), len(g & q)))
    got = [(r["query"], r.id, r.field, r.n, r.n_query, r.shared) for r in Q.trigram_candidates(spark, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_search_exact_takes_the_stated_works(spark):
    stated = {i: w.id for w in live(spark) if w.id % 20 == 0 for i in w.isbns[:1]}
    hits = {r["query"]: r.id for r in Q.search_exact(spark, SMALL).where("score = 1.0").collect()}
    assert stated and stated.items() <= hits.items()
