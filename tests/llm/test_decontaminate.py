import hashlib
import random

from stacklight.llm import decontaminate

from . import brute
from .util import EDGE, docs

BENCH = "item_id long, text string, segment string"


def verify(spark, texts, items, **options):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], BENCH)
    got = {r.doc_id: r for r in decontaminate.contamination(docs(spark, texts).repartition(2), bench, **options).collect()}
    for d, n, hit, found in brute.contamination(texts, items):
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "Alpha", "beta", "x1", "é", "zz"])
    texts = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(40)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(14)))) for i in range(30)]
    items += [(2, None), (3, "the of"), (11, texts[5][1]), (12, texts[7][1].upper()), (13, "the " * 30), (None, "the of the"), (14, "never seen")]
    texts += [(100, texts[5][1] + "!" + texts[7][1]), (101, "the " * 200)]
    verify(spark, texts, items)
    verify(spark, texts, items, segment_words=50)


def test_blocks_of_windows(spark):
    texts = [(1, "a b c d e f g h i j k l m n o"), (2, "k l m n o p q r s t u")]
    index = decontaminate.build_index(docs(spark, texts))
    bench = spark.createDataFrame([(7, "a b c d e f g h i j k"), (8, "f g h i j k l m n o"), (9, "l m n o p q r s t u")], "item_id long, text string")
    found = decontaminate.find(index, bench, block_words=1).collect()
    assert sorted((r.item_id, len(r.spans)) for r in found) == [("7", 2), ("8", 1), ("9", 1)]


def test_proximity(spark):
    index = decontaminate.build_index(docs(spark, [(1, "a x b y c z"), (2, "a b x y z c"), (3, "c b a")]))
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = lambda slop: sorted((r.doc, [(s.start, s.end) for s in r.spans]) for r in decontaminate.find(index, bench, slop=slop).collect())
    assert [s for _, s in got(2)] == [[(0, 5)]]
    assert [s for _, s in got(3)] == [[(0, 5)], [(0, 6)]]
    assert got(0) == [] and got(None) == []


def test_edge_cases(spark):
    bench = spark.createDataFrame([(1, "same TEXT here")], "item_id long, text string")
    rows = decontaminate.contamination(docs(spark, EDGE), bench).collect()
    assert len(rows) == len(EDGE) and sum(r.contaminated for r in rows) == 3
    assert decontaminate.contamination(docs(spark, []), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(docs(spark, EDGE), bench.limit(0)).collect())
