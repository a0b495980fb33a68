import random
import zlib

import numpy as np

from stacklight.llm import mil

from .util import EDGE, docs


def corpus(n):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 8)))
    out, quality = [], {}
    for i in range(n):
        good = rng.random() < 0.7
        w = [word() for _ in range(rng.randrange(20, 400))]
        if not good:  # bad in one passage only
            w[5:5] = [f"{word().upper()}!!" for _ in range(80)]
        out.append((i, " ".join(w)))
        quality[i] = int(good)
    return out, quality


def test_held_out_accuracy_and_folds(spark):
    rows, quality = corpus(500)
    labels = spark.createDataFrame([(i, q, 0) for i, q in quality.items()] + [(None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = mil.quality_scores(docs(spark, rows).repartition(3), labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == quality[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    # labels of the held-out fold change nothing
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality")
    again = {r.doc_id: r.score for r in mil.quality_scores(docs(spark, rows).repartition(3), flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


def test_scores_by_plain_loops():
    rows, quality = corpus(60)
    bags = [mil.passages(t.encode()) for _, t in rows]
    model = mil.train(bags, np.array([quality[i] for i, _ in rows], np.float32), epochs=3)
    p = {k: np.asarray(v, float) for k, v in model.p.items()}
    got = model.scores(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), len(bags))
    for bag, score in zip(bags, got, strict=True):
        codes, weights = [], []
        for x in bag:
            h = np.tanh(((x - model.mean) * model.scale) @ p["w1"] + p["b1"])
            gated = [np.tanh(sum(a * b for a, b in zip(h, p["v"][:, j]))) / (1 + np.exp(-sum(a * b for a, b in zip(h, p["u"][:, j])))) for j in range(p["v"].shape[1])]
            codes.append(h)
            weights.append(np.exp(sum(a * b for a, b in zip(gated, p["a"]))))
        z = sum(w * h for w, h in zip(weights, codes, strict=True)) / sum(weights)
        assert abs(1 / (1 + np.exp(-(z @ p["c"] + p["d"]))) - score) < 1e-4


def test_labels_twice_and_very_long_labelled_texts(spark):
    rows, quality = corpus(80)
    rows += [(500, " ".join(rows[0][1] for _ in range(300))), (501, "x " * 40_000), (501, "another text")]
    labels = [(i, q) for i, q in quality.items()] + [(0, 0), (0, 1), (500, 1), (501, 0)]
    got = mil.quality_scores(docs(spark, rows).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)


def test_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = mil.quality_scores(docs(spark, EDGE), none).collect()
    assert len(rows) == len(EDGE) and all(r.score == 0.5 for r in rows)
    one = spark.createDataFrame([(3, 1), (5, 1), (8, 0), (2, 0)], "doc_id long, quality int")
    rows = mil.quality_scores(docs(spark, EDGE), one).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert mil.quality_scores(docs(spark, []), one).collect() == []
