import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from stacklight.llm import resample

from .brute import LOWER
from .util import EDGE, docs


def found(text, width):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, width=2, n_buckets=10_000, percent=25, min_words=20, seed=7):
    """rows: [(doc_id, text)], target: [text] -> sorted rows."""
    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    own = [(d, *found(t, width)) for d, t in rows]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in target for f in found(x, width)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for d, n_words, fs in own:
        total = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + n_buckets) / ((s[b] + 1) * (all_t + n_buckets)))) for b in map(bucket, fs))
        weight = total // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    drawn = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(drawn):
        r[4] = i + 1 if i < percent * len(drawn) // 100 else None
    place = {id(r): r[4] for r in drawn}
    return sorted(((r[0], r[1], r[2], r[3], place.get(id(r))) for r in out), key=repr)


def corpus(rng, n, first=0):
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "ÉCOLE", "naïve", "x" * 90]
    return [(first + i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randrange(0, 70)))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"width": 3, "n_buckets": 17}, {"width": 1, "n_buckets": 1}, {"slice_segments": 1}])
def test_against_brute_force(spark, monkeypatch, options):
    rng = random.Random(5)
    rows = corpus(rng, 150) + [(900, "w1 " * 4000), (901, None), (902, "")]
    rows += [(950 + i, rows[3][1]) for i in range(30)]
    target = [t for _, t in corpus(rng, 9)] + [None]
    given = {k: v for k, v in options.items() if k != "slice_segments"}
    for size in (8192, 7):
        monkeypatch.setattr(resample, "SEGMENT_ROWS", size)
        got = resample.resample(docs(spark, rows).repartition(3), spark.createDataFrame([(t, 1) for t in target], "text string, bucket int"), **options)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, target, **given)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "text string")
    assert resample.resample(docs(spark, []), empty).collect() == []
    got = resample.resample(docs(spark, EDGE), empty, min_words=1, percent=100).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == [r[:4] for r in brute([(d, t) for d, t in EDGE], [], min_words=1, percent=100)]
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5, 6]
    some = resample.resample(docs(spark, EDGE), docs(spark, EDGE), min_words=1, percent=50, seed=3).collect()
    assert sorted(r["rank"] for r in some if r["rank"]) == [1, 2, 3]


def test_the_draw_leans_to_the_target(spark):
    rng = random.Random(1)
    near = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=40))) for i in range(60)]
    far = [(100 + i, " ".join(rng.choices(["red", "green", "blue"], k=40))) for i in range(180)]
    target = spark.createDataFrame([(" ".join(rng.choices(["alpha", "beta", "gamma"], k=200)),)], "text string")
    got = resample.resample(docs(spark, near + far), target).where("rank is not null").collect()
    assert len(got) == 60 and sum(r.doc_id < 100 for r in got) > 45
