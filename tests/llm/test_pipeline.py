import corpus_pipeline as cp
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from . import brute
from .test_packing import verify


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    import random

    d, rng = tmp_path_factory.mktemp("tables"), random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, item, phrase, passage = text(120), text(30), text(45), text(51)
    rows = [(i, text(rng.randrange(10, 200)), "en", f"s{i % 3}", 0) for i in range(120)]
    rows += [(200 + i, " ".join(f"{word().upper()}!!" for _ in range(60)), "en", "s1", 0) for i in range(40)]
    rows += [(300, rows[3][1], "en", "s0", 0), (301, rows[4][1] + " more", "en", "s0", 0), (302, f"{text(40)} {shared} {text(40)}", None, None, None), (306, f"{text(60)} {phrase} {text(50)}", "en", "s1", 0), (307, f"{text(50)} {phrase} {text(9)} {passage} {text(60)}", "en", "s1", 0), (308, f"{text(70)} {passage} {text(60)}", "en", "s1", 0), (303, f"{text(50)} {shared} {text(30)}", "de", "s2", 0), (304, f"{text(20)} {item} {text(20)}", "en", "s0", 0), (305, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(100), *range(200, 230)]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows


def test_each_stage_by_brute_force(spark, tables):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").select(cp.COLUMNS)
    kept = cp.quality(spark, docs, d).cache()
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & set(range(200, 240)) and len(ids & {*range(120), *range(300, 309)}) >= 120
    assert kept.schema.simpleString() == docs.schema.simpleString()

    one = cp.near_duplicates(spark, kept, d).cache()
    want = brute.near_duplicates([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in want.items() if c == i)

    rest = cp.repeated_text(spark, one, d).cache()
    before = one.collect()
    want = {r.doc_id: x[3].decode(errors="ignore") for r, x in zip(before, brute.remove_repeats([r.text for r in before], cp.REPEAT_BYTES, cp.PASSAGE_WORDS), strict=True)}
    got = {r.doc_id: r for r in rest.collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, t in want.items() if t}
    given = {r[0]: (r[1] or "").split() for r in rows}
    phrase, passage = " ".join(given[306][60:105]), " ".join(given[308][70:121])
    assert all(phrase in got[i].text for i in (306, 307)) and not any(passage in got[i].text for i in (307, 308))
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[302].source is None and len(got[303].text) < len(rows[163][1])
    assert rest.schema.simpleString() == docs.schema.simpleString()

    clean = cp.benchmark_passages(spark, rest, d).cache()
    dirty = {i for i, _, hit, _ in brute.contamination([(r.doc_id, r.text) for r in rest.collect()], [(1, spark.read.parquet(f"{d}/benchmark.parquet").first().text)]) if hit}
    assert dirty == {304} and {r.doc_id for r in clean.collect()} == set(got) - dirty

    pieces = cp.pack(spark, clean, d).collect()
    verify(pieces, {r.doc_id: r.text for r in clean.collect()}, 2048)
    first = min(pieces, key=lambda r: (r.doc_id, r.start))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert t.decode([int.from_bytes(first.ids[i : i + 2], "little") for i in range(0, 2 * (first.length - 1), 2)]) in clean.where(f"doc_id = {first.doc_id}").first().text


def test_run(spark, tables):
    rows = cp.run(spark, tables[0]).collect()
    assert sum(r.length for r in rows) > 0 and {r.doc_id for r in rows} <= {r[0] for r in tables[1]}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def words(seed, n=120):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_one_of_repeated_rows_survives(spark):
    a, b, c = words(1), words(2), words(3)
    rows = [(1, a)] * 3 + [(2, b), (2, c), (3, c + " more"), (4, c)]
    one = cp.near_duplicates(spark, documents(spark, rows), "").cache()
    assert sorted((r.doc_id, r.text) for r in one.collect()) == sorted([(1, a), (2, b), (2, c)])
    assert sorted((r.doc_id, r.text) for r in cp.repeated_text(spark, one, "").collect()) == sorted([(1, a), (2, b), (2, c)])


def test_rows_without_id_or_text(spark, tmp_path):
    a, b, c, item = words(4), words(5), words(6), words(7, 30)
    dirty = f"{words(8, 40)} {item} {words(9, 40)}"
    rows = [(None, a), (None, a), (None, b), (7, b + " more"), (None, dirty), (8, None), (None, ""), (9, c), (9, f"{words(10, 40)} {item}")]
    one = cp.near_duplicates(spark, documents(spark, rows), "").cache()
    order = lambda rows: sorted(((r[0], r[1]) for r in rows), key=str)
    want = [(None, a), (7, b + " more"), (None, dirty), (8, None), (None, ""), (9, c), rows[-1]]
    assert order(one.collect()) == order(want)
    rest = cp.repeated_text(spark, one, "").cache()
    assert order(rest.collect()) == order(want)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = cp.benchmark_passages(spark, rest, str(tmp_path)).cache()
    assert order(clean.collect()) == order([(None, a), (7, b + " more"), (8, None), (None, ""), (9, c)])
    assert sorted((r.doc_id or 0, r.length) for r in cp.pack(spark, clean, "").collect() if r.doc_tokens == 1) == [(0, 1), (8, 1)]
