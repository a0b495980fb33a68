import hashlib
import hmac
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stacklight.functions import hashing, sql
from stacklight.functions import text as T
from stacklight.operators import search
from stacklight.operators.search import word_similarities


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    got = row.select(column.alias("x")).first().x
    return got.asDict(recursive=True) if hasattr(got, "asDict") else got


CASES = [
    (T.strip_isbd, "Harbour lights :", "Harbour lights"),
    (T.strip_isbd, "Orvane, Tilda.", "Orvane, Tilda"),
    (T.strip_isbd, "Tabor, Nils E.", "Tabor, Nils E."),
    (T.strip_isbd, "Title / :", "Title"),
    (T.strip_isbd, "  :  ", ""),
    (T.clean_isbn, "9781402894626 (cloth)", "9781402894626"),
    (T.clean_isbn, "978-1-4028-9462-6", "9781402894626"),
    (T.clean_isbn, "140289462x", "140289462X"),
    (T.clean_isbn, "12345", None),
    (T.clean_isbn, "(pbk.)", None),
    (T.strip_nonfiling, "[L']étang", "L'étang"),
    (T.strip_nonfiling, "[Un ]rêve", "Un rêve"),
    (T.strip_nonfiling, "mid [x] title", "mid [x] title"),
    (T.extract_year, "c1994.", 1994),
    (T.extract_year, "12345", None),
    (T.biblionumber, "CAT:x:12", "12"),
    (T.biblionumber, "12", "12"),
    (T.fold, "Éç ñ Ü", "ec n u"),
    (T.subject_head, "Kilns -- History", "Kilns"),
    (T.source_name, "http://h:80/x/y", "h:80"),
    (T.isbn_shaped, "140-289-4627", "1402894627"),
    (T.isbn_shaped, "kilns", None),
    (T.result_count, "returned 1,234 results", 1234),
    (T.result_count, "No results found!", 0),
    (T.result_count, "?", -1),
    (T.is_latin, "Море", False),
    (T.is_latin, "123", True),
    (T.surname, "Nils E. Tabor", "Tabor"),
]


@pytest.mark.parametrize(("f", "given", "want"), CASES)
def test_scalars(spark, f, given, want):
    assert one(spark, f(F.lit(given))) == want


def test_linkage(spark):
    assert one(spark, T.parse_linkage(F.lit("245-03/(2/r"))) == {"tag": "245", "occurrence": "03", "script": "(2", "orientation": "r", "standalone": False}
    assert one(spark, T.parse_linkage(F.lit("590-00/(2")))["standalone"]
    assert one(spark, T.parse_linkage(F.lit("abc-01"))) is None


def test_build_text(spark):
    t = one(spark, T.build_text(F.lit("Title"), F.lit(None), F.array().cast("array<string>"), F.lit("Summary."), F.lit("Chapter one -- chapter two.")))
    assert t == {"core": "Title", "description": "Summary.. Chapter one -- chapter two.", "is_title_only": False}


def test_hmac(spark):
    for secret in ("s", "long" * 40):
        want = hmac.new(secret.encode(), b"42", hashlib.sha256).hexdigest()
        assert one(spark, hashing.hmac_sha256(F.lit("42"), secret)) == want
    assert one(spark, hashing.patron_reference(F.lit(42), "s")) == hmac.new(b"s", b"42", hashlib.sha256).hexdigest()[:32]
    with pytest.raises(ValueError):
        hashing.hmac_sha256(F.lit("x"), "")


def grams(text):
    return [f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", text) for i in range(len(w) + 1)]


def test_word_similarities(spark, monkeypatch):
    pairs = [("tabor", "tabor, nils e. oake, ines p."), ("jardin anglais", "le jardin vague"), ("garden soil basicks", "garden soil basics"), ("x", ""), ("aaaa aa", "aa aaaa b aaa"), ("", "x")]
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choices("ab", k=rng.randrange(1, 4))) for _ in range(rng.randrange(n)))
    pairs += [(text(6), text(25)) for _ in range(150)]
    want = []
    for query, target in pairs:
        q, t = set(grams(query)), grams(target)
        every = [set(t[i:j]) for i in range(len(t)) for j in range(i + 1, len(t) + 1)]
        want.append(max((len(q & e) / len(q | e) for e in every), default=0.0))
    columns = [pa.array([list(dict.fromkeys(grams(q))) for q, _ in pairs], pa.list_(pa.string())), pa.array([grams(t) for _, t in pairs], pa.list_(pa.string()))]
    for cells in (1, 100, 10**6):
        monkeypatch.setattr(search, "CELLS", cells)
        assert word_similarities(*columns).tolist() == pytest.approx(want)
        assert word_similarities(*(c.slice(5, 40) for c in columns)).tolist() == pytest.approx(want[5:45])
    for (query, target), w in list(zip(pairs, want, strict=True))[:5]:
        plain = one(spark, T.similarity(T.trigrams(F.lit(query)), T.trigrams(F.lit(target))))
        assert plain == pytest.approx(len(set(grams(query)) & set(grams(target))) / max(1, len(set(grams(query)) | set(grams(target))))) and w >= 0


def test_fold_and_clean(spark):
    assert one(spark, T.fold(F.lit("Ấn Độ Ά ё ŷ Œuvres STRASSE Straße Ærø Łódź ǼǾ"))) == "an do α е y oeuvres strasse strasse aero lodz aeo"
    assert one(spark, T.strip(F.lit("\u3000\t a b\xa0\r\n"))) == "a b" and one(spark, T.join_parts(F.array(F.lit("\n\t"), F.lit(" x\n")), "/")) == "x"
    assert one(spark, T.sanitize_xml(F.lit("a\x1b*Bb\x1bAc\x00d"))) == {"text": "abcd", "removed": 3}
    assert one(spark, T.canonical_key(F.lit("L'Été: the End"), F.lit(None).cast("array<string>"))) == "l été the end|"
    assert one(spark, T.prefer_script(F.lit(" "), F.lit("море"))) == {"embed": "море", "search": "море"}


def test_functions_in_sql(spark):
    names = sql.register(spark, "s")
    assert {"strip_isbd", "trigrams", "word_similarity", "patron_reference"} <= set(names)
    rows = spark.createDataFrame([(1, "Łódź : Œuvres /", "lodz oeuvres x"), (2, "", None), (3, None, "a b")], "id long, a string, b string")
    rows.createOrReplaceTempView("sql_functions_in")
    got = spark.sql("SELECT a, strip_isbd(a) s, strip_white(a) w, clean_isbn(a) i, fold_accents(a) f, trigram_sequence(a) q, trigrams(a) g, trigram_similarity(a, b) t, word_similarity(a, b) m, patron_reference(cast(id AS string)) p FROM sql_functions_in ORDER BY id").collect()
    c = F.col
    want = rows.select(T.strip_isbd(c("a")).alias("s"), T.strip(c("a")).alias("w"), T.clean_isbn(c("a")).alias("i"), T.fold(c("a")).alias("f"), T.gram_sequence(T.fold(c("a"))).alias("q"), T.trigrams(c("a")).alias("g"), T.similarity(T.trigrams(c("a")), T.trigrams(c("b"))).alias("t"), hashing.patron_reference(c("id"), "s").alias("p")).orderBy("id").collect()
    assert [[r[k] for k in "swifqp"] for r in got] == [[r[k] for k in "swifqp"] for r in want] and got[0].t == want[0].t
    assert [r.m for r in got] == [1.0, None, None] and got[0].g == want[0].g
    assert list(sql.grams("Œuvres d'été")) == one(spark, T.gram_sequence(T.fold(F.lit("Œuvres d'été"))))
    with pytest.raises(ValueError):
        sql.register(spark, "")


def test_times_in_another_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        at = F.timestamp_micros(F.lit(1_704_067_200_000_000))
        assert one(spark, T.iso_time(at)) == "2024-01-01T00:00:00+00:00"
        assert one(spark, T.iso_time(F.timestamp_micros(F.lit(1_710_054_000_000_005)))) == "2024-03-10T07:00:00.000005+00:00"  # the hour that is skipped there
        assert one(spark, T.iso_time(F.lit(None).cast("timestamp"))) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
