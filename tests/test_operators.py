import pytest
from pyspark.sql import functions as F

from stacklight.operators import catalog, interactions, marc, merge, rank, search
from stacklight.sources import harvest

RECORD = '<marc:record xmlns:marc="http://www.loc.gov/MARC21/slim"><marc:leader>     nam a22</marc:leader><marc:controlfield tag="008">{f008}</marc:controlfield>{fields}</marc:record>'


def field(tag, **subs):
    return f'<marc:datafield tag="{tag}" ind1=" " ind2=" ">' + "".join(f'<marc:subfield code="{k.lstrip("_")}">{v}</marc:subfield>' for k, v in subs.items()) + "</marc:datafield>"


def test_marc21_record(spark):
    xml = RECORD.format(f008=" " * 35 + "eng d", fields=field("020", a="9781402894626 (cloth)") + field("100", a="Orvane, Tilda.", _9="7") + field("245", _6="880-03", a="Harbour lights :", b="a coastal year /") + field("260", a="Oslo", b="Fjord Press,", c="c1994.") + field("650", a="Lighthouses", z="Norway", v="Maps.") + field("880", _6="245-03/(2/r", a="כותר") + field("952", p="bc1", q="2026-09-06", l="3"))
    rows = spark.createDataFrame([("R:1", False, xml), ("R:2", True, None), ("R:3", False, RECORD.format(f008="", fields=""))], "source_record_id string, deleted boolean, xml string")
    mapped = marc.map_records(rows.select("source_record_id", "deleted", marc.parse(F.col("xml")).alias("rec")))
    assert {r.source_record_id: r.status for r in mapped.collect()} == {"R:1": "mapped", "R:2": "deleted", "R:3": "unmappable"}
    w = marc.works_batch(mapped).first()
    assert (w.title, w.authors, w.isbns, w.subjects) == ("Harbour lights : a coastal year", ["Orvane, Tilda"], ["9781402894626"], ["Lighthouses — Norway — Maps"])
    assert (w.publisher, w.publication_year, w.languages, w.title_alternate, w.provenance["title"]) == ("Fjord Press", 1994, ["eng"], "כותר", "245")
    i = marc.items_batch(mapped).first()
    assert (i.barcode, str(i.due_date), i.issue_count) == ("bc1", "2026-09-06", 3)


def test_search_exact(spark):
    works = spark.createDataFrame([(1, "Garden soil basics", ["Quill, Rosa"], ["1402894627"], None), (2, "Le jardin d'hiver", ["Delcourt, Zoé"], [], None), (3, "The art of the kiln", ["Tabor, Nils E.", "Oake, Ines P."], ["1402894635"], None)], "id long, title string, authors array<string>, isbns array<string>, deleted_at timestamp")
    queries = spark.createDataFrame([(q,) for q in ("140-289-4627", "jardin hiver", "garden soil basicks", "Tabor", "zzzzqqqxyz")], "query string")
    got = {r.query: (r.id, r.score) for r in search.search_exact(queries, works).where("rank = 1").collect()}
    assert got["140-289-4627"] == (1, 1.0) and got["jardin hiver"][0] == 2 and got["garden soil basicks"][0] == 1 and got["Tabor"][0] == 3 and "zzzzqqqxyz" not in got


def test_rerank_median_and_abstention(spark):
    schema = "probe long, work_id long, content_score double, factors array<double>, n_patrons int"
    unit = lambda d: [d, (1 - d * d) ** 0.5]
    rows = [(1, i + 1, 0.5, unit(d), 9) for i, d in enumerate([1.0, 0.9, 0.8, 0.7, 0.0])] + [(1, 9, 0.5, None, 0)]
    probe = spark.createDataFrame([(1, [1.0, 0.0], 9)], "probe long, probe_vector array<double>, probe_patrons int")
    w = rank.Weights(content=0, collaborative=1)
    got = [r.work_id for r in rank.rerank(spark.createDataFrame(rows, schema), probe, w).orderBy("rank").collect()]
    assert got.index(9) == 3
    few = spark.createDataFrame([(1, 1, 0.9, unit(0.1), 9), (1, 2, 0.8, unit(0.9), 3), (1, 3, 0.7, None, 0)], schema)
    got = rank.rerank(few, probe).orderBy("rank").collect()
    assert [(r.work_id, r.signal, r.score) for r in got] == [(1, "content", 0.9), (2, "content", 0.8), (3, "content", 0.7)]
    with pytest.raises(ValueError):
        rank.Weights(content=-1)


@pytest.mark.parametrize(("pairs", "left"), [([("a", 1), ("b", 1), ("a", 2), ("b", 2), ("c", 9)], {1, 2}), ([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 3), ("c", 1)], {1, 2})])
def test_k_core(spark, pairs, left):
    rows = spark.createDataFrame(pairs, "patron_ref string, work_id long")
    got = interactions.k_core(rows).collect()
    assert {r.work_id for r in got} == left and "c" not in {r.patron_ref for r in got}


def test_confidence_and_factor_count(spark):
    c = lambda loans, ren: spark.range(1).select(interactions.confidence(F.lit(loans), F.lit(ren))).first()[0]
    assert (c(1, 0), c(1, 1), c(2, 0), c(500, 0)) == (2, 4, 7, 40)
    k = lambda m, n, z: spark.range(1).select(interactions.choose_factors(F.lit(m), F.lit(n), F.lit(z))).first()[0]
    assert (k(10, 10, 100), k(5000, 5000, 10_000_000), k(50_000, 20_000, 1_000_000)) == (16, 128, 16)


def test_fold_in_abstains(spark):
    factors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (4, [0.0, 1.0])], "work_id long, vector array<float>")
    rows = spark.createDataFrame([("p", 1, 1, 0), ("p", 2, 1, 0), ("p", 4, 1, 0), ("q", 1, 1, 0), ("q", 99, 1, 0)], "patron_ref string, work_id long, n_loans long, n_renewals long")
    got = {r.patron_ref: r for r in interactions.fold_in(rows, factors).collect()}
    assert got["q"].vector is None and got["q"].n_works == 1
    assert abs(sum(x * x for x in got["p"].vector) - 1) < 1e-6


WORK = "source_id int, source_record_id string, title string, content_hash string, items_hash string, deleted boolean"


def test_merge_works(spark):
    old = spark.createDataFrame([(1, "a", "A", "h", "i", True), (1, "b", "B", "h", "i", False), (1, "c", "C", "h", "i", False)], WORK)
    new = spark.createDataFrame([(1, "a", "A2", "h", "j", False), (1, "b", "B2", "h2", "i", False), (1, "c", None, None, None, True), (1, "d", "D", "h", "i", False), (1, "e", None, None, None, True)], WORK)
    got = {r.source_record_id: r for r in merge.merge_works(old, new).collect()}
    assert {k: r.action for k, r in got.items()} == {"a": "unchanged", "b": "updated", "c": "deleted", "d": "inserted"}
    assert got["a"].title == "A" and not got["a"].deleted and got["a"].items_changed and got["b"].title == "B2" and got["c"].deleted


def test_feeds(spark):
    page = '<OAI-PMH><ListRecords><record><header status="deleted"><identifier>x:1</identifier></header></record><record><header><identifier>x:2</identifier></header><metadata><record>m</record></metadata></record><resumptionToken> t1 </resumptionToken></ListRecords></OAI-PMH>'
    assert harvest.token_of(page) == "t1" and harvest.token_of("<resumptionToken></resumptionToken>") is None
    assert harvest.error_of('<error code="badArgument">no</error>') == "badArgument: no"
    got = harvest.split_records(spark.createDataFrame([("u", page)], "url string, body string")).orderBy("place").collect()
    assert [(r.source_record_id, r.deleted, r.xml) for r in got] == [("x:1", True, None), ("x:2", False, "<record>m</record>")]
    rows = ['{"checkout_id":1,"patron_id":2,"item":{"biblio":{"biblio_id":3}},"renewals_count":null,"checkout_date":"bad"}', '{"checkout_id":1,"item":{}}']
    got = harvest.loans(spark.createDataFrame([(r,) for r in rows], "value string"), "s").collect()
    assert len(got) == 1 and got[0].renewals == 0 and got[0].checked_out_at is None and len(got[0].patron_ref) == 32


def test_availability(spark):
    schema = "id long, source_id int, source_record_id string, title string, publisher string, publication_year int, authors array<string>, languages array<string>, subjects array<string>, isbns array<string>, deleted_at timestamp"
    works = spark.createDataFrame([(1, 1, "R:1", "a", None, None, ["x"], ["eng "], None, [], None), (2, 2, "R:2", "b", "p", 1999, None, None, None, None, None)], schema)
    items = spark.createDataFrame([(1, None), (1, "2026-09-06")], "work_id long, due_date string")
    sources = spark.createDataFrame([(1, "s", None), (2, "t", False)], "id int, name string, last_had_items boolean")
    rows = {r.id: r for r in catalog.work_summary(works, items, sources).collect()}
    assert {i: (r.copies_total, r.copies_available, r.has_holdings) for i, r in rows.items()} == {1: (2, 1, True), 2: (0, 0, False)}
    assert (rows[1].publisher, rows[1].languages, rows[1].subjects, rows[2].authors) == ("", ["eng"], [], [])
    text = {r.id: r.payload for r in catalog.payload(catalog.work_summary(works, items, sources)).collect()}
    assert '"is_available":true' in text[1] and "availability" not in text[2] and "score" not in text[1]


def test_loans_find_their_source_s_live_numbered_work(spark):
    works = spark.createDataFrame([(1, 1, "A:7", "gone"), (2, 1, "A:007", None), (3, 1, "B:7", None), (4, 2, "A:7", None), (5, 1, "A:x", None), (6, 1, "12", None)], "id long, source_id int, source_record_id string, deleted_at string")
    loans = spark.createDataFrame([(1, 10, "7"), (2, 11, "7"), (1, 12, "x"), (3, 13, "7"), (1, 14, "12"), (1, 15, None)], "source_id int, loan_id long, biblio_id string")
    assert {r.loan_id: r.work_id for r in merge.resolve_loans(loans, works).collect()} == {10: 2, 11: 4, 12: None, 13: None, 14: 6, 15: None}
    assert {r.loan_id: r.work_id for r in merge.resolve_exact(loans, works).collect()} == {10: None, 11: None, 12: None, 13: None, 14: 6, 15: None}
    assert {r.loan_id: r.work_id for r in merge.resolve_ratings(loans, works).collect()} == {10: 3, 11: 4, 12: 5, 13: None, 14: 6, 15: None}


def test_migrations_run_once_and_in_order(spark):
    known = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "version int, description string")
    ledger = spark.createDataFrame([(1, "a", None)], "version int, description string, applied_at timestamp")
    ran = []
    done = merge.apply_migrations(known, ledger, lambda m: ran.append(m["version"]), "2024-01-01")
    assert ran == [2, 3] and sorted(r.version for r in done.collect()) == [1, 2, 3] and merge.pending_migrations(known, done).isEmpty()


def test_factorise(spark):
    loans = spark.createDataFrame([(1, f"p{i}", i % 4 + j, 0) for i in range(12) for j in range(3)] + [(2, "q", 99, 0)], "source_id int, patron_ref string, work_id long, renewals int")
    got = interactions.factorise(loans, source_id=1, iterations=3).collect()
    assert {r.work_id for r in got} == set(range(6)) and all(r.dimensions == 16 and abs(sum(x * x for x in r.vector) - 1) < 1e-5 and r.factoriser_version == 1 for r in got)
    with pytest.raises(ValueError):
        interactions.factorise(loans, source_id=3)
