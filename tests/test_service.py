import pytest

from stacklight.operators.service import Catalogue

WORK = "id long, source_id int, source_record_id string, title string, publisher string, publication_year int, authors array<string>, languages array<string>, subjects array<string>, isbns array<string>, deleted_at string"


@pytest.fixture(scope="module")
def c(spark):
    rows = [(1, 1, "A:1", "Kilns and glazes", "p", 1990, ["Tabor, Nils"], [], [], ["1402894627"], None), (2, 1, "A:2", "The kilns and glazes!", "p", 1991, ["Tabor, Nils"], [], [], [], None), (3, 2, "B:1", "Harbour lights", None, None, None, None, None, None, None), (4, 1, "A:4", "Gone", "p", None, [], [], [], [], "2024")]
    vectors = [(1, [1.0, 0.0], 1, False), (2, [0.8, 0.6], 1, False), (3, [0.6, 0.8], 2, True), (4, [1.0, 0.0], 1, False)]
    return Catalogue(
        spark.createDataFrame(rows, WORK),
        spark.createDataFrame([(1, None)], "work_id long, due_date string"),
        spark.createDataFrame([(1, "one", None, None), (2, "two", False, None)], "id int, name string, last_had_items boolean, last_harvest timestamp"),
        spark.createDataFrame(vectors, "work_id long, vector array<double>, source_id int, is_title_only boolean"),
        spark.createDataFrame([(1, [1.0, 0.0], 5, None)], "work_id long, factors array<double>, n_patrons int, trained_at timestamp"),
        encode=lambda text: [1.0, 0.0],
    )


def test_reads(c):
    p = c.work(1).first().payload
    assert (p.biblionumber, p.source.name, p.availability.is_available, p.authors) == ("1", "one", True, ["Tabor, Nils"])
    assert c.work(3).first().payload.availability is None and c.work(4).isEmpty() and c.work(9).isEmpty()
    assert c.work_by_record_id("1").isEmpty() and [r.id for r in c.work_by_record_id("1", 2).collect()] == [3] and c.work_by_record_id("A:2").first().id == 2
    h = c.health().first()
    assert (h.works, h.items, h.embeddings, h.unembedded, h.last_harvest) == (3, 1, 4, -1, None)
    assert {r.id: (r.works, r.embedded, r.factorised) for r in c.coverage().collect()} == {1: (2, 2, 1), 2: (1, 1, 0)}


def test_similar(c):
    got = c.similar(1).first()
    assert [(r.id, r.signal, r.content_score) for r in got.results] == [(2, "content", 0.8)] and (got.hybrid_count, got.collaborative_applied) == (0, False)
    assert [r.id for r in c.similar(1, cross_source=True).first().results] == [2, 3]
    assert [r.id for r in c.similar(1, cross_source=True, exclude_title_only=True).first().results] == [2] and c.similar(4).isEmpty()
    with pytest.raises(ValueError):
        c.similar(1, limit=51)


def test_searches(c):
    assert [(r.id, r.payload.score) for r in c.search_exact("140-289-4627").collect()] == [(1, 1.0)]
    assert [r.id for r in c.search_exact("kilns glazes").collect()] == [1, 2] and c.search_exact("kilns glazes", source_id=2).isEmpty()
    # editions of one key are one result
    assert [(r.id, r.payload.score) for r in c.search_semantic("pots").collect()] == [(1, 1.0), (3, 0.6)]
    assert [r.id for r in c.search_semantic("pots", min_score=0.7).collect()] == [1] and [r.id for r in c.search_semantic("pots", source_id=2).collect()] == [3]
    for bad in ({"limit": 0}, {"min_score": 2.0}):
        with pytest.raises(ValueError):
            c.search_semantic("pots", **bad)
