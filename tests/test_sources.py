import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from stacklight.operators import marc
from stacklight.sources import diagnosis, harvest, iso2709, sinks

OAI = '<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/">{}</OAI-PMH>'


def record(i, items=True):
    copy = f'<datafield tag="952" ind1=" " ind2=" "><subfield code="p">b{i}</subfield></datafield>' if items else ""
    marc_ = f'<record xmlns="http://www.loc.gov/MARC21/slim"><leader>x</leader><datafield tag="245" ind1=" " ind2=" "><subfield code="a">T{i}</subfield></datafield>{copy}</record>'
    return f"<record><header><identifier>o:{i}</identifier></header><metadata>{marc_}</metadata></record>"


class Stub(BaseHTTPRequestHandler):
    failures = 1
    asked: list = []

    def log_message(self, *_):
        pass

    def say(self, body, code=200, **headers):
        self.send_response(code)
        for k, v in headers.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body.encode() if isinstance(body, str) else body)

    def do_GET(self):
        at = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(at.query).items()}
        Stub.asked.append(q)
        if at.path == "/loans":
            if self.headers.get("Authorization") != "t":
                return self.say("", 401)
            page = int(q.get("page", 1))
            back = {"checkin_date": "2024-01-05T00:00:00Z"} if q.get("checked_in") else {}
            rows = [{"checkout_id": 10 * page + len(back), "patron_id": 1, "item": {"biblio": {"biblio_id": 5}}, **back}]
            more = {"Link": f'<http://127.0.0.1:{self.server.server_port}/loans?page=2{"&checked_in=true" if back else ""}>; rel="next"'} if page == 1 else {}
            return self.say(json.dumps(rows), **more)
        if at.path == "/page":
            return self.say("<!doctype html><html>not found</html>")
        verb = q.get("verb")
        if verb == "Identify":
            return self.say(OAI.format("<Identify/>"))
        if verb == "ListMetadataFormats":
            return self.say(OAI.format("<ListMetadataFormats><metadataFormat><metadataPrefix>marc21</metadataPrefix></metadataFormat></ListMetadataFormats>"))
        if q.get("metadataPrefix") == "none":
            return self.say(OAI.format('<error code="cannotDisseminateFormat">no</error>'))
        items = at.path != "/bare"
        if q.get("resumptionToken") == "t1":
            if Stub.failures:
                Stub.failures -= 1
                return self.say("", 503)
            return self.say(OAI.format(f"<ListRecords>{record(3)}<resumptionToken> </resumptionToken></ListRecords>"))
        return self.say(OAI.format(f"<ListRecords>{record(1, items)}{record('2\x1b(B', items)}<resumptionToken>t1</resumptionToken></ListRecords>"))


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_a_list_is_read_page_by_page(spark, url):
    harvest.register(spark)
    Stub.asked.clear()
    pages = spark.read.format("oai_pmh").option("url", f"{url}/oai").option("from", "2024-01-01").load()
    got = harvest.split_records(pages).join(pages.select("removed").agg(F.sum("removed").alias("removed")), how="cross").collect()
    assert sorted(r.source_record_id for r in got) == ["o:1", "o:2", "o:3"] and got[0].removed == 3
    assert {"verb": "ListRecords", "resumptionToken": "t1"} in Stub.asked and any(q.get("from") == "2024-01-01" for q in Stub.asked)
    assert spark.read.format("oai_pmh").option("url", f"{url}/oai").option("maxpages", 1).load().count() == 1
    with pytest.raises(Exception, match="cannotDisseminateFormat"):
        spark.read.format("oai_pmh").option("url", f"{url}/oai").option("metadataPrefix", "none").load().collect()
    with pytest.raises(Exception, match="web page"):
        spark.read.format("oai_pmh").option("url", f"{url}/page").load().collect()


def test_a_list_as_a_stream(spark, url, tmp_path):
    harvest.register(spark)
    stream = spark.readStream.format("oai_pmh").option("url", f"{url}/oai").load()
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(once=True).start()
    q.awaitTermination(60)
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2 and any("until" in x for x in Stub.asked)


def test_slices():
    assert harvest.slices(0, 9, 3 / 86_400) == [("1970-01-01T00:00:00Z", "1970-01-01T00:00:02Z"), ("1970-01-01T00:00:03Z", "1970-01-01T00:00:05Z"), ("1970-01-01T00:00:06Z", "1970-01-01T00:00:08Z"), ("1970-01-01T00:00:09Z", "1970-01-01T00:00:09Z")]
    assert harvest.seconds("2024-01-02") == harvest.seconds("2024-01-02T00:00:00Z") and harvest.stamp(harvest.seconds("2024-01-02T03:04:05Z")) == "2024-01-02T03:04:05Z"
    parts = harvest.OaiReader({"url": "u", "from": "2024-01-01", "until": "2024-01-10", "slicedays": "4", "sets": "a,b"}).partitions()
    assert [(p.params["set"], p.params["from"], p.params["until"]) for p in parts[:3]] == [("a", "2024-01-01T00:00:00Z", "2024-01-04T23:59:59Z"), ("a", "2024-01-05T00:00:00Z", "2024-01-08T23:59:59Z"), ("a", "2024-01-09T00:00:00Z", "2024-01-10T23:59:59Z")] and len(parts) == 6
    with pytest.raises(ValueError, match="needs from"):
        harvest.OaiReader({"url": "u", "slicedays": "4"}).partitions()


class Dated(BaseHTTPRequestHandler):
    """A record a day of January 2024; the first request for one of the days fails, as if its task were lost."""

    asked: list = []
    broken = {"2024-01-09T00:00:00Z"}

    def log_message(self, *_):
        pass

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Dated.asked.append((q.get("from"), q.get("until")))
        if q.get("from") in Dated.broken:
            Dated.broken.discard(q["from"])
            return self.send_error(404)
        days = [d for d in range(1, 32) if q["from"] <= f"2024-01-{d:02d}T12:00:00Z" <= q["until"]]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(OAI.format(f"<ListRecords>{''.join(map(record, days))}</ListRecords>" if days else '<error code="noRecordsMatch">none</error>').encode())


@pytest.fixture
def dated():
    server = HTTPServer(("127.0.0.1", 0), Dated)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Dated.asked.clear()
    yield f"http://127.0.0.1:{server.server_port}/oai"
    server.shutdown()


def ids(pages):
    return sorted(int(r.source_record_id[2:]) for r in harvest.split_records(pages).collect())


def test_a_list_in_slices_with_a_lost_task(spark, dated):
    reader = harvest.OaiReader({"url": dated, "from": "2024-01-01", "until": "2024-01-31", "slicedays": "4"})
    rows, lost = [], 0
    for part in reader.partitions():
        for _ in range(2):  # a task that fails is run again
            try:
                rows += list(reader.read(part))
                break
            except Exception:
                lost += 1
    assert lost == 1 and ids(spark.createDataFrame(rows, "url string, body string, removed int")) == list(range(1, 32))
    harvest.register(spark)
    pages = spark.read.format("oai_pmh").option("url", dated).option("from", "2024-01-01").option("until", "2024-01-31").option("slicedays", 10).load()
    assert pages.rdd.getNumPartitions() == 4 and ids(pages) == list(range(1, 32))


def test_a_stream_in_bounded_batches(spark, dated, tmp_path):
    harvest.register(spark)
    sizes: list = []
    stream = spark.readStream.format("oai_pmh").option("url", dated).option("from", "2024-01-01").option("maxdays", 10).option("slicedays", 3).option("progress", f"{tmp_path}/until").load()
    start = lambda: stream.writeStream.foreachBatch(lambda df, n: sizes.append((n, ids(df)))).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="0 seconds").start()
    for least in (2, 4):  # stopped and started again
        q = start()
        for _ in range(600):
            if len(sizes) >= least or not q.isActive:
                break
            time.sleep(0.1)
        q.stop()
    got = {n: found for n, found in sizes}
    assert got[0] == list(range(1, 11)) and all(len(found) <= 10 for found in got.values())
    with pytest.raises(ValueError, match="maxdays needs"):
        harvest.OaiStreamReader({"url": dated, "maxdays": "1", "from": "2024-01-01"})
    every = [i for n in sorted(got) for i in got[n]]
    assert every == list(range(1, 32))


def test_preflight(spark, url):
    got = harvest.preflight(spark, {"url": f"{url}/oai"}, expect_items=True)
    assert got == {"flavour": "marc21", "prefixes": ["marc21"], "records": 2, "items": 2}
    with pytest.raises(ValueError, match="no items"):
        harvest.preflight(spark, {"url": f"{url}/bare"}, expect_items=True)
    with pytest.raises(ValueError, match="doesn't offer dc"):
        harvest.preflight(spark, {"url": f"{url}/oai", "metadataprefix": "dc"})
    with pytest.raises(ValueError, match="web page"):
        harvest.preflight(spark, {"url": f"{url}/page"})


def test_checkouts(spark, url):
    harvest.register(spark)
    rows = spark.read.format("checkouts").option("url", f"{url}/loans").option("headers", json.dumps({"Authorization": "t"})).load()
    got = sorted((r.source_loan_id, r.is_current) for r in harvest.loans(rows, "s").collect())
    assert got == [(10, True), (11, False), (20, True), (21, False)]
    with pytest.raises(Exception, match="credentials"):
        spark.read.format("checkouts").option("url", f"{url}/loans").load().collect()


def test_diagnosis(spark):
    bodies = {
        "empty": ["", " \n", None],
        "web_page": [" <!DOCTYPE html><p>", "<?xml version='1.0'?><html>"],
        "not_xml": ["oops <html", "{}"],
        "refused": [OAI.format('<error code="badVerb"> no such verb </error>')],
        "records": [OAI.format(record(1))],
        "other_format": [OAI.format('<record><metadata><dc:dc xmlns:dc="urn:dc"/></metadata></record>')],
        "deletions": [OAI.format('<record><header status="deleted"/></record>')],
        "no_records": [OAI.format(""), OAI.format("<headers/>"), OAI.format('<header/><header status="deleted"/>')],
    }
    bodies["not_xml"].remove("oops <html")  # a page whose head is cut is a page
    rows = [(k, b) for k, bs in bodies.items() for b in bs]
    got = spark.createDataFrame(rows, "want string, body string").select("want", diagnosis.diagnose(F.col("body")).alias("d"), diagnosis.advice(F.col("d")).alias("says")).collect()
    assert len(got) == len(rows) and all(r.d.kind == r.want and r.says.startswith(diagnosis.ADVICE[r.want]) for r in got)
    detail = {r.want: r.d.detail for r in got}
    assert (detail["refused"], detail["other_format"], detail["not_xml"]) == ("badVerb: no such verb", "dc:dc", "{}")


def test_readable():
    assert diagnosis.readable(b"<a>\xc3\xa9</a>") == ("<a>é</a>", 0) and diagnosis.readable(b"<a>\x1b(Bb\x00</a>") == ("<a>b</a>", 2)
    for payload, why in ((b"  ", "empty"), (b"<HTML><br>", "web page"), (b"oops", "no XML"), (b"<a><b></a>", "mismatched")):
        with pytest.raises(ValueError, match=why):
            diagnosis.readable(payload)


def test_sampled_flavours(spark):
    rec = lambda tag: marc.parse(F.lit(f'<record><datafield tag="{tag}" ind1=" " ind2=" "><subfield code="a">x</subfield></datafield></record>'))
    rows = lambda *tags: spark.range(len(tags)).select(F.col("id").alias("place"), F.element_at(F.array(*map(rec, tags)), (F.col("id") + 1).cast("int")).alias("rec"))
    assert harvest.response_flavour(rows("300", "200", "200", "300", "300", "245")) == "unimarc"
    for tags in (("245", "200"), ("300",)):
        with pytest.raises(ValueError):
            harvest.response_flavour(rows(*tags))


def test_sinks_and_records(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted", text', ["x", "y"]), (2, None, None)], "id long, text string, list array<string>")
    sinks.json_lines(rows, f"{tmp_path}/j")
    assert spark.read.schema(rows.schema).json(f"{tmp_path}/j").orderBy("id").collect() == rows.orderBy("id").collect()
    sinks.delimited(rows, f"{tmp_path}/t", sep="\t")
    back = spark.read.option("header", True).option("sep", "\t").option("escape", '"').csv(f"{tmp_path}/t").orderBy("id").collect()
    assert [(r.id, r.text, r.list) for r in back] == [("1", 'a "quoted", text', '["x","y"]'), ("2", None, None)]
    f = lambda tag, code, value: F.struct(F.lit(tag).alias("_tag"), F.lit("1").alias("_ind1"), F.lit(" ").alias("_ind2"), F.array(F.struct(F.lit(code).alias("_code"), F.lit(value).alias("_VALUE"))).alias("subfield"))
    rec = F.struct(F.lit(iso2709.LEADER_MARC21).alias("leader"), F.array(F.struct(F.lit("001").alias("_tag"), F.lit("n1").alias("_VALUE"))).alias("controlfield"), F.array(f("245", "a", "Été & <b>"), f("650", "a", "s")).alias("datafield"))
    one = spark.range(1).select(rec.alias("rec"))
    text = one.select(iso2709.iso2709(F.col("rec")).alias("t")).first().t
    assert int(text[:5]) == len(text.encode()) and text[int(text[12:17]) - 1] == "\x1e" and text.endswith("\x1d")
    start, size = int(text[24 + 12 + 7 : 24 + 24]), int(text[24 + 12 + 3 : 24 + 12 + 7])
    body = text.encode()[int(text[12:17]) :][start : start + size].decode()
    assert body == "1 \x1faÉté & <b>\x1e"
    back = one.select(iso2709.read_iso2709(iso2709.iso2709(F.col("rec"))).alias("x"), "rec").select("x.controlfield", "x.datafield", F.col("rec.controlfield").alias("c"), F.col("rec.datafield").alias("d")).first()
    assert back.controlfield == back.c and back.datafield == back.d
    again = one.select(marc.parse(iso2709.marcxml(F.col("rec"))).alias("x"), "rec").first()
    assert again.x.datafield == again.rec.datafield
    sinks.records(one, f"{tmp_path}/r")
    long = spark.range(1).select(F.struct(F.lit("x").alias("leader"), F.array(F.struct(F.lit("001").alias("_tag"), F.repeat(F.lit("é"), 6000).alias("_VALUE"))).alias("controlfield"), F.array(f("245", "a", "x")).alias("datafield")).alias("rec"))
    assert long.select(iso2709.iso2709(F.col("rec")).alias("t")).first().t is None


def test_dump_reader(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "dump.txt.gz", "wt") as f:
        f.write('/type/work\t/works/W1\t3\t2024-01-01\t{"title": "a\\tb"}\nbroken\tline\n/type/work\t/works/W2\t1\t2024-01-01\t{"title": "x\ty"}\n')
    got = sorted((r.key, r.json) for r in harvest.open_library(spark, str(tmp_path / "dump.txt.gz")).collect())
    assert got == [("/works/W1", '{"title": "a\\tb"}'), ("/works/W2", '{"title": "x\ty"}')]


def test_database_rows_with_nulls(spark):
    biblio = spark.createDataFrame([(1, None, "sub", None, None, None, None, None, 0), (2, " T ", None, " A ", " s ", "n", 1999, None, 0), (3, "hidden", None, None, None, None, None, None, 1)], "biblionumber int, title string, subtitle string, author string, abstract string, notes string, copyrightdate int, timestamp timestamp, opac_suppressed int")
    editions = spark.createDataFrame([(2, "x", "19xx", None)], "biblionumber int, isbn string, publicationyear string, publishercode string")
    got = {r.source_record_id: r for r in harvest.database_works(biblio, editions).collect()}
    assert set(got) == {"1", "2"} and got["1"].title == "sub" and got["1"].authors == [] and got["1"].isbns == []
    assert (got["2"].title, got["2"].authors, got["2"].summary, got["2"].publication_year) == ("T", ["A"], "s", None)
