"""Registered queries over single fields and records, and the same in DuckDB SQL. Inputs are built from the parts' columns, so that
SQL can state what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import encode, evaluation, marc, open_library, vectors
from ..sources import harvest, iso2709
from ..sources.diagnosis import diagnose
from . import adapters as A
from .registry import query


def _k():
    return F.col("p_partkey")


def _name():
    return F.col("p_name")


def _part(spark, sf_dir, **columns) -> DataFrame:
    return A.table(spark, sf_dir, "part").select(_k().alias("id"), *[c.alias(n) for n, c in columns.items()])


def _str(c):
    return c.cast("string")


# names, titles, numbers -------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, p_name || ' / ' || p_brand AS title FROM part")
def join_title(spark, sf_dir):
    return _part(spark, sf_dir, title=T.join_parts(F.array(F.concat(F.lit(" \t"), "p_name", F.lit("\xa0\n")), F.lit("\n\t"), F.col("p_brand")), " / "))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN '245' END AS tag, CASE WHEN p_partkey % 3 <> 0 THEN lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') END AS occurrence, CASE WHEN p_partkey % 3 = 1 THEN '(N' END AS script, CASE WHEN p_partkey % 3 = 1 THEN 'r' END AS orientation, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 100 = 0 END AS standalone FROM part")
def linkage(spark, sf_dir):
    number = F.lpad(_str(_k() % 100), 2, "0")
    value = F.when(_k() % 3 == 0, F.concat(F.lit("24-"), number)).when(_k() % 3 == 1, F.concat(F.lit("245-"), number, F.lit("/(N/r"))).otherwise(F.concat(F.lit("245-"), number))
    return _part(spark, sf_dir, link=T.parse_linkage(value)).select("id", "link.*")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 100 = 0 THEN '' ELSE '245-' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || ':1' END AS pairs FROM part")
def pair_linked(spark, sf_dir):
    value = F.concat(F.lit("245-"), F.lpad(_str(_k() % 100), 2, "0"))
    pairs = T.pair_linked(F.array(F.lit("bad"), value, value, F.lit("100-00")))
    return _part(spark, sf_dir, m=pairs).select("id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("pairs"))


@query("SELECT p_partkey AS id, p_partkey % 4 <> 1 AS latin, CASE WHEN p_partkey % 4 = 1 THEN 'книга' ELSE p_name END AS embed, CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN p_name || ' книга' WHEN p_partkey % 4 = 2 THEN p_name || ' ' || p_brand ELSE p_name END AS search FROM part")
def script_choice(spark, sf_dir):
    alt = F.when(_k() % 4 == 0, F.lit(" ")).when(_k() % 4 == 1, F.lit("книга")).when(_k() % 4 == 2, F.col("p_brand"))
    one = F.when(_k() % 4 == 3, F.lit("")).otherwise(_name())
    other = F.when(_k() % 4 == 3, _name()).otherwise(alt)
    return _part(spark, sf_dir, latin=T.is_latin(F.when(_k() % 4 == 1, F.lit("книга 12")).otherwise(_name())), s=T.prefer_script(one, other)).select("id", "latin", "s.*")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' : ' || p_brand END AS title, CASE p_partkey % 4 WHEN 0 THEN 1984 WHEN 1 THEN NULL WHEN 2 THEN 1999 END AS year FROM part")
def database_fields(spark, sf_dir):
    k = _k() % 4
    year = T.leading_year(F.when(k == 0, "1984-05").when(k == 1, "c198"), F.when(k == 2, "1999").when(k == 1, "2000"))
    return _part(spark, sf_dir, title=T.merge_subtitle(_name(), F.when(_k() % 2 == 0, F.upper(F.left("p_name", F.lit(4)))).otherwise(F.concat(F.lit(" "), "p_brand"))), year=year.cast("int"))


@query("SELECT p_partkey AS id, ['0' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), '978' || lpad(CAST(p_partkey AS VARCHAR), 10, '0')] AS isbns, ['978' || lpad(CAST(p_partkey AS VARCHAR), 10, '0')] AS long_isbns, CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 9, '0') || 'X' END AS shaped FROM part")
def isbn_fields(spark, sf_dir):
    ten, more = F.concat(F.lit("0"), F.lpad(_str(_k()), 9, "0")), F.concat(F.lit("978-"), F.lpad(_str(_k()), 10, "0"))
    asked = F.when(_k() % 2 == 0, F.concat(F.lpad(_str(_k()), 9, "0"), F.lit("-x"))).otherwise(F.concat(_name(), F.lit(" 2"), F.lpad(_str(_k()), 9, "0")))
    return _part(spark, sf_dir, isbns=T.split_isbns(F.concat(ten, F.lit("|"), more, F.lit(" 12"))), long_isbns=T.isbn13s(F.array(ten, more, F.lit("978"))), shaped=T.isbn_shaped(asked))


@query("SELECT p_partkey AS id, p_type AS head, left(p_name, 7) AS clipped, [left(p_name, 3), left(p_brand, 3)] AS each FROM part")
def heads_and_clips(spark, sf_dir):
    dash = F.when(_k() % 2 == 0, F.lit(" -- ")).otherwise(F.lit(" — "))
    return _part(spark, sf_dir, head=T.subject_head(F.concat(F.col("p_type"), dash, F.lit("History"))), clipped=T.clip(_name(), 7), each=T.clip_each(F.array("p_name", "p_brand"), 3))


@query("SELECT p_partkey AS id, p_name || ' ' || p_brand AS cleaned, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1000 + p_partkey ELSE -1 END AS hits FROM part")
def search_pages(spark, sf_dir):
    page = F.when(_k() % 3 == 0, "<p>No results found for that</p>").when(_k() % 3 == 1, F.concat(F.lit("<p>returned "), F.format_number((1000 + _k()).cast("double"), 0), F.lit(" results.</p>"))).otherwise("<p>returned</p>")
    asked = F.concat(F.lit("kw,wrdl:"), _name(), F.lit('  "'), F.col("p_brand"), F.lit("'"))
    return _part(spark, sf_dir, cleaned=T.clean_query(asked), hits=T.result_count(page))


@query("SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS is_current, strftime(CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderdate AS TIMESTAMP) END, '%Y-%m-%dT%H:%M:%S+00:00') AS returned FROM orders")
def loan_state(spark, sf_dir):
    back = F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderdate").cast("timestamp"))
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.is_current(back).alias("is_current"), T.iso_time(back).alias("returned"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE CAST(1950 + p_size AS VARCHAR) END AS value, CASE WHEN p_partkey % 3 = 0 THEN 1500 + p_size END AS year, CASE WHEN p_partkey % 2 = 0 THEN 'eng' ELSE 'fre' END AS language FROM part")
def dump_fields(spark, sf_dir):
    value = F.when(_k() % 2 == 0, _name()).otherwise(_str(1950 + F.col("p_size")))
    json = F.when(_k() % 4 < 2, F.to_json(F.struct(value.alias("v")))).otherwise(F.to_json(F.struct(F.struct(value.alias("value")).alias("v"))))
    year = T.edition_year(F.concat(F.lit("May "), F.when(_k() % 3 == 0, _str(1500 + F.col("p_size"))).otherwise("1410, 2030")))
    paths = F.array(F.lit("/languages/ger"), F.concat(F.lit("/languages/"), F.when(_k() % 2 == 0, "eng").otherwise("fre")), F.lit("/languages/eng"))
    return _part(spark, sf_dir, value=T.text_value(json, "v"), year=year.cast("int"), language=T.first_accepted(paths, ["eng", "fre"]))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 0 END AS skipped, split_part(p_name, ' ', -1) AS surname, left(p_name, length(p_name) - length(split_part(p_name, ' ', -1)) - 1) AS forename FROM part")
def article_and_name(spark, sf_dir):
    k = _k() % 4
    title = F.concat(F.when(k == 0, "The ").when(k == 1, "L'").when(k == 2, "the ").otherwise(""), _name())
    language = F.when(k == 0, "eng").when((k == 1) | (k == 2), "fre").otherwise("eng")
    return _part(spark, sf_dir, skipped=F.when(k == 3, 0).otherwise(T.article_length(title, language)), surname=T.surname(_name()), forename=T.forename(_name()))


@query("SELECT p_partkey AS id, p_name AS accept, CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE 'old' END AS token, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END AS n FROM part")
def header_maps(spark, sf_dir):
    old = T.parse_headers(F.array(F.concat(F.lit("Accept: "), _name()), F.lit("Token:old")))
    new = F.when(_k() % 2 == 0, T.parse_headers(F.array(F.lit("Token : new"), F.lit("Via:a:b"))))
    return _part(spark, sf_dir, m=T.merge_maps(old, new)).select("id", F.col("m")["Accept"].alias("accept"), F.col("m")["Token"].alias("token"), F.size("m").alias("n"))


@query("SELECT p_partkey AS id, p_name || 'a' AS text, 1 + 2 * (p_partkey % 2) AS removed FROM part")
def clean_xml(spark, sf_dir):
    raw = F.concat(F.lit("\x1b(B"), _name(), F.when(_k() % 2 == 1, F.lit("\x01\x1b$*Ba")).otherwise(F.lit("a")))
    return _part(spark, sf_dir, c=T.sanitize_xml(raw)).select("id", "c.text", F.col("c.removed").cast("int").alias("removed"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN [p_name] ELSE CAST([] AS VARCHAR[]) END AS list FROM part")
def empty_lists(spark, sf_dir):
    return _part(spark, sf_dir, list=T.or_empty(F.when(_k() % 2 == 0, F.array(F.concat("p_name", F.lit("  ")))), trimmed=True))


_KINDS = [("empty", ""), ("refused", "badVerb: "), ("records", ""), ("other_format", "dc:title"), ("deletions", ""), ("no_records", ""), ("not_xml", "")]
_KIND_SQL = " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(_KINDS))


@query(f"""SELECT 'page' AS origin, page_id AS id, 'web_page' AS kind, '' AS detail FROM pages WHERE html IS NOT NULL
UNION ALL SELECT 'part', p_partkey, CASE p_partkey % 7 {_KIND_SQL} END, CASE p_partkey % 7 WHEN 1 THEN 'badVerb: ' || p_name WHEN 3 THEN 'dc:title' WHEN 6 THEN p_name ELSE '' END FROM part""")
def response_diagnosis(spark, sf_dir):
    """Web pages as they came, and a response of each other kind around the names of parts."""
    wrap = lambda *inner: F.concat(F.lit('<?xml version="1.0"?>\n<o:OAI-PMH xmlns:o="urn:o">'), *inner, F.lit("</o:OAI-PMH>"))
    name, gone = _name(), F.lit('<o:record><o:header status="deleted"/></o:record>')
    bodies = [
        F.lit(" \n"),
        wrap(F.lit('<o:error code="badVerb"> '), name, F.lit(" </o:error>")),
        wrap(F.lit('<o:record><o:header/><o:metadata><record><datafield tag="245"><subfield code="a">'), name, F.lit("</subfield></datafield></record></o:metadata></o:record>"), gone),
        wrap(F.lit("<o:record><o:header/><o:metadata> <dc:title>"), name, F.lit("</dc:title></o:metadata></o:record>")),
        wrap(gone, gone),
        wrap(F.lit("<o:header/>"), gone),
        F.concat(F.lit("\t"), name),
    ]
    body = F.element_at(F.array(*bodies), (_k() % 7 + 1).cast("int"))
    parts = _part(spark, sf_dir, d=diagnose(body)).select(F.lit("part").alias("origin"), "id", "d.kind", "d.detail")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("html is not null").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), diagnose(F.col("html")).alias("d"))
    return pages.select("origin", "id", "d.kind", "d.detail").unionByName(parts)


# records ----------------------------------------------------------------------------------------------------------


def _xml_field(tag, *subs, first=" ", second=" "):
    inner = [F.concat(F.lit(f'<subfield code="{c}">'), v, F.lit("</subfield>")) for c, v in subs]
    return F.concat(F.lit(f'<datafield tag="{tag}" ind1="{first}" ind2="{second}">'), *inner, F.lit("</datafield>"))


def _record(*fields, head=""):
    return F.concat(F.lit(f'<record xmlns="http://www.loc.gov/MARC21/slim"><leader>     nam a22     2  4500</leader>{head}'), *fields, F.lit("</record>"))


def rich_records(spark, sf_dir) -> DataFrame:
    """MARC 21 records with linked titles, two authors, notes and both publication fields; every fifth lacks a title."""
    title = F.when(_k() % 5 != 0, _xml_field("245", ("6", F.lit("880-01")), ("a", F.concat("p_name", F.lit(" /"))))).otherwise(F.lit(""))
    xml = _record(
        _xml_field("100", ("a", F.concat("p_brand", F.lit(",")))),
        title,
        _xml_field("260", ("b", F.lit("Old house,")), ("c", F.lit("1900"))),
        F.when(_k() % 2 == 0, _xml_field("264", ("b", F.concat("p_brand", F.lit(","))), ("c", F.lit("[2001]")))).otherwise(F.lit("")),
        _xml_field("505", ("a", F.lit("First --")), ("a", F.lit("second."))),
        _xml_field("520", ("a", F.lit("  "))),
        _xml_field("520", ("a", F.concat("p_type", F.lit(".")))),
        _xml_field("700", ("a", F.concat("p_type", F.lit(","))), ("d", F.lit("1900-"))),
        _xml_field("880", ("6", F.lit("245-02/(N")), ("a", F.lit("no"))),
        _xml_field("880", ("6", F.lit("245-01/(N")), ("a", F.concat(F.lit("книга "), _str(_k())))),
        _xml_field("999", ("a", F.lit("x"))),
    )
    return marc.dealt(A.table(spark, sf_dir, "part"), "p_partkey").select(_str(_k()).alias("source_record_id"), F.lit(False).alias("deleted"), marc.parse(xml).alias("rec"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS source_record_id, 'книга ' || p_partkey AS title_alternate, [regexp_replace(p_brand, '[\\s:/;,=.]+$', ''), p_type || ', 1900-'] AS authors, p_type AS summary, 'First -- second' AS contents, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Old house' END AS publisher, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2001 ELSE 1900 END AS SMALLINT) AS publication_year, CASE WHEN p_partkey % 2 = 0 THEN '264' ELSE '260' END AS publisher_from, ['999'] AS unmapped FROM part WHERE p_partkey % 5 <> 0")
def marc_details(spark, sf_dir):
    w = marc.works_batch(marc.map_records(rich_records(spark, sf_dir)))
    return w.select("source_record_id", "title_alternate", "authors", "summary", "contents", "publisher", "publication_year", F.col("provenance")["publisher"].alias("publisher_from"), "unmapped")


@query("SELECT CASE WHEN p_partkey % 5 = 0 THEN 'unmappable' ELSE 'mapped' END AS status, count(*) AS n FROM part GROUP BY 1")
def marc_unmappable(spark, sf_dir):
    return marc.counted(marc.map_records(rich_records(spark, sf_dir)))


@query("SELECT p_partkey % 3 AS kind, count(DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END) AS contents, count(DISTINCT CASE WHEN p_partkey % 3 = 1 THEN p_type ELSE '' END) AS items FROM part GROUP BY 1")
def marc_hashes(spark, sf_dir):
    """Of each kind, how many different hashes there are: kinds differ in which side of the record varies."""
    vary = lambda k: F.when(_k() % 3 == k, F.col("p_type")).otherwise(F.lit("same"))
    xml = _record(_xml_field("245", ("a", vary(0))), _xml_field("952", ("p", vary(1))))
    rows = marc.dealt(A.table(spark, sf_dir, "part"), "p_partkey").select((_k() % 3).alias("kind"), marc.parse(xml).alias("rec"))
    rows = rows.select("kind", marc.record_hash(F.col("rec"), "952", False).alias("c"), marc.record_hash(F.col("rec"), "952", True).alias("i"))
    return rows.groupBy("kind").agg(F.count_distinct("c").alias("contents"), F.count_distinct("i").alias("items"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS source_record_id, 'unimarc' AS flavour, p_name || ' : ' || p_brand AS title, [p_brand || ' ' || p_type] AS authors, p_brand AS publisher, CAST(1900 + p_size AS SMALLINT) AS publication_year, ['fre'] AS languages, CAST(p_partkey AS VARCHAR) AS barcode FROM part")
def unimarc_works(spark, sf_dir):
    """A vendor's notices, translated and mapped as UNIMARC."""
    f = lambda tag, *subs, ind="  ": F.concat(F.lit(f'<f c="{tag}" ind="{ind}">'), *[F.concat(F.lit(f'<s c="{c}">'), v, F.lit("</s>")) for c, v in subs], F.lit("</f>"))
    xml = F.concat(
        F.lit('<notice><rs>n</rs><dt>a</dt><bl>m</bl><hl>*</hl><el>1</el><f c="001">'),
        _str(_k()),
        F.lit("</f>"),
        f("101", ("a", F.lit("fre")), ind="0"),
        f("200", ("a", _name()), ("e", F.col("p_brand")), ind="1"),
        f("210", ("c", F.col("p_brand")), ("d", _str(1900 + F.col("p_size")))),
        f("700", ("a", F.col("p_brand")), ("b", F.col("p_type"))),
        f("995", ("f", _str(_k()))),
        F.lit("</notice>"),
    )
    rows = marc.dealt(A.table(spark, sf_dir, "part"), "p_partkey").select(_str(_k()).alias("source_record_id"), F.lit(False).alias("deleted"), marc.translate_vendor(xml).alias("rec"))
    w = marc.map_records(rows)
    return w.select("source_record_id", "work.flavour", "work.title", "work.authors", "work.publisher", "work.publication_year", "work.languages", F.get("work.items", F.lit(0))["barcode"].alias("barcode"))


@query("SELECT o_orderkey AS source_loan_id, CAST(o_custkey AS VARCHAR) AS biblio_id, o_orderkey % 2 AS renewals, o_orderkey % 5 = 0 AS is_current FROM orders WHERE o_orderkey % 7 <> 0")
def checkout_rows(spark, sf_dir):
    """Checkouts as the interface sends them; every seventh lacks its patron."""
    k = F.col("o_orderkey")
    row = F.struct(k.alias("checkout_id"), F.when(k % 7 != 0, F.col("o_custkey")).alias("patron_id"), F.lit("2024-01-02T03:04:05+00:00").alias("checkout_date"), F.when(k % 5 != 0, "2024-02-02T03:04:05+00:00").alias("checkin_date"), F.when(k % 2 == 1, 1).alias("renewals_count"), F.struct(F.struct(F.col("o_custkey").alias("biblio_id")).alias("biblio")).alias("item"))
    got = harvest.loans(A.table(spark, sf_dir, "orders").select(F.to_json(row).alias("value")), A.SECRET)
    return got.select("source_loan_id", "biblio_id", F.col("renewals").cast("bigint").alias("renewals"), "is_current")


@query("SELECT CAST(p_partkey AS VARCHAR) AS source_record_id, p_partkey % 4 = 0 AS deleted, p_partkey % 4 <> 0 AS has_xml FROM part")
def feed_records(spark, sf_dir):
    head = F.concat(F.when(_k() % 4 == 0, '<record><header status="deleted">').otherwise("<record><header>"), F.lit("<identifier>"), _str(_k()), F.lit("</identifier></header>"))
    one = F.concat(head, F.when(_k() % 4 != 0, F.concat(F.lit("<metadata>"), _record(_xml_field("245", ("a", _name()))), F.lit("</metadata>"))).otherwise(""), F.lit("</record>"))
    pages = A.table(spark, sf_dir, "part").select(F.lit("u").alias("url"), F.concat(F.lit("<ListRecords>"), one, F.lit("</ListRecords>")).alias("body"))
    return harvest.split_records(pages).select("source_record_id", "deleted", F.col("xml").isNotNull().alias("has_xml"))


@query("SELECT CASE WHEN p_partkey % 9 = 0 THEN 'deleted' WHEN p_partkey % 3 = 0 THEN 'flavour_change' ELSE 'mapped' END AS status, count(*) AS n FROM part GROUP BY 1")
def marc_flavours(spark, sf_dir):
    """A feed of MARC 21 in which every third record is UNIMARC."""
    xml = F.when(_k() % 3 == 0, _record(_xml_field("200", ("a", _name())))).otherwise(_record(_xml_field("245", ("a", _name()))))
    rows = marc.dealt(A.table(spark, sf_dir, "part"), "p_partkey").select(_str(_k()).alias("source_record_id"), (_k() % 9 == 0).alias("deleted"), marc.parse(xml).alias("rec"))
    return marc.counted(marc.map_records(rows, "marc21"))


# the library's database ---------------------------------------------------------------------------------------------


def _database(spark, sf_dir):
    """Parts as biblios (every 13th hidden, every 4th without its edition row), line items as copies, orders as issues."""
    p = A.table(spark, sf_dir, "part")
    biblio = p.select(_k().alias("biblionumber"), _name().alias("title"), F.when(_k() % 2 == 0, F.col("p_brand")).alias("subtitle"), F.when(_k() % 3 == 0, F.col("p_brand")).alias("author"), F.col("p_type").alias("abstract"), F.lit(None).cast("string").alias("notes"), F.lit(1950).alias("copyrightdate"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"), (_k() % 13 == 0).cast("int").alias("opac_suppressed"))
    editions = p.where(_k() % 4 != 0).select(_k().alias("biblionumber"), F.concat(F.lpad(_str(_k()), 10, "0"), F.lit(" | 12")).alias("isbn"), F.lit("1984").alias("publicationyear"), F.col("p_brand").alias("publishercode"))
    items = p.select((_k() * 10).alias("itemnumber"), _k().alias("biblionumber"), _str(_k()).alias("barcode"), F.lit("h").alias("homebranch"), F.lit("b").alias("holdingbranch"), F.lit("l").alias("location"), F.lit("c").alias("itemcallnumber"), F.lit("t").alias("itype"), F.when(_k() % 5 == 0, "2024-05-05").alias("onloan"), F.when(_k() % 2 == 0, 3).alias("issues"))
    return biblio, editions, items


@query("SELECT CAST(p_partkey AS VARCHAR) AS source_record_id, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' : ' || p_brand ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN [p_brand] ELSE CAST([] AS VARCHAR[]) END AS authors, p_type AS summary, CASE WHEN p_partkey % 4 <> 0 THEN [lpad(CAST(p_partkey AS VARCHAR), 10, '0')] ELSE CAST([] AS VARCHAR[]) END AS isbns, CASE WHEN p_partkey % 4 <> 0 THEN p_brand ELSE '' END AS publisher, CASE WHEN p_partkey % 4 <> 0 THEN 1984 ELSE 1950 END AS year FROM part WHERE p_partkey % 13 <> 0")
def database_works(spark, sf_dir):
    biblio, editions, _ = _database(spark, sf_dir)
    got = harvest.database_works(biblio, editions, since="2023-01-01")
    return got.select("source_record_id", "title", "authors", "summary", "isbns", "publisher", F.col("publication_year").cast("int").alias("year"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS source_record_id, sha256(CASE WHEN p_partkey % 2 = 0 THEN p_name || ' : ' || p_brand ELSE p_name END || chr(31) || CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END || chr(31) || p_type || chr(31) || chr(31) || CASE WHEN p_partkey % 4 <> 0 THEN lpad(CAST(p_partkey AS VARCHAR), 10, '0') ELSE '' END || chr(31) || CASE WHEN p_partkey % 4 <> 0 THEN p_brand ELSE '' END || chr(31) || CASE WHEN p_partkey % 4 <> 0 THEN '1984' ELSE '1950' END) AS content_hash, sha256(p_partkey || ':b:c:t:' || CASE WHEN p_partkey % 5 = 0 THEN '2024-05-05' ELSE '' END) AS items_hash FROM part WHERE p_partkey % 13 <> 0")
def database_hashes(spark, sf_dir):
    biblio, editions, items = _database(spark, sf_dir)
    got = harvest.database_hashes(harvest.database_works(biblio, editions), harvest.database_items(items, biblio))
    return got.select("source_record_id", "content_hash", "items_hash")


@query("SELECT o_orderkey AS source_loan_id, CAST(p_partkey AS VARCHAR) AS biblio_id, o_orderkey % 2 = 1 AS returned, o_orderkey % 3 AS renewals FROM orders JOIN part ON p_partkey = o_custkey WHERE p_partkey % 13 <> 0")
def database_loans(spark, sf_dir):
    biblio, _, items = _database(spark, sf_dir)
    k = F.col("o_orderkey")
    rows = A.table(spark, sf_dir, "orders").select(k.alias("issue_id"), (F.col("o_custkey") * 10).alias("itemnumber"), F.col("o_custkey").alias("borrowernumber"), F.col("o_orderdate").alias("issuedate"), F.when(k % 2 == 1, F.col("o_orderdate")).alias("returndate"), F.when(k % 3 != 0, k % 3).alias("renewals_count"))
    got = harvest.database_loans(rows.where("returndate is null"), rows.where("returndate is not null"), items, biblio, A.SECRET)
    return got.select("source_loan_id", "biblio_id", F.col("checked_in_at").isNotNull().alias("returned"), F.col("renewals").cast("bigint").alias("renewals"))


@query("SELECT CAST(doc_id AS VARCHAR) AS biblio_id, CAST(doc_id % 7 AS SMALLINT) AS rating FROM labels WHERE doc_id % 7 BETWEEN 1 AND 5")
def database_ratings(spark, sf_dir):
    rows = A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("borrowernumber"), F.col("doc_id").alias("biblionumber"), (F.col("doc_id") % 7).alias("rating_value"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"))
    return harvest.database_ratings(rows, A.SECRET).select("biblio_id", "rating")


@query(A.with_("works") + "SELECT id, title FROM works ORDER BY md5('42:' || coalesce(CAST(id AS VARCHAR), '')), id LIMIT 100")
def sampled_works(spark, sf_dir):
    """A seeded sample: the rows of the smallest digests."""
    return evaluation.sample(A.works(spark, sf_dir).select("id", "title"), 100, 42, "id")


@query()
def synthetic_loans(spark, sf_dir):
    return evaluation.loan_plan(A.works(spark, sf_dir), 200)


# Open Library and exports -----------------------------------------------------------------------------------------


def _dumps(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    words = F.concat_ws(" ", *["p_name"] * 8)
    author = F.struct(F.struct(F.concat(F.lit("/a/"), F.col("p_brand")).alias("key")).alias("author"))
    work = F.struct(_name().alias("title"), F.struct(words.alias("value")).alias("description"), F.when(_k() % 3 != 0, F.array(F.col("p_type"), F.col("p_brand"), F.lit(" "))).otherwise(F.array("p_type")).alias("subjects"), F.array(author).alias("authors"))
    works = p.select(F.concat(F.lit("/w/"), _str(_k())).alias("key"), F.to_json(work).alias("json"))
    isbn = F.concat(F.lit("978-"), F.lpad(_str(_k()), 10, "0"))
    language = lambda x: F.struct(F.concat(F.lit("/languages/"), x).alias("key"))
    edition = lambda n: F.struct(F.array(F.struct(F.concat(F.lit("/w/"), _str(_k())).alias("key"))).alias("works"), F.array(language(F.when((_k() % 5 == 0) | (F.lit(n) == 0), "ger").otherwise("eng"))).alias("languages"), F.array(F.lit("978"), isbn).alias("isbn_13"), F.array("p_brand").alias("publishers"), F.concat(F.lit("May "), _str(1950 + F.lit(n))).alias("publish_date"))
    editions = None
    for n in range(3):
        part = p.select(F.concat(F.lit("/e/"), _str(_k()), F.lit(f"-{n}")).alias("key"), F.to_json(edition(n)).alias("json"))
        editions = part if editions is None else editions.unionByName(part)
    authors = p.select("p_brand").distinct().where("p_brand <> 'Brand#11'").select(F.concat(F.lit("/a/"), F.col("p_brand")).alias("key"), F.to_json(F.struct(F.upper("p_brand").alias("name"))).alias("json"))
    return works, editions, authors


_SLICE = "SELECT '/w/' || p_partkey AS work_key, p_name AS title, [p_type, p_brand] AS subjects, '/e/' || p_partkey || '-1' AS edition_key, '978' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS isbn13, 'eng' AS language, p_brand AS publisher, 1951 AS year, CASE WHEN p_brand = 'Brand#11' THEN CAST([] AS VARCHAR[]) ELSE [upper(p_brand)] END AS authors FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND 8 * length(p_name) + 7 >= 80"


@query(_SLICE)
def open_library_slice(spark, sf_dir):
    """Eligible works, their first edition in a wanted language, and authors' names."""
    got = open_library.slice_of(*_dumps(spark, sf_dir), ["eng", "fre"])
    return got.select("work_key", "title", "subjects", "edition_key", "isbn13", "language", "publisher", F.col("year").cast("int").alias("year"), "authors")


@query("WITH s AS (" + _SLICE + ") SELECT edition_key, title, coalesce(authors[1], '') AS author, isbn13 AS isbn, subjects, publisher, 1951 AS publication_year, 'e' AS kind, split_part(edition_key, '/', -1) || '-1' AS barcode FROM s")
def exported_records(spark, sf_dir):
    """A slice written as ISO 2709, read back and mapped as MARC 21."""
    rows = open_library.slice_of(*_dumps(spark, sf_dir), ["eng", "fre"])
    text = iso2709.build_marc21(rows).select("edition_key", iso2709.iso2709(F.col("rec")).alias("text"))
    back = text.select(F.col("edition_key").alias("source_record_id"), F.lit(False).alias("deleted"), iso2709.read_iso2709(F.col("text")).alias("rec"))
    w = marc.map_records(back)
    # the relator of a name is no part of it, as its code isn't mapped
    return w.select(F.col("source_record_id").alias("edition_key"), "work.title", F.coalesce(F.get("work.authors", F.lit(0)), F.lit("")).alias("author"), F.get("work.isbns", F.lit(0)).alias("isbn"), "work.subjects", "work.publisher", F.col("work.publication_year").cast("int").alias("publication_year"), F.lit("e").alias("kind"), F.get("work.items", F.lit(0))["barcode"].alias("barcode"))


@query("WITH s AS (" + _SLICE + ") SELECT edition_key, title, subjects, publisher FROM s")
def exported_unimarc(spark, sf_dir):
    rows = open_library.slice_of(*_dumps(spark, sf_dir), ["eng", "fre"])
    text = iso2709.build_unimarc(rows).select("edition_key", iso2709.marcxml(F.col("rec")).alias("xml"))
    w = marc.map_records(text.select(F.col("edition_key").alias("source_record_id"), F.lit(False).alias("deleted"), marc.parse(F.col("xml")).alias("rec")))
    return w.select(F.col("source_record_id").alias("edition_key"), "work.title", "work.subjects", "work.publisher")


# vectors ----------------------------------------------------------------------------------------------------------


@query(
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
    "h AS (SELECT vec_id, [v[1:8], v[9:16], v[17:24]] AS h, [1, 1, vec_id % 2] AS m FROM e), "
    "p AS (SELECT vec_id, list_transform(range(1, 9), lambda d: (h[1][d] + h[2][d] + m[3] * h[3][d]) / (2 + m[3])) AS mean, v FROM h JOIN e USING (vec_id)), "
    "u AS (SELECT vec_id, list_transform(mean, lambda x: x / sqrt(list_sum(list_transform(mean, lambda y: y * y)))) AS core, v[25:32] AS d FROM p), "
    "a AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN core ELSE list_transform(range(1, 9), lambda i: (core[i] + d[i]) / 2) END AS x, vec_id % 3 = 0 AS bare FROM u) "
    "SELECT vec_id, round(CASE WHEN bare THEN x[1] ELSE x[1] / sqrt(list_sum(list_transform(x, lambda y: y * y))) END, 6) AS first FROM a"
)
def pooled_vectors(spark, sf_dir):
    """Three token vectors pooled by a mask, and the mean with a description's vector."""
    e = A.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    hidden, mask = F.array(*[F.slice("v", i, 8) for i in (1, 9, 17)]), F.array(F.lit(1), F.lit(1), (F.col("vec_id") % 2).cast("int"))
    core = encode.pooled_column(hidden, mask)
    x = encode.averaged(core, F.when(F.col("vec_id") % 3 != 0, F.slice("v", 25, 8)))
    return e.select("vec_id", F.round(F.get(x, F.lit(0)), 6).alias("first"))


@query(
    A.with_("probes").rstrip() + ", s AS (SELECT probe, work_id, list_dot_product(vector, probe_vector) AS a, list_dot_product(vector[1:32], probe_vector[1:32]) AS b FROM lemb, probes WHERE work_id <> probe), "
    "r AS (SELECT probe, work_id, row_number() OVER (PARTITION BY probe ORDER BY a DESC, work_id) AS ra, row_number() OVER (PARTITION BY probe ORDER BY b DESC, work_id) AS rb FROM s), "
    "p AS (SELECT probe, count(*) FILTER (WHERE ra <= 10 AND rb <= 10) / 10.0 AS share, max(CASE WHEN ra = 1 AND rb = 1 THEN 1.0 ELSE 0.0 END) AS first FROM r GROUP BY 1) "
    "SELECT count(*) AS probes, round(avg(share), 6) AS overlap, round(avg(first), 6) AS top1 FROM p"
)
def ranking_agreement(spark, sf_dir):
    """How far half of the components give the ranking of all."""
    e = A.live_embeddings(spark, sf_dir)
    cut = e.withColumn("vector", F.slice("vector", 1, 32))
    rows = lambda x: vectors.nearest(x.where("work_id % 10 = 0").select(F.col("work_id").alias("probe"), F.col("vector").alias("probe_vector"), F.col("source_id").alias("probe_source")), x, 10)
    got = evaluation.agreement(rows(e), rows(cut))
    return got.select("probes", F.round("overlap", 6).alias("overlap"), F.round("top1", 6).alias("top1"))
