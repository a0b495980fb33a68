"""Catalogue records as MARCXML structs and as ISO 2709 bytes, for fixtures and exports.

build_marc21 and build_unimarc give records of the struct that operators.marc reads; iso2709() serialises them, read_iso2709()
reads them back. Serialising counts bytes per record and stays in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Terminators of subfields, fields and records (fixed values).
SUBFIELD, FIELD, RECORD = "\x1f", "\x1e", "\x1d"
LEADER_MARC21, LEADER_UNIMARC = "     nam a22     4a 4500", "     nam  22        450 "
#: What existing exports write for the agency of a number, the unknown part of 008 and its end, the collection, and the most subjects
#: and characters of a summary (fixed values).
AGENCY, REST_OF_008, END_OF_008, COLLECTION, MOST_SUBJECTS, MOST_SUMMARY = "OL", "    xx            000 0 ", " d", "GEN", 10, 4000
DATA = "array<struct<_tag:string,_ind1:string,_ind2:string,subfield:array<struct<_code:string,_VALUE:string>>>>"


def subfields(*pairs: tuple[str, Column]) -> Column:
    """An array of the pairs with a non-empty value."""
    return F.filter(F.array(*[F.struct(F.lit(c).alias("_code"), v.cast("string").alias("_VALUE")) for c, v in pairs]), lambda s: F.coalesce(s["_VALUE"], F.lit("")) != "")


def field(tag: str, first: str | Column, second: str | Column, *pairs: tuple[str, Column]) -> Column:
    """One data field in an array; none without a subfield."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    sub = subfields(*pairs)
    return F.when(F.size(sub) > 0, F.array(F.struct(F.lit(tag).alias("_tag"), lit(first).alias("_ind1"), lit(second).alias("_ind2"), sub.alias("subfield")))).otherwise(F.array().cast(DATA))


def each(tag: str, first: str, second: str, values: Column, *pairs) -> Column:
    """A field for each value of an array; pairs: functions value -> (code, value)."""
    return F.transform(values, lambda v: F.struct(F.lit(tag).alias("_tag"), F.lit(first).alias("_ind1"), F.lit(second).alias("_ind2"), subfields(*[p(v) for p in pairs]).alias("subfield")))


def _parts(r: str = ""):
    c = lambda n: F.col(f"{r}{n}")
    authors = F.filter(T.or_empty(c("authors")), lambda a: a != "")
    title = F.coalesce(T.nullify(T.strip(F.coalesce(c("edition_title"), F.lit("")))), c("title"))
    number = F.split_part(c("edition_key"), F.lit("/"), F.lit(-1))
    year = F.when(c("year").isNotNull(), F.lpad(c("year").cast("string"), 4, "0"))
    return c, authors, title, number, year


def build_marc21(slice_: DataFrame, branch: str = "CPL", item_type: str = "BK", copies: int = 1, entered: str = "700101") -> DataFrame:
    """Records (edition_key, rec) of a slice: title with its nonfiling count, authors, publication, summary, at most ten subjects, a
    952 field for each copy. entered: the date of entry in 008."""
    c, authors, title, number, year = _parts()
    control = lambda tag, v: F.struct(F.lit(tag).alias("_tag"), v.alias("_VALUE"))
    fixed = F.rpad(F.left(F.concat(F.lit(f"{entered}s"), F.coalesce(year, F.lit("    ")), F.lit(REST_OF_008), c("language"), F.lit(END_OF_008)), F.lit(40)), 40, " ")
    subtitle = T.strip(F.coalesce(c("subtitle"), F.lit("")))
    items = [field("952", " ", " ", ("a", F.lit(branch)), ("b", F.lit(branch)), ("y", F.lit(item_type)), ("p", F.concat(number, F.lit(f"-{i + 1}"))), ("o", F.right(c("isbn13"), F.lit(6))), ("7", F.lit("0")), ("8", F.lit(COLLECTION))) for i in range(copies)]
    data = F.concat(
        field("020", " ", " ", ("a", c("isbn13"))),
        field("041", "0", " ", ("a", c("language"))),
        F.when(F.size(authors) > 0, field("100", "1", " ", ("a", F.get(authors, F.lit(0))), ("e", F.lit("author")))).otherwise(F.array().cast(DATA)),
        field("245", "1", T.article_length(title, c("language")).cast("string"), ("a", F.when(subtitle != "", F.concat(title, F.lit(" :"))).otherwise(title)), ("b", subtitle), ("c", F.array_join(authors, ", "))),
        field("264", " ", "1", ("b", c("publisher")), ("c", c("year").cast("string"))),
        field("300", " ", " ", ("a", F.concat(c("pages").cast("string"), F.lit(" pages")))),
        field("520", " ", " ", ("a", F.left(F.regexp_replace(c("description"), r"\s+", " "), F.lit(MOST_SUMMARY)))),
        each("650", " ", "4", F.slice(T.or_empty(c("subjects")), 1, MOST_SUBJECTS), lambda s: ("a", s)),
        each("700", "1", " ", F.slice(authors, 2, 3), lambda a: ("a", a), lambda a: ("e", F.lit("author"))),
        field("942", " ", " ", ("2", F.lit("ddc")), ("c", F.lit(item_type))),
        *items,
    )
    head = F.array(control("001", number), control("003", F.lit(AGENCY)), control("008", fixed))
    return slice_.select("edition_key", F.struct(F.lit(LEADER_MARC21).alias("leader"), head.alias("controlfield"), data.alias("datafield")).alias("rec"))


def build_unimarc(slice_: DataFrame, branch: str = "CPL", item_type: str = "BK", copies: int = 1) -> DataFrame:
    """The same as UNIMARC: names split into surname and forenames, 010, 101, 200, 210, 215, 330, 606, 700, 701, 995."""
    c, authors, title, number, year = _parts()
    name = lambda a: (("a", T.surname(a)), ("b", T.forename(a)))
    first = F.get(authors, F.lit(0))
    items = [field("995", " ", " ", ("b", F.lit(branch)), ("c", F.lit(branch)), ("f", F.concat(number, F.lit(f"-{i + 1}"))), ("k", F.right(c("isbn13"), F.lit(6))), ("r", F.lit(item_type))) for i in range(copies)]
    data = F.concat(
        field("010", " ", " ", ("a", c("isbn13"))),
        field("101", "0", " ", ("a", c("language"))),
        field("200", "1", " ", ("a", title), ("e", c("subtitle")), ("f", F.array_join(authors, ", "))),
        field("210", " ", " ", ("c", c("publisher")), ("d", c("year").cast("string"))),
        field("215", " ", " ", ("a", F.concat(c("pages").cast("string"), F.lit(" p.")))),
        field("330", " ", " ", ("a", F.left(F.regexp_replace(c("description"), r"\s+", " "), F.lit(MOST_SUMMARY)))),
        each("606", " ", " ", F.slice(T.or_empty(c("subjects")), 1, MOST_SUBJECTS), lambda s: ("a", s)),
        F.when(F.size(authors) > 0, field("700", " ", "1", *name(first))).otherwise(F.array().cast(DATA)),
        each("701", " ", "1", F.slice(authors, 2, 3), lambda a: name(a)[0], lambda a: name(a)[1]),
        *items,
    )
    head = F.array(F.struct(F.lit("001").alias("_tag"), number.alias("_VALUE")))
    return slice_.select("edition_key", F.struct(F.lit(LEADER_UNIMARC).alias("leader"), head.alias("controlfield"), data.alias("datafield")).alias("rec"))


def marcxml(rec: Column) -> Column:
    """The record as MARCXML; text is escaped."""
    safe = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    control = F.array_join(F.transform(rec["controlfield"], lambda f: F.concat(F.lit('<controlfield tag="'), f["_tag"], F.lit('">'), safe(f["_VALUE"]), F.lit("</controlfield>"))), "")
    sub = lambda s: F.concat(F.lit('<subfield code="'), s["_code"], F.lit('">'), safe(s["_VALUE"]), F.lit("</subfield>"))
    data = F.array_join(F.transform(rec["datafield"], lambda f: F.concat(F.lit('<datafield tag="'), f["_tag"], F.lit('" ind1="'), f["_ind1"], F.lit('" ind2="'), f["_ind2"], F.lit('">'), F.array_join(F.transform(f["subfield"], sub), ""), F.lit("</datafield>"))), "")
    return F.concat(F.lit('<record xmlns="http://www.loc.gov/MARC21/slim"><leader>'), rec["leader"], F.lit("</leader>"), control, data, F.lit("</record>"))


def iso2709(rec: Column) -> Column:
    """The record as ISO 2709 text (UTF-8 when written): leader with lengths, directory, fields. Null where a field passes 9,999 bytes
    or the record 99,999, which the format can't hold."""
    bare = lambda x: F.translate(F.coalesce(x, F.lit("")), SUBFIELD + FIELD + RECORD, "   ")
    control = F.transform(rec["controlfield"], lambda f: F.struct(f["_tag"].alias("tag"), F.concat(bare(f["_VALUE"]), F.lit(FIELD)).alias("body")))
    sub = lambda s: F.concat(F.lit(SUBFIELD), s["_code"], bare(s["_VALUE"]))
    data = F.transform(rec["datafield"], lambda f: F.struct(f["_tag"].alias("tag"), F.concat(f["_ind1"], f["_ind2"], F.array_join(F.transform(f["subfield"], sub), ""), F.lit(FIELD)).alias("body")))
    fields = F.concat(control, data)
    size = lambda x: F.octet_length(x)
    pad = lambda n, k: F.lpad(n.cast("string"), k, "0")
    start = F.struct(F.lit("").alias("dir"), F.lit(0).alias("at"), F.lit(False).alias("long"))
    listed = F.aggregate(fields, start, lambda acc, f: F.struct(F.concat(acc["dir"], f["tag"], pad(size(f["body"]), 4), pad(acc["at"], 5)).alias("dir"), (acc["at"] + size(f["body"])).alias("at"), (acc["long"] | (size(f["body"]) > 9999)).alias("long")))
    base = F.lit(24) + 12 * F.size(fields) + 1
    total = base + listed["at"] + 1
    leader = F.concat(pad(total, 5), F.substring(rec["leader"], 6, 7), pad(base, 5), F.substring(F.rpad(rec["leader"], 24, " "), 18, 7))
    text = F.concat(leader, listed["dir"], F.lit(FIELD), F.array_join(F.transform(fields, lambda f: f["body"]), ""), F.lit(RECORD))
    return F.when(~listed["long"] & (total <= 99_999), text)


def read_iso2709(text: Column) -> Column:
    """The struct of a record that iso2709() wrote: fields are cut at their terminators, in the directory's order."""
    tags = F.split_part(F.substr(text, F.lit(25)), F.lit(FIELD), F.lit(1))
    n = F.floor(F.length(tags) / 12).cast("int")
    bodies = F.slice(F.split(F.substr(text, F.lit(25) + F.length(tags) + 1), FIELD), F.lit(1), n)
    named = F.transform(bodies, lambda b, i: F.struct(F.substr(tags, i * 12 + 1, F.lit(3)).alias("tag"), b.alias("body")))
    is_control = lambda f: f["tag"].startswith("00")
    control = F.transform(F.filter(named, is_control), lambda f: F.struct(f["tag"].alias("_tag"), f["body"].alias("_VALUE")))
    subs = lambda b: F.transform(F.slice(F.split(b, SUBFIELD), 2, 10_000), lambda s: F.struct(F.left(s, F.lit(1)).alias("_code"), F.substr(s, F.lit(2)).alias("_VALUE")))
    data = F.transform(F.filter(named, lambda f: ~is_control(f)), lambda f: F.struct(f["tag"].alias("_tag"), F.substring(f["body"], 1, 1).alias("_ind1"), F.substring(f["body"], 2, 1).alias("_ind2"), subs(f["body"]).alias("subfield")))
    return F.struct(F.left(text, F.lit(24)).alias("leader"), control.alias("controlfield"), data.alias("datafield"))
