"""What a response is, told by Spark columns over its text, so that a whole log of responses is classified as one column is."""

from __future__ import annotations

import re
from xml.parsers import expat

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import ESCAPES, ILLEGAL, strip

#: What to do about a response of each kind.
ADVICE = {
    "records": "the response holds MARC records",
    "empty": "nothing came back; ask the repository's operator whether the service runs",
    "web_page": "a web page came back: the address is that of a site, or the service is switched off",
    "not_xml": "what came back is no XML",
    "refused": "the repository refuses the request",
    "other_format": "the records are in another format than MARC; ask for a metadata prefix that gives MARC",
    "deletions": "there are only headers of deleted records",
    "no_records": "there is a response, but no record in it",
}
#: Characters of a body that tell a web page, and of one that are shown.
LOOK_AT, SHOW = 512, 60


def _start(name: str) -> str:
    """The start tag of an element, under any prefix."""
    return rf"<(?:[\w.-]+:)?{name}(?=[\s/>])"


def diagnose(body: Column) -> Column:
    """kind (a key of ADVICE) and detail: the refusal's code and text, the other format's elements, or the beginning."""
    text = strip(F.coalesce(body, F.lit("")))
    head = F.lower(F.left(text, F.lit(LOOK_AT)))
    code = F.regexp_extract(text, _start("error") + r"""[^>]*\bcode=["']([^"']*)""", 1)
    reason = F.regexp_extract(text, _start("error") + r"[^>]*>([^<]*)<", 1)
    payloads = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(_start("metadata") + r"[^>]*>\s*<([\w.:-]+)"), F.lit(1))))
    of_marc = text.rlike(f"{_start('datafield')}|{_start('controlfield')}|{_start('notice')}")
    headers, deleted = (F.regexp_count(text, F.lit(_start("header") + more)) for more in ("", r"""[^>]*\bstatus=["']deleted"""))
    cases = [
        ("empty", text == "", ""),
        ("web_page", head.rlike(r"<(?:!doctype\s+)?html\b"), ""),
        ("not_xml", ~text.startswith("<"), F.left(text, F.lit(SHOW))),
        ("refused", code != "", F.concat_ws(": ", code, F.nullif(strip(reason), F.lit("")))),
        ("records", of_marc, ""),
        ("other_format", F.size(payloads) > 0, F.array_join(payloads, ", ")),
        ("deletions", (headers > 0) & (headers == deleted), ""),
    ]
    found = F.struct(F.lit("no_records").alias("kind"), F.lit("").alias("detail"))
    for kind, holds, detail in reversed(cases):
        found = F.when(holds, F.struct(F.lit(kind).alias("kind"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))).otherwise(found)
    return found


def advice(found: Column) -> Column:
    """A sentence for what diagnose() found."""
    says = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])[found["kind"]]
    return F.when(found["detail"] != "", F.concat(says, F.lit(" ("), found["detail"], F.lit(")"))).otherwise(says)


def broken_at(payload: bytes) -> str:
    """Where and why a payload isn't well-formed XML; empty if it is."""
    try:
        expat.ParserCreate().Parse(payload, True)
    except expat.ExpatError as e:
        return str(e)
    return ""


def readable(payload: bytes) -> tuple[str, int]:
    """The text of a response for the reader of a page, and how many characters had to go for it to parse; a payload that parses
    is left alone. Raises ValueError for one that doesn't parse even so."""
    removed = 0
    if broken_at(payload):
        for pattern in (ESCAPES, ILLEGAL):
            payload, n = re.subn(pattern.encode(), b"", payload)
            removed += n
        if why := broken_at(payload):
            kind = "empty" if not payload.strip() else "web_page" if re.search(rb"<(?:!doctype\s+)?html\b", payload[:LOOK_AT], re.I) else "not_xml"
            raise ValueError(f"{kind}: {ADVICE[kind]}; {why}")
    return payload.decode("utf-8", "replace"), removed
