"""OAI-PMH and circulation feeds as Python data sources, and file and database readers."""

from __future__ import annotations

import datetime
import json
import pathlib
import re
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import text as T
from ..functions.hashing import flat_hash, patron_reference
from .diagnosis import advice, diagnose, readable


def fetch(url: str, headers: dict[str, str] | None = None, attempts: int = 4, backoff: float = 2.0, opener=urllib.request.urlopen) -> tuple[bytes, dict[str, str]]:
    """Body and headers. Transport errors and 5xx are tried again after backoff ** attempt seconds; 4xx is final."""
    for attempt in range(attempts):
        try:
            with opener(urllib.request.Request(url, headers=headers or {}), timeout=60) as r:
                return r.read(), dict(r.headers)
        except urllib.error.HTTPError as e:
            if e.code < 500 or attempt == attempts - 1:
                raise
        except (urllib.error.URLError, TimeoutError):
            if attempt == attempts - 1:
                raise
        time.sleep(backoff**attempt)
    raise AssertionError


def token_of(body: str) -> str | None:
    """The resumption token of a page; blank and absent both end the list."""
    m = re.search(r"<(?:\w+:)?resumptionToken[^>]*>([^<]*)<", body)
    return (m[1].strip() or None) if m else None


def error_of(body: str) -> str | None:
    m = re.search(r"<(?:\w+:)?error\s+code=\"(\w+)\"[^>]*>([^<]*)<", body)
    return f"{m[1]}: {m[2]}" if m else None


class Endpoint(InputPartition):
    def __init__(self, url, params):
        self.url, self.params = url, params


def list_records(options: dict[str, str], params: dict[str, str]):
    """(url, body, removed) of each page of a list, following its tokens: a token is sent alone, a blank one or none ends the list.
    A page that doesn't parse is cleaned of escapes and illegal characters (removed counts them) and parsed once more. The options
    maxpages and maxseconds end a list early."""
    pages, most = 0, int(options.get("maxpages", 1 << 30))
    until = time.monotonic() + float(options.get("maxseconds", "inf"))
    while params and pages < most and time.monotonic() < until:
        url = f"{options['url']}?{urllib.parse.urlencode(params)}"
        body, removed = readable(fetch(url, json.loads(options.get("headers", "{}")))[0])
        if (error := error_of(body)) and not error.startswith("noRecordsMatch"):
            raise ValueError(error)
        yield url, body, removed
        pages += 1
        token = token_of(body)
        params = {"verb": "ListRecords", "resumptionToken": token} if token else None


def seconds(stamp: str) -> int:
    """A protocol date or time (UTC) as seconds since 1970."""
    return int(datetime.datetime.fromisoformat(stamp.replace("Z", "+00:00") if "T" in stamp else f"{stamp}T00:00:00+00:00").timestamp())


def stamp(at: int) -> str:
    return datetime.datetime.fromtimestamp(at, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def slices(first: int, last: int, days: float) -> list[tuple[str, str]]:
    """The seconds from first to last, both included, as slices of so many days that don't overlap: (from, until)."""
    step = max(1, int(days * 86_400))
    return [(stamp(at), stamp(min(at + step - 1, last))) for at in range(first, last + 1, step)]


class OaiReader(DataSourceReader):
    """A page a row. The tokens of a list are sequential, so a list is one task; with the option slicedays a list from `from` on (until
    `until`, or now) is asked for in slices of so many days, each a list and a task of its own, which is read again if its
    executor is lost. A record that changes meanwhile moves to a later slice, so it may be missed until the next pull."""

    def __init__(self, options):
        self.options = dict(options)

    def partitions(self, **dates):
        given = {k: self.options[k] for k in ("from", "until") if k in self.options} | dates
        base = {"verb": "ListRecords", "metadataPrefix": self.options.get("metadataprefix", "marc21")}
        sets = [s for s in self.options.get("sets", "").split(",") if s] or [None]
        spans = [given]
        if "slicedays" in self.options:
            if "from" not in given:
                raise ValueError("slicedays needs from")
            last = seconds(given["until"]) + (0 if "T" in given["until"] else 86_399) if "until" in given else int(time.time())
            spans = [{"from": a, "until": z} for a, z in slices(seconds(given["from"]), last, float(self.options["slicedays"]))]
        return [Endpoint(self.options["url"], base | span | ({"set": s} if s else {})) for s in sets for span in spans]

    def read(self, part):
        yield from list_records(self.options, part.params)


class OaiStreamReader(DataSourceStreamReader):
    """Incremental pulls: the offset is the time up to which changes were asked for, and a batch starts one second after that. With
    the option maxdays a batch asks for so many days at most, so a long absence is made up for in batches of bounded size; it needs
    `from`, and progress, a file that the driver keeps of the time up to which it gave out batches, since Spark doesn't tell a
    reader where a restarted query stands. slicedays cuts a batch into tasks. Changes of the last `settle` seconds (5) wait for the next batch, as a repository
    may still be writing them."""

    def __init__(self, options):
        self.pages, own = OaiReader(options), options
        self.settle = int(own.get("settle", "5"))
        self.most = max(1, int(float(own["maxdays"]) * 86_400)) if "maxdays" in own else None
        self.progress = pathlib.Path(own["progress"].removeprefix("file://")) if "progress" in own else None
        if self.most is not None and ("from" not in own or self.progress is None):
            raise ValueError("maxdays needs from and progress")

    def initialOffset(self):
        since = self.pages.options.get("from", "")
        return {"until": stamp(seconds(since) - 1) if since else ""}

    def latestOffset(self):
        """Up to now, or maxdays after what was given out before."""
        now = int(time.time()) - self.settle
        if self.most is not None:
            before = self.progress.read_text() if self.progress.exists() else self.initialOffset()["until"]
            now = min(now, seconds(before) + self.most)
            draft = self.progress.with_suffix(".draft")
            draft.write_text(stamp(now))
            draft.replace(self.progress)
        return {"until": stamp(now)}

    def partitions(self, start, end):
        if start["until"]:
            first = seconds(start["until"]) + 1
            if first > seconds(end["until"]):
                return [Endpoint(self.pages.options["url"], {})]  # nothing yet
            return self.pages.partitions(**{"from": stamp(first)}, until=end["until"])
        return self.pages.partitions(until=end["until"])

    def read(self, part):
        yield from self.pages.read(part)


class OaiSource(DataSource):
    """spark.read (or readStream) .format("oai_pmh").option("url", ...).load(): url, body, removed."""

    @classmethod
    def name(cls):
        return "oai_pmh"

    def schema(self):
        return "url string, body string, removed int"

    def reader(self, schema):
        return OaiReader(self.options)

    def streamReader(self, schema):
        return OaiStreamReader(self.options)


class CheckoutReader(DataSourceReader):
    """Two partitions, current and returned checkouts; follows rel="next"."""

    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [Endpoint(self.options["url"], {}), Endpoint(self.options["url"], {"checked_in": "true"})]

    def read(self, part):
        url = part.url + (f"?{urllib.parse.urlencode(part.params)}" if part.params else "")
        while url:
            try:
                body, headers = fetch(url, json.loads(self.options.get("headers", "{}")))
            except urllib.error.HTTPError as e:
                why = {401: "the credentials are refused", 403: "the account may not list checkouts"}.get(e.code)
                raise ValueError(f"{e.code}: {why}") if why else e from e
            for row in json.loads(body):
                yield (json.dumps(row),)
            m = re.search(r'<([^>]*)>;\s*rel="?next"?', headers.get("Link", ""))
            url = m[1] if m else None


class CheckoutSource(DataSource):
    """spark.read.format("checkouts").option("url", ...).load(): value, a JSON string for each checkout."""

    @classmethod
    def name(cls):
        return "checkouts"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return CheckoutReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OaiSource)
    spark.dataSource.register(CheckoutSource)


CHECKOUT = "checkout_id bigint, patron_id bigint, checkout_date string, checkin_date string, renewals_count int, item struct<biblio: struct<biblio_id: bigint>>"


def loans(checkouts: DataFrame, secret: str) -> DataFrame:
    """Pseudonymised loans of JSON checkouts; rows without checkout, patron or biblio are dropped, bad dates are null."""
    c = checkouts.select(F.from_json("value", CHECKOUT).alias("c")).select("c.*")
    c = c.where(F.col("checkout_id").isNotNull() & F.col("patron_id").isNotNull() & F.col("item.biblio.biblio_id").isNotNull())
    return c.select(F.col("checkout_id").alias("source_loan_id"), F.col("item.biblio.biblio_id").cast("string").alias("biblio_id"), patron_reference(F.col("patron_id"), secret).alias("patron_ref"), F.try_to_timestamp("checkout_date").alias("checked_out_at"), F.try_to_timestamp("checkin_date").alias("checked_in_at"), F.coalesce("renewals_count", F.lit(0)).alias("renewals"), F.col("checkin_date").isNull().alias("is_current"))


def split_records(pages: DataFrame) -> DataFrame:
    """Pages (url, body) to records: place in the page, source_record_id, deleted, xml (the payload; null for deletions)."""
    record = F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<(?:\w+:)?record>\s*<(?:\w+:)?header.*?</(?:\w+:)?header>(?:\s*<(?:\w+:)?metadata>.*?</(?:\w+:)?metadata>)?"), F.lit(0)))
    r = pages.select(record.alias("place", "r"))
    return r.select("place", T.strip(F.regexp_extract("r", r"<(?:\w+:)?identifier>([^<]*)<", 1)).alias("source_record_id"), F.col("r").rlike(r"<(?:\w+:)?header[^>]*status=.deleted").alias("deleted"), F.nullif(F.regexp_extract("r", r"(?s)<(?:\w+:)?metadata>\s*(.*?)\s*</(?:\w+:)?metadata>", 1), F.lit("")).alias("xml"))


def response_flavour(records: DataFrame, sample: int = 5) -> str:
    """The flavour of a response by its first records (place, rec); raises where they disagree or none is readable. What can't be
    told is passed over if another can."""
    from ..operators import marc

    first = records.orderBy("place").limit(sample).select(marc.flavour(F.col("rec")).alias("kind"))
    kinds = sorted(r["kind"] for r in first.where("kind is not null").distinct().collect())
    if len(kinds) != 1:
        raise ValueError(f"the sampled records disagree on the flavour: {kinds}" if kinds else "no sampled record tells its flavour")
    return kinds[0]


def preflight(spark: SparkSession, options: dict[str, str], expect_items: bool = False) -> dict:
    """Whether an endpoint can be harvested: it identifies itself, offers the metadata prefix, gives a first page of one flavour, and
    holds items if it did before (else going on would delete them all). Raises ValueError with the reason; -> flavour, prefixes,
    records, items."""
    from ..operators import marc

    ask = lambda **params: readable(fetch(f"{options['url']}?{urllib.parse.urlencode(params)}", json.loads(options.get("headers", "{}")))[0])[0]
    prefix = options.get("metadataprefix", "marc21")
    try:
        for verb in ("Identify", "ListMetadataFormats"):
            body = ask(verb=verb)
            if error := error_of(body):
                raise ValueError(error)
        prefixes = [p.strip() for p in re.findall(r"<(?:\w+:)?metadataPrefix>([^<]*)<", body)]
        if prefix not in prefixes:
            raise ValueError(f"the endpoint doesn't offer {prefix}; it offers {prefixes or 'none'}")
        page = next(list_records(options | {"maxpages": "1"}, {"verb": "ListRecords", "metadataPrefix": prefix}))
    except OSError as e:
        raise ValueError(f"the endpoint isn't ready: {e}") from e
    first = spark.createDataFrame([page], "url string, body string, removed int")
    rows = split_records(first)
    xml = F.col("xml")
    record = F.when(xml.rlike(r"<(?:\w+:)?notice[\s>]"), marc.translate_vendor(xml)).otherwise(marc.parse(xml))
    rows = rows.where("xml is not null").select("place", record.alias("rec")).where(F.size("rec.datafield") > 0)
    n = rows.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.size(marc.fields(F.col("rec"), "952"))), F.lit(0)).alias("marc21"), F.coalesce(F.sum(F.size(marc.fields(F.col("rec"), "995"))), F.lit(0)).alias("unimarc")).first()
    if not n["records"]:
        raise ValueError(first.select(advice(diagnose(F.col("body"))).alias("why")).first()["why"])
    flavour = response_flavour(rows)
    if expect_items and not n[flavour]:
        raise ValueError(f"no items in the first {n['records']} records, but the last run found some")
    return {"flavour": flavour, "prefixes": prefixes, "records": n["records"], "items": n[flavour]}


def open_library(spark: SparkSession, path: str) -> DataFrame:
    """A dump of tab-separated lines (gzip or plain): key, json of lines with exactly five fields."""
    parts = F.split("value", "\t", 5)
    return spark.read.text(path).where(F.size(parts) == 5).select(parts[1].alias("key"), parts[4].alias("json"))


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 8, since=None, changed: str = "timestamp", **options) -> DataFrame:
    """A table of the library's database; filters and columns are pushed down to it.

    key: a number column by whose ranges the table is read in as many queries as `partitions`; its least and largest value are asked
    for first, one row. since: only rows with `changed` later than that, which the database sifts out. Rows with a null key are in
    the first range."""
    given = {"url": url, "fetchsize": "1000"} | options
    reader = spark.read.format("jdbc").options(**given)
    if key is not None:
        bounds = spark.read.format("jdbc").options(**given).option("query", f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {table}")
        low, high = bounds.load().first()
        if low is not None and high > low:
            # the upper bound is that of the last range's start, so one more keeps the ranges even
            reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(min(partitions, high - low + 1)))
    rows = reader.option("dbtable", table).load()
    return rows if since is None else rows.where(F.col(changed) > F.lit(since).cast(rows.schema[_named(rows, changed)].dataType))


def _named(df: DataFrame, column: str) -> str:
    """The column's name as the database spells it."""
    return next(c for c in df.columns if c.lower() == column.lower())


#: The tables of the library's database that are read, and the number columns by which they are split.
DATABASE = {"biblio": "biblionumber", "biblioitems": "biblioitemnumber", "items": "itemnumber", "issues": "issue_id", "old_issues": "issue_id", "ratings": "borrowernumber"}


def database(spark: SparkSession, url: str, since=None, partitions: int = 8, **options) -> dict[str, DataFrame]:
    """The library's tables by name, column names in lower case, each read in ranges of its key. since: biblio and ratings changed
    later than that only."""
    return {t: (df := jdbc(spark, url, t, key, partitions, since if t in ("biblio", "ratings") else None, **options)).toDF(*map(str.lower, df.columns)) for t, key in DATABASE.items()}


def database_works(biblio: DataFrame, biblioitems: DataFrame, since=None) -> DataFrame:
    """Visible biblios with their edition fields, optionally changed since a time."""
    b = biblio.where("opac_suppressed = 0")
    b = b.where(F.col("timestamp") > F.lit(since)) if since is not None else b
    rows = b.join(biblioitems, "biblionumber", "left")
    text = lambda c: T.strip(F.coalesce(c, F.lit("")))
    author = text("author")
    return rows.select(
        F.col("biblionumber").cast("string").alias("source_record_id"),
        T.merge_subtitle(F.col("title"), F.col("subtitle")).alias("title"),
        F.when(author != "", F.array(author)).otherwise(F.array().cast("array<string>")).alias("authors"),
        text("abstract").alias("summary"),
        text("notes").alias("contents"),
        T.split_isbns(F.col("isbn")).alias("isbns"),
        T.clip(text("publishercode"), 255).alias("publisher"),
        T.leading_year(F.col("publicationyear").cast("string"), F.col("copyrightdate").cast("string")).alias("publication_year"),
        F.col("timestamp").alias("modified"),
    )


def database_items(items: DataFrame, biblio: DataFrame) -> DataFrame:
    """The copies of visible biblios."""
    rows = items.join(biblio.where("opac_suppressed = 0").select("biblionumber"), "biblionumber")
    names = {"biblionumber": "source_record_id", "homebranch": "owning_branch", "holdingbranch": "holding_branch", "itemcallnumber": "call_number", "itype": "item_type", "onloan": "due_date"}
    return rows.select(F.col("biblionumber").cast("string").alias("source_record_id"), "barcode", *[F.col(a).alias(b) for a, b in names.items() if a != "biblionumber"], "location", F.coalesce("issues", F.lit(0)).alias("issue_count"))


def database_hashes(works: DataFrame, items: DataFrame) -> DataFrame:
    """works with content_hash, over the bibliographic fields, and items_hash, over those of its copies in the order of their
    barcodes: a copy that moves doesn't change the content."""
    one = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("barcode", "holding_branch", "call_number", "item_type", "due_date")])
    copies = items.groupBy("source_record_id").agg(F.array_join(F.array_sort(F.collect_list(one)), "\x1f").alias("copies"))
    rows = works.join(copies, "source_record_id", "left")
    content = flat_hash(F.col("title"), F.array_join("authors", "|"), F.col("summary"), F.col("contents"), F.array_join("isbns", "|"), F.col("publisher"), F.col("publication_year"))
    return rows.withColumns({"content_hash": content, "items_hash": F.sha2(F.coalesce("copies", F.lit("")), 256)}).drop("copies")


def database_ratings(ratings: DataFrame, secret: str) -> DataFrame:
    """Ratings of the library's database, pseudonymised; values outside 1 to 5 are dropped, as the store refuses them."""
    rows = ratings.where(F.col("rating_value").between(1, 5))
    return rows.select(patron_reference(F.col("borrowernumber"), secret).alias("patron_ref"), F.col("biblionumber").cast("string").alias("biblio_id"), F.col("rating_value").cast("smallint").alias("rating"), F.col("timestamp").alias("rated_at"))


def database_loans(issues: DataFrame, old_issues: DataFrame, items: DataFrame, biblio: DataFrame, secret: str, history: bool = True) -> DataFrame:
    """Current and past loans with their biblio, pseudonymised."""
    every = issues.unionByName(old_issues) if history else issues
    rows = every.join(items.select("itemnumber", "biblionumber"), "itemnumber").join(biblio.where("opac_suppressed = 0").select("biblionumber"), "biblionumber")
    return rows.select(F.col("issue_id").alias("source_loan_id"), F.col("biblionumber").cast("string").alias("biblio_id"), patron_reference(F.col("borrowernumber"), secret).alias("patron_ref"), F.col("issuedate").alias("checked_out_at"), F.col("returndate").alias("checked_in_at"), F.coalesce("renewals_count", F.lit(0)).alias("renewals"))
