"""The driver's tables as the catalogue's relations, for Spark, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gram_index as grams
from ..operators import vectors

SECRET = "a test secret"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark, sf_dir):
    flag = F.when(F.col("n_regionkey") == 0, F.lit(None).cast("boolean")).when(F.col("n_regionkey") == 1, False).otherwise(True)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), flag.alias("last_had_items"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey").cast("int")).cast("timestamp").alias("last_harvest"))


def works(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    prefixed = F.concat(F.lit("other "), "p_name")
    gone = F.when(F.col("p_partkey") % 97 == 0, F.lit("2024-01-01").cast("timestamp"))
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("source_id"), F.concat(F.lit("CAT-"), "p_brand", F.lit(":"), F.col("p_partkey").cast("string")).alias("source_record_id"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.col("p_brand").alias("publisher"), F.when(F.col("p_partkey") % 10 != 0, F.array("p_type")).alias("subjects"), F.when(F.col("p_partkey") % 3 == 0, prefixed).otherwise("").alias("title_alternate"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise("").alias("summary"), F.lit("").alias("contents"), (1900 + F.col("p_size")).cast("smallint").alias("publication_year"), F.when(F.col("p_partkey") % 7 != 0, F.array(F.lit("fre "), F.lit("eng"))).alias("languages"), F.array(F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("isbns"), F.sha2(F.concat_ws("\x1f", "p_name", "p_type"), 256).alias("content_hash"), gone.alias("deleted_at"))


_built: dict[tuple[str, str], grams.GramIndex] = {}


def gram_index(spark, sf_dir) -> grams.GramIndex:
    """The trigram index of the works, built once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = grams.build(works(spark, sf_dir))
    return _built[key]


def items(spark, sf_dir):
    due = F.when(F.col("l_linestatus") == "O", F.col("l_shipdate"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("owning_branch"), due.alias("due_date"))


def loans(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(o, "l_orderkey")
    return rows.select(F.col("o_custkey").cast("string").alias("patron_ref"), F.col("l_partkey").alias("work_id"), (F.col("l_returnflag") == "R").cast("int").alias("renewals"))


def events_loans(spark, sf_dir):
    """A sparser matrix: purchases by user and the number in their properties."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(F.col("user_id").cast("string").alias("patron_ref"), F.get_json_object("props", "$.k").cast("long").alias("work_id"), F.lit(0).alias("renewals")).where("work_id is not null")


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("work_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("source_id"), (F.col("vec_id") % 3 == 0).alias("is_title_only"))


def live_embeddings(spark, sf_dir):
    return vectors.of_live_works(embeddings(spark, sf_dir), works(spark, sf_dir))


_blocks = vectors.VectorCache()


def live_blocks(spark, sf_dir) -> vectors.Blocks:
    """The live vectors in blocks, packed once for each application and folder while they stay as they are."""
    return _blocks.blocks(f"{spark.sparkContext.applicationId} {sf_dir}", live_embeddings(spark, sf_dir), "work_id")


def live_factors(spark, sf_dir):
    return vectors.of_live_works(factors(spark, sf_dir), works(spark, sf_dir))


def factors(spark, sf_dir):
    """Stand-in factors, the first eight components, for three works of four."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 4 <> 0")
    return e.select(F.col("vec_id").alias("work_id"), F.slice("embedding", 1, 8).cast("array<double>").alias("factors"), (F.col("vec_id") % 7).alias("n_patrons"), F.date_add(F.lit("2024-03-01").cast("date"), (F.col("vec_id") % 9).cast("int")).cast("timestamp").alias("trained_at"))


CTE = {
    "sources": "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_regionkey = 0 THEN NULL WHEN n_regionkey = 1 THEN false ELSE true END AS last_had_items, CAST(DATE '2024-01-01' + CAST(n_nationkey AS INT) AS TIMESTAMP) AS last_harvest FROM nation",
    "works": "SELECT p_partkey AS id, p_size % 5 AS source_id, 'CAT-' || p_brand || ':' || p_partkey AS source_record_id, p_name AS title, [p_brand] AS authors, p_brand AS publisher, CASE WHEN p_partkey % 10 <> 0 THEN [p_type] END AS subjects, CASE WHEN p_partkey % 3 = 0 THEN 'other ' || p_name ELSE '' END AS title_alternate, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE '' END AS summary, '' AS contents, CAST(1900 + p_size AS SMALLINT) AS publication_year, CASE WHEN p_partkey % 7 <> 0 THEN ['fre ', 'eng'] END AS languages, [lpad(CAST(p_partkey AS VARCHAR), 10, '0')] AS isbns, sha256(p_name || chr(31) || p_type) AS content_hash, CASE WHEN p_partkey % 97 = 0 THEN TIMESTAMP '2024-01-01' END AS deleted_at FROM part",
    "live": "SELECT * FROM works WHERE deleted_at IS NULL",
    "items": "SELECT l_partkey AS work_id, l_suppkey AS owning_branch, CASE WHEN l_linestatus = 'O' THEN l_shipdate END AS due_date FROM lineitem",
    "loans": "SELECT CAST(o_custkey AS VARCHAR) AS patron_ref, l_partkey AS work_id, CAST(l_returnflag = 'R' AS INT) AS renewals FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "interactions": "SELECT patron_ref, work_id, count(*) AS n_loans, CAST(coalesce(sum(renewals), 0) AS BIGINT) AS n_renewals FROM loans GROUP BY ALL",
    "purchases": "SELECT CAST(user_id AS VARCHAR) AS patron_ref, CAST(json_extract_string(props, '$.k') AS BIGINT) AS work_id, count(*) AS n_loans, CAST(0 AS BIGINT) AS n_renewals FROM events WHERE event_type = 'purchase' AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL",
    "emb": "SELECT vec_id AS work_id, CAST(embedding AS DOUBLE[]) AS vector, label AS source_id, vec_id % 3 = 0 AS is_title_only FROM embeddings",
    "fac": "SELECT vec_id AS work_id, CAST(embedding[1:8] AS DOUBLE[]) AS factors, vec_id % 7 AS n_patrons, CAST(DATE '2024-03-01' + CAST(vec_id % 9 AS INT) AS TIMESTAMP) AS trained_at FROM embeddings WHERE vec_id % 4 <> 0",
    "lemb": "SELECT emb.* FROM emb JOIN live ON live.id = work_id",
    "lfac": "SELECT fac.* FROM fac JOIN live ON live.id = work_id",
    "probes": "SELECT work_id AS probe, vector AS probe_vector, source_id AS probe_source FROM lemb WHERE work_id % 10 = 0",
}
NEEDS = {"live": ["works"], "interactions": ["loans"], "lemb": ["works", "live", "emb"], "lfac": ["works", "live", "fac"], "probes": ["works", "live", "emb", "lemb"]}


def with_(*names: str) -> str:
    """WITH those relations and what they need."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, []), n) if x not in order]
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in order) + " "
