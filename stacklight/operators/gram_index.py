"""A stored inverted index of trigrams, probed by its rare grams only and completed exactly.

A field that shares at least k of a query's n grams holds one of any n - k + 1 of them. So only the n - k + 1 rarest are looked up:
the long lists of common grams, which nearly every query has, are never read into the join. What they find is completed from
the fields' own gram lists. The index is three tables: how many fields hold each gram; the lists, in rows of bounded length; the
fields. Lists and fields are bucketed by their keys, so that a search shuffles its own rows and not the index.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold, gram_sequence, searchable_authors
from .catalog import live
from .state import new_path, task_count

#: Fields of one row of a gram's list.
LIST_ROWS = 4096


@dataclass(frozen=True)
class GramIndex:
    """frequencies (gram, df); lists (gram, held: array of id, is_title); fields (id, is_title, source_id, n, grams in order)."""

    frequencies: DataFrame
    lists: DataFrame
    fields: DataFrame


def fields_of(works: DataFrame) -> DataFrame:
    """id, is_title, source_id, n (different grams), grams (in the order of the text, repeats included) of live works' titles and
    authors; fields without any gram have no row."""
    texts = F.array(F.struct(F.lit(True).alias("is_title"), fold(F.col("title")).alias("text")), F.struct(F.lit(False).alias("is_title"), searchable_authors(F.col("authors")).alias("text")))
    source = F.col("source_id") if "source_id" in works.columns else F.lit(None).cast("int").alias("source_id")
    rows = live(works).select("id", source, F.inline(texts)).withColumn("grams", gram_sequence(F.col("text")))
    return rows.select("id", "is_title", "source_id", F.size(F.array_distinct("grams")).alias("n"), "grams").where("n > 0")


def _stored(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """df as a table of its own, bucketed and sorted by key."""
    name = f"gram_index_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def build(works: DataFrame, buckets: int | None = None) -> GramIndex:
    """The index of live works, written to the shared folder. buckets: for how many tasks its tables are dealt (by default as many as
    a shuffle has)."""
    spark: SparkSession = works.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, "gram-index")
    fields = _stored(fields_of(works), f"{path}/fields", "id", n)
    held = fields.select("id", "is_title", F.explode(F.array_distinct("grams")).alias("gram"))
    frequencies = held.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    frequencies.write.parquet(f"{path}/frequencies")
    frequencies = spark.read.schema(frequencies.schema).parquet(f"{path}/frequencies")
    # a frequent gram's list is cut by its fields' ids, so that no row and no task holds all of it
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / LIST_ROWS)).alias("part")
    rows = held.join(frequencies, "gram").groupBy("gram", part).agg(F.collect_list(F.struct("id", "is_title")).alias("held"))
    return GramIndex(frequencies, _stored(rows.select("gram", "held"), f"{path}/lists", "gram", n), fields)


def asked(queries: DataFrame) -> DataFrame:
    """number, query, grams of the distinct queries (query) that have grams."""
    q = queries.select("query").distinct().select(F.xxhash64("query").alias("number"), "query", F.array_distinct(gram_sequence(fold(F.col("query")))).alias("grams"))
    return q.where(F.size("grams") > 0)


def rare_grams(q: DataFrame, index: GramIndex, least: float) -> DataFrame:
    """number, gram: of each query (number, grams) its rarest grams, as many as a field that holds `least` of them can't all lack."""
    n = F.size("grams")
    enough = n - F.greatest(F.lit(1), F.ceil(F.lit(least) * n - 1e-9)) + 1
    rows = q.select("number", enough.alias("enough"), F.explode("grams").alias("gram"))
    # grams that no field holds are the rarest; they find nothing
    order = Window.partitionBy("number").orderBy(F.coalesce("df", F.lit(0)), "gram")
    return rows.join(index.frequencies, "gram", "left").withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("enough")).where("df IS NOT NULL").select("number", "gram")


def candidates(q: DataFrame, index: GramIndex, least: float, source_id: int | None = None) -> DataFrame:
    """q (number, query, grams) -> query, query_grams, id, is_title, grams (in order), shared, n of each field that holds at least
    `least` of the query's grams; source_id: of that source's works only."""
    probes = rare_grams(q, index, least)
    met = index.lists.join(probes, "gram").select("number", F.inline("held")).distinct()
    fields = index.fields if source_id is None else index.fields.where(F.col("source_id") == source_id)
    # dealt by a stated number: comparing grams costs far more than the rows' bytes, by which adaptive execution would gather them
    pairs = fields.join(met, ["id", "is_title"]).repartition(task_count(q.sparkSession), "number", "id")
    both = pairs.join(q.withColumnRenamed("grams", "query_grams"), "number")
    shared = F.size(F.array_intersect("query_grams", "grams"))
    return both.withColumn("shared", shared).where(F.col("shared") >= F.lit(least) * F.size("query_grams")).select("query", "query_grams", "id", "is_title", "grams", "shared", "n")
