"""A training corpus from raw documents: five of the operators of stacklight.llm, one after another.

Each stage takes (spark, docs, sf_dir), docs being all that its predecessor kept, and returns a DataFrame, which run() writes
as Parquet and reads again for the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.llm import decontaminate, mil, minhash, packing, suffix_dedup
from stacklight.llm.common import documents, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REPEAT_BYTES, PASSAGE_WORDS = 200, 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects (score under 0.5)."""
    model = mil.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mil.score(docs, model, keep=COLUMNS).where("score >= 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: the one with the smallest id, rows without one last.

    Every row is a vertex of its own, whatever its id: of equal rows one stays, rows of one id with different texts are judged
    by their texts, and rows without an id take part. Rows without words group with nothing, so all of them stay."""
    # the key is written with its row, so that every pass reads the same one
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "pipeline-rows")
    groups = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    kept = rows.select("row", "doc_id").join(groups.hint("merge"), "row").groupBy("component_id").agg(first.alias("first")).select("first.row")
    return rows.join(kept.hint("merge"), "row", "left_semi").select(COLUMNS)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that repeat: runs of repeated REPEAT_BYTES-byte strings that hold PASSAGE_WORDS words, or 400 bytes. All
    copies go. A document left empty goes; bytes of a cut character go with it.

    REPEAT_BYTES is the least size of a passage of PASSAGE_WORDS words whose words have three letters in the mean; shorter ones
    are missed. Shorter runs stay: phrases of that size are shared by clean texts. Documents that came in null or empty lost
    nothing: they stay as they are."""
    rest = suffix_dedup.remove_repeats(docs.withColumn("no_text", F.col("text").isNull()), length=REPEAT_BYTES, carry=["lang", "source", "no_text"], least_words=PASSAGE_WORDS)
    kept = rest.where("n_removed = 0 or kept_text <> ''").withColumn("text", F.when(~F.col("carried.no_text"), F.col("kept_text")))
    return kept.select("doc_id", "text", "carried.lang", "carried.source", F.char_length("text").cast("long").alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    The verdict is the text's (by its 64-bit hash), not the id's: rows without an id are judged, and a clean row stays where
    another text of its id goes."""
    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    found = decontaminate.contamination(rows.select(F.col("text_hash").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dirty = found.where("contaminated").select(F.col("doc_id").alias("text_hash")).distinct()
    return rows.join(dirty, "text_hash", "left_anti").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row for each piece of a document, with its token ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("suffix-array dedup", repeated_text), ("decontamination", benchmark_passages), ("packing", pack)]
#: The classifier is trained and the suffix stage works on bytes; neither has an SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
