"""The queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, chunk_dedup, decontaminate, mil, minhash, oracles, packing, resample, sharding, style_tree, suffix_dedup, sweep, transducer
from .common import documents


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).select(*packing.COLUMNS)


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.remove_repeated_chunks(documents(spark, sf_dir)).drop("kept")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats_and_mark(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "carried.n_passages", "carried.n_passage_bytes")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(sharding.shard(documents(spark, sf_dir).select("doc_id", "text")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.unionByName(extra)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transducer.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op12_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, lines, clients = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "sale_lines", "clients"))
    states = sweep.concurrency(sweep.open_sales(sales, lines, clients), everything=-2)
    seconds = lambda c: (F.col(c) * 60).alias({"at": "from_s", "next_at": "to_s"}[c])
    return states.select(F.col("key").alias("nation_id"), seconds("at"), seconds("next_at"), F.col("n").alias("n_open"), F.col("value").alias("open_cents"), F.col("high_n").alias("high_open"), "is_peak")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_main_text, op2_packing, op3_chunk_dedup, op4_nearest, op5_decontaminate, op6_suffix_dedup, op7_sharding, op8_minhash, op9_chat_format, op10_quality, op11_bpe_transducer, op12_peak_concurrency, op13_importance_resampling)}
ORACLE_SQL: dict[str, str] = {"op5_decontaminate": oracles.OP5, "op8_minhash": oracles.OP8, "op9_chat_format": oracles.OP9, "op12_peak_concurrency": oracles.OP12, "op13_importance_resampling": oracles.OP13}
