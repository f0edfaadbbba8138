"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrate.llm import exact_dedup as exact
from wavecrate.llm import decontam, htmltext, langid, packing, pii, runs, secrets, sharding, simhash, substring_dedup, variants, warc
from wavecrate.llm.scratch import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_linked_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_read(spark, sf_dir, "documents")).drop("row_key")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).drop("row_key", "root")


def op3_anchored_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_read(spark, sf_dir, "documents")).drop("row_key")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_read(spark, sf_dir, "documents")).drop("row_key")


def op5_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_read(spark, sf_dir, "documents")).drop("row_key")


def op6_consensus_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(_read(spark, sf_dir, "pages"))


def op7_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("row_key")


def op8_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(_read(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents")).drop("row_key")


def op11_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.write_archive(_read(spark, sf_dir, "pages"), f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}")
    return warc.read_archive(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_lpf_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    texts = docs.select("doc_id", runs.planted(F.col("doc_id"), F.col("text")).alias("text"))
    return runs.digests(runs.periodic_runs(texts)).drop("row_key")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.word_counts(_read(spark, sf_dir, "documents"), variants.misspelt))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_linked_secret_scan,
        op2_simhash_near_dedup,
        op3_anchored_pii,
        op4_exact_dedup,
        op5_sentence_span_dedup,
        op6_consensus_html_text,
        op7_spaced_seed_decontamination,
        op8_kd_tree_sharding,
        op9_nnls_packing,
        op10_kneser_ney_langid,
        op11_sharded_warc,
        op12_lpf_word_runs,
        op13_spelling_variants,
    )
}

ORACLE_SQL: dict[str, str] = {"op4_exact_dedup": exact.ORACLE}
