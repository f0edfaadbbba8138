"""From raw documents to packed sequences.

Every stage works on all that the one before kept, written as Parquet and read
again. All but the last return the columns of the table they were given.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wavecrate.llm import decontam, exact_dedup, langid, packing, shingle_links
from wavecrate.llm.scratch import drop, materialize, tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language's model accepts go."""
    return langid.accepted_rows(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for blanks one stays."""
    return exact_dedup.unique_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a Jaccard similarity of 0.8 or more one stays: the least id's."""
    return shingle_links.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Models, fingerprint components and token ids are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the table of documents.

    Null, empty and repeated texts, ties and further columns are treated as each
    stage's operator says; an empty table gives an empty result. When a stage's
    rows are written, what was written for it and before it in this run is removed.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = tables(spark)
    for name, stage in STAGES[:-1]:
        rows = stage(spark, docs, sf_dir)
        used = tables(spark) - others
        docs = materialize(rows, name)
        drop(spark, used)
    return STAGES[-1][1](spark, docs, sf_dir)
