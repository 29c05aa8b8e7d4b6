"""The corpus pipeline: quality, near-duplicates, benchmark contamination, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's rows as Parquet in the shared folder and reads them back as the
next stage's docs. All stages but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import decontam, mixing, near_dedup, quality, secrets
from lodestack.llm.common import read, remove, shared_dir


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier rejects; it is trained on the labelled rows of documents.

    Every row is judged by its own text, repeated ones and those without a
    doc_id too; a null or empty text is judged as no bytes.
    """
    return quality.keep_good(docs, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles, that of the smallest doc_id.

    Rows that share a doc_id are documents of their own; rows without words are
    near to nothing; rows without a doc_id all stay.
    """
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark item. Rows with a null or empty text stay, as does everything without items."""
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the secrets in their texts masked and n_chars brought up to date. No row goes; null texts stay null."""
    return secrets.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with block, slot and position in the mixture of sources. No row goes; a null source is one of its own."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scan", mask_secrets),
    ("source mixture", mixture),
]

#: SQL can't express the classifier, the sketches and the lexer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; the last stage's rows. A stage's rows are removed once the next one's are written.

    An empty table goes through all stages and stays empty.
    """
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("errorifexists").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
