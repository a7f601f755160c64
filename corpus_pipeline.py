"""A corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secrets, token ids.

Null and empty texts have no words and go with the first stage, as all texts below its thresholds. Rows without a doc_id are
judged like others, but name no group of near-copies and are never dropped as one. Rows that repeat a doc_id are one document:
they stay or go together. Of a group of near-copies the smallest doc_id stays. Very long texts pass every stage whole. An empty
table gives an empty result. Other columns of documents, whatever their names, pass through all stages but the last, which
returns ids and digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from formlake.llm import decontaminate, quality_rules, secret_scan, simhash_dedup, token_codec
from formlake.llm.durable import stage_folder
from formlake.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, the one of the smallest doc_id."""
    return simhash_dedup.first_of_groups(docs).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    model = secret_scan.learn(secret_scan.labelled_findings(spark), secret_scan.corpus_words(docs))
    return secret_scan.redact(docs, model, path="source").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of their decoding, of every document left."""
    return token_codec.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_dedup", near_copies),
    ("decontaminate", decontaminated),
    ("secret_scan", without_secrets),
    ("bpe_codec", token_ids),
]

#: SQL cannot express the fingerprints, the forest and the merges; tests hold run() against an independent version in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`; each result is written as Parquet in a shared folder and read as the next one's documents."""
    docs, folder = table(spark, sf_dir, "documents"), stage_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{folder}/{k}_{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
