"""Training-corpus pipeline: quality, near-duplicates, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.llm import bagminhash, decontaminate, pii, quality, sentencepiece
from keystrand.llm._shared import delete, table
from keystrand.operators.reads import numbered


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score is at least 0.5."""
    return quality.keep_good(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class; rows without an id stay, rows equal in id and text become one.

    Where an id has several texts, every (id, text) is a member of its own, numbered in order of ids, so each is judged.
    The kept ids grow with the input, so they are merged and never broadcast, at any size.
    """
    known = docs.where("doc_id is not null")
    key = F.coalesce(F.sha2("text", 256), F.lit(""))
    pairs = known.select("doc_id", key.alias("_key")).distinct()
    if pairs.groupBy("doc_id").count().where("count > 1").isEmpty():
        members = known.withColumn("_member", F.col("doc_id"))
    else:
        numbers, _ = table(numbered(pairs, "doc_id", "_key", name="_member"), "members")
        members = known.withColumn("_key", key).join(numbers.hint("merge"), ["doc_id", "_key"])
    found = bagminhash.near_duplicates(members.select(F.col("_member").alias("doc_id"), "text"))
    kept = found.where("doc_id = class_id").select(F.col("doc_id").alias("_member"))
    one = members.join(kept.hint("merge"), "_member", "left_semi").dropDuplicates(["_member"])
    return one.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of any benchmark item occurs.

    One whole window is a verbatim passage, and most leaked passages come from one item; a document need not hold two.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.mask(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, checked by decoding."""
    return sentencepiece.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", token_stage),
]

#: A trained classifier and signatures with a verified similarity join: not SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = table(stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
