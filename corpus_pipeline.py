"""The corpus pipeline. Each stage takes and returns a table of documents; it is written and read again between stages.

Of rows that share a doc_id each text is taken or left by itself, equal ones together; of null doc_ids each row is. Null texts count as empty, and go in the first stage. An
empty table stays empty. Other columns are kept as they are, whatever their names, until packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm import dedup, jaccard, langid, packing, pii
from claimloom.llm.common import made, removed, written

#: No SQL: language ID and packing have none. tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def _keep(docs: DataFrame, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of docs whose doc_id is in kept(docs). Where some are null or repeated, rows are numbered in the order of doc_id, null last, in a
    table, and kept() gets the numbers in place of doc_id: one for each row of a null doc_id and for each text of another."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count()
    if ids.where("doc_id IS NULL OR count > 1").isEmpty():
        own = kept(docs).select(F.col("doc_id").alias("__kept_id"))
        return docs.join(own, docs["doc_id"] == own["__kept_id"], "left_semi")
    row = "__row"
    while row in docs.columns:
        row += "_"
    known, number = F.col("doc_id").cast("long"), F.monotonically_increasing_id()
    rows = written(docs.withColumn(row, number).orderBy(known.asc_nulls_last(), row).withColumn(row, number), "rows")
    same = Window.partitionBy(known, "text", F.when(known.isNull(), F.col(row)))
    rows = rows.withColumn(row, F.min(row).over(same))
    own = kept(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("__kept_id"))
    return rows.join(own, rows[row] == own["__kept_id"], "left_semi").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told: those without a letter go. lang is as predicted; the models are learnt from docs."""
    found = langid.language_id(docs, keep=True).where(F.col("lang_pred") != langid.UND)
    return found.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return _keep(docs, lambda own: dedup.exact_dedup(own).where("kept").select("doc_id"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one of smallest doc_id."""
    return _keep(docs, lambda own: jaccard.jaccard_components(own).where("doc_id = component_id").select("doc_id"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with pseudonyms for what is private. n_chars is that of the new text. The key is the session's
    spark.claimloom.pii.key; only where it is unset, that of the registered queries, which is no secret."""
    out = pii.pseudonymised(docs, spark.conf.get("spark.claimloom.pii.key", pii.QUERY_KEY))
    return out.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their ids."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after another. What a stage read and made on its way is deleted once its result is a table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = made()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
            removed(spark, made()[len(begun) : -1])
    return docs
