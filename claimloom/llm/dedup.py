"""Exact deduplication with skew-safe combining. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import table, written

WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """text (null: empty) without its ASCII white space."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def exact_dedup(docs: DataFrame, salts: int = 32, digest=lambda norm: F.sha2(norm, 256)) -> DataFrame:
    """Groups of documents whose texts are equal but for white space: doc_id, keep_id, group_size, kept, digest.

    1. Each map task combines its own copies (partial aggregation on digest, salt and content).
    2. Each of the salted groups of a digest combines what the map tasks found: a group of copies is spread over `salts` tasks.
    3. The winners of the salts, at most `salts` rows for each content, are combined globally.
    Every stage groups by the whole normalised content beside the digest, so two contents of one digest stay apart.
    Membership then goes by digest alone, unless stage 3 met contents that share a digest: those are looked up by content too.

    The row with most code points stays, then the smallest doc_id (null last). Null text counts as empty; empty texts are equal.
    Repeated rows are copies of each other, and each gets its row; a doc_id on several equal rows is kept on all of them.
    An empty table gives no rows. Other columns are not read.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        normalised(F.col("text")).alias("norm"),
        F.char_length(F.coalesce(F.col("text"), F.lit(""))).alias("chars"),
    ).withColumn("digest", digest(F.col("norm")))
    best = F.struct(F.col("chars"), F.bitwise_not(F.col("doc_id")).alias("neg"))  # larger for smaller ids, and null loses
    salted = (
        own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "norm")
        .agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("n"))
    )
    winners = (
        salted.select("digest", "norm", "best", "n")
        .repartition("digest")
        .groupBy("digest", "norm")
        .agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
        .withColumn("contents", F.count(F.lit(1)).over(Window.partitionBy("digest")))
    )
    classes = written(
        winners.select(
            "digest",
            F.when(F.col("contents") > 1, F.col("norm")).alias("norm"),
            F.bitwise_not(F.col("best.neg")).alias("keep_id"),
            "group_size",
        ),
        "dedup-classes",
    )
    plain, clashing = classes.where(F.col("norm").isNull()).drop("norm"), classes.where(F.col("norm").isNotNull())
    ids = own.select("doc_id", "digest")
    out = ids.join(plain, "digest")
    if not clashing.isEmpty():
        out = out.unionByName(own.select("doc_id", "digest", "norm").join(clashing, ["digest", "norm"]).drop("norm"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents),
g AS (
  SELECT norm, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id
  FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
