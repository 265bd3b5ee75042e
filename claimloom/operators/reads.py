"""Reads over documents, facts and relations: pages of rows, counts and feeds.

Limits are what a reader asked for. Ties are broken by ids. Null fields match no search; documents without facts, blocks or
rejections count none; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.validation import canonical_detail


def document_counts(documents: DataFrame, facts: DataFrame, rejected: DataFrame) -> DataFrame:
    """Documents with their facts and rejections counted; each side is grouped before the join."""
    f = facts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_facts"))
    r = rejected.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rejected"))
    return documents.join(f, "doc_id", "left").join(r, "doc_id", "left").fillna(0, ["n_facts", "n_rejected"])


def facts_found(facts: DataFrame, q: str | None = None, doc_id: int | None = None, attribute: str | None = None, period: str | None = None, least: float = 0.0, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of facts by id, with the number that match in all."""
    own = facts.where(F.col("confidence") >= least)
    if q:
        own = own.where(" or ".join(f"contains(lower({c}), lower(:q))" for c in ("subject", "attribute", "value_raw", "evidence_quote")).replace(":q", "'" + q.replace("\\", "\\\\").replace("'", "\\'") + "'"))
    if doc_id is not None:
        own = own.where(F.col("doc_id") == doc_id)
    if attribute:
        own = own.where(F.contains(F.lower("attribute"), F.lit(attribute.lower())))
    if period:
        own = own.where(F.col("period_label") == period)
    total = own.agg(F.count(F.lit(1)).alias("total"))
    return own.orderBy("id").offset(offset).limit(limit).join(F.broadcast(total))


def neighbours(fact_id: int, relations: DataFrame) -> DataFrame:
    """A fact's edges with the fact at the other end: two equi filters, not one with OR."""
    a = relations.where(F.col("fact_a") == fact_id).withColumn("other", F.col("fact_b"))
    return a.unionByName(relations.where((F.col("fact_b") == fact_id) & (F.col("fact_a") != fact_id)).withColumn("other", F.col("fact_a")))


def _holds(column: str, q: str):
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(q.lower()))


def browsed(relations: DataFrame, facts: DataFrame, kind: str | None = None, cross_document: bool = False, q: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of edges with both facts, surest first; UNRELATED only where asked for. q is looked for in the first fact's subject and
    attribute, both values and the explanation, whatever its case."""
    own = relations.where(F.col("type") == kind if kind else F.col("type") != "UNRELATED")
    f = facts.select("id", "doc_id", "value_raw", "period_label", "subject", "attribute")
    own = own.join(f.toDF("fact_a", "doc_a", "value_a", "period_a", "subject", "attribute"), "fact_a").join(f.drop("subject", "attribute").toDF("fact_b", "doc_b", "value_b", "period_b"), "fact_b")
    if q:
        columns = [c for c in ("subject", "attribute", "value_a", "value_b", "explanation") if c in own.columns]
        hit = F.lit(False)
        for c in columns:
            hit = hit | _holds(c, q)
        own = own.where(hit)
    if cross_document:
        own = own.where("doc_a <> doc_b")
    return own.orderBy(F.desc("confidence"), "fact_a", "fact_b", "type").offset(offset).limit(limit)


def rejection_summary(rejected: DataFrame) -> DataFrame:
    """Rejections by reason and detail, what one case is about folded away."""
    return rejected.groupBy("reason", canonical_detail(F.col("detail")).alias("detail")).agg(F.count(F.lit(1)).alias("n"))


def review_feed(facts: DataFrame, limit: int = 60) -> DataFrame:
    """The least sure facts: under 0.6, or found only by the fuzzy gate."""
    return facts.where((F.col("confidence") < 0.6) | (F.col("grounding") == "fuzzy")).orderBy("confidence", "id").limit(limit)


def stats(documents: DataFrame, facts: DataFrame, relations: DataFrame) -> DataFrame:
    """Counts of everything, and of relations by type, as name and n."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    by = relations.where("type <> 'UNRELATED'").groupBy(F.concat(F.lit("relations "), F.col("type")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n(documents, "documents").unionByName(n(facts, "facts")).unionByName(by)


def block_counts(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents with the number of their blocks and of those worth extraction."""
    n = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.when(F.col("skip") == "", 1).otherwise(0)).alias("extractable"))
    return documents.join(n, "doc_id", "left").fillna(0, ["blocks", "extractable"])


def inspected(blocks: DataFrame, doc_id: int, page_no: int | None = None, extractable: bool = False, limit: int = 20) -> DataFrame:
    """A document's blocks in order, of one page or those worth extraction if asked for."""
    own = blocks.where(F.col("doc_id") == doc_id)
    if page_no is not None:
        own = own.where(F.col("page_no") == page_no)
    if extractable:
        own = own.where("skip = ''")
    return own.orderBy("ordinal").limit(limit)


def facts_about(facts: DataFrame, q: str, doc_id: int | None = None, limit: int = 50) -> DataFrame:
    """Facts whose attribute or subject holds q, whatever its case, by id."""
    own = facts.where(_holds("attribute", q) | _holds("subject", q))
    return (own if doc_id is None else own.where(F.col("doc_id") == doc_id)).orderBy("id").limit(limit)


def rejected_feed(rejected: DataFrame, documents: DataFrame, blocks: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """The latest rejections with their document's title and, where blocks (block_id, page_no) are given, the page; kept without either."""
    top = rejected.orderBy(F.desc("id")).limit(limit)
    own = top.join(documents.select("doc_id", "title"), "doc_id", "left")
    return own if blocks is None else own.join(blocks.select("block_id", "page_no"), "block_id", "left")


def evidence(fact_id: int, facts: DataFrame, located: DataFrame) -> DataFrame:
    """Where a fact's evidence stands: its quote, page (from 1), how it was found and a row for each of its boxes; a fact that wasn't found
    has one row without a box."""
    own = facts.where(F.col("id") == fact_id).select("id", "evidence_quote", (F.col("evidence_page") + 1).alias("page"))
    return own.join(located.withColumnRenamed("fact_id", "id"), "id", "left").select("id", "evidence_quote", "page", "how", F.explode_outer("rects").alias("rect"))
