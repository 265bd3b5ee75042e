"""Reconciliation: best evidence, candidate pairs, rules, narration and the relation sink.

Ids are unique. Null parts of a claim count as not stated, null confidence comes after any other; a fact without a number is compared
by its text. Ties are broken by ids. Empty tables give empty ones; columns that aren't named here are kept or not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import keys, periods, values

CORROBORATES, RECONCILED, DERIVED, SUPERSEDES = "CORROBORATES", "RECONCILED_BY_CONTEXT", "DERIVED_CONSISTENT", "SUPERSEDES"
LABELS = [CORROBORATES, "CONTRADICTS", RECONCILED, SUPERSEDES, DERIVED, "UNRELATED"]
MOST_PAIRS = 120  # candidate pairs of a cluster: a bound of the model's work, part of the operator's meaning


def keyed(facts: DataFrame, attribute: str = "attribute") -> DataFrame:
    """facts with claim (struct), claim_key and loose_key."""
    c = lambda n: F.col(n)
    out = facts.withColumn("claim", keys.claim(c("subject"), c(attribute), c("period_start"), c("period_end"), c("scope"), c("basis"), c("unit_family")))
    return out.withColumn("claim_key", keys.claim_key(c("claim"))).withColumn("loose_key", F.concat(c("claim.subject"), F.lit("|"), c("claim.attribute")))


def fact_view(facts: DataFrame, documents: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """Facts with their document's vintage and the vocabulary's name for their attribute (as written where it has none)."""
    out = facts.join(documents, "doc_id")
    if attributes is None:
        return out.withColumn("attribute_raw", F.col("attribute"))
    named = attributes.select(F.col("attribute").alias("attribute_raw"), F.col("unit_family"), "canon")
    return out.withColumnRenamed("attribute", "attribute_raw").join(named, ["attribute_raw", "unit_family"], "left").withColumn("attribute", F.coalesce("canon", "attribute_raw"))


def best_evidence(facts: DataFrame) -> DataFrame:
    """Of facts of a document with one claim and value, the one of best evidence: verbatim before fuzzy, longer quotes (to 400
    characters), more confidence, smaller id."""
    rank = F.when(F.col("grounding") == "verbatim", 2).when(F.col("grounding") == "fuzzy", 1).otherwise(0)
    w = Window.partitionBy("doc_id", "claim_key", F.lower(F.trim("value_raw"))).orderBy(
        rank.desc(), F.least(F.length("evidence_quote"), F.lit(400)).desc(), F.col("confidence").desc_nulls_last(), "id"
    )
    return facts.withColumn("best", F.row_number().over(w)).where("best = 1").drop("best")


PAIR = ["id", "doc_id", "value_raw", "value_num", "unit_family", "sig_figs", "period_start", "period_end", "confidence", "claim"]


def _contenders(facts: DataFrame, most: int) -> DataFrame:
    """Facts that may be in one of the first `most` pairs of their loose key.

    A fact comes before another in every pair with a third if it is as confident and has the smaller id, unless it is of the third's
    document and the other isn't. So of the facts of one confidence those count that are among the first most + 1 of their document and
    the first 2 * (most + 1) of these: whoever comes after has `most` others, out of the third's document, before it. Both limits are
    taken before the shuffle too.
    """
    few = lambda df, by, n: df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("rn") <= n).drop("rn")
    own = few(facts, ["loose_key", "confidence", "doc_id"], most + 1)
    return few(own, ["loose_key", "confidence"], 2 * (most + 1))


def candidate_pairs(facts: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Pairs (a, b) of facts of one loose key, a before b by id: those of different documents first, then by the lesser
    confidence, then ids, at most `most` of a cluster. Ids are unique. Only facts that can be in one of these pairs are joined, so a measure
    with any number of facts is some hundred of each confidence; the pairs' limit is taken before the shuffle too."""
    own = _contenders(facts, most)
    side = lambda p: own.select("loose_key", F.struct(*PAIR).alias(p))
    pairs = side("a").join(side("b"), "loose_key").where("a.id < b.id")
    w = Window.partitionBy("loose_key").orderBy(
        (F.col("a.doc_id") == F.col("b.doc_id")).asc(), F.least("a.confidence", "b.confidence").desc(), "a.id", "b.id"
    )
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def period_reason(a: str = "a", b: str = "b") -> Column:
    """How a difference in period reads."""
    c = lambda s, n: F.col(f"{s}.period_{n}")
    rel = periods.relation(c(a, "start"), c(a, "end"), c(b, "start"), c(b, "end"))
    return (
        F.when(rel.isNull(), "period (one source does not state one)")
        .when(rel.isin("contains", "contained_by"), "period (one covers part of the other)")
        .when(rel == "overlaps", "period (overlapping but not identical)")
        .otherwise("period")
    )


def classified(pairs: DataFrame) -> DataFrame:
    """pairs with label, discriminator, confidence, rule and needs_model, as far as rules decide."""
    c = lambda s, n: F.col(f"{s}.{n}")
    diffs = keys.differing(c("a", "claim"), c("b", "claim"))
    numeric = c("a", "value_num").isNotNull() & c("b", "value_num").isNotNull()
    fit = values.comparable(c("a", "value_num"), c("a", "unit_family"), c("b", "value_num"), c("b", "unit_family"))
    why = F.when(fit, values.agreement(c("a", "value_num"), c("a", "sig_figs"), c("b", "value_num"), c("b", "sig_figs")))
    own = pairs.withColumns({"diffs": diffs, "numeric": numeric, "fit": fit, "why": why, "sure": F.least("a.confidence", "b.confidence")})
    same, one = F.size("diffs") == 0, F.size("diffs") == 1
    d = F.get("diffs", F.lit(0))
    listed = F.array_join("diffs", ", ")
    fit, why = F.col("fit"), F.col("why")

    def verdict(label: str | None, discriminator: Column, sure: float, rule: Column, model: bool = False) -> Column:
        return F.struct(F.lit(label).cast("string").alias("label"), discriminator.alias("discriminator"), F.lit(sure).alias("confidence"), rule.alias("rule"), F.lit(model).alias("needs_model"))

    none = verdict(None, F.lit(""), 0.0, F.lit(""))
    text = F.lower(F.trim(c("a", "value_raw"))) == F.lower(F.trim(c("b", "value_raw")))
    out = (
        F.when(same & ~F.col("numeric"), F.when(text, verdict(CORROBORATES, F.lit(""), 0.9, F.lit("identical claim, identical statement"))).otherwise(verdict(None, F.lit(""), 0.0, F.lit("identical claim, differing statements"), True)))
        .when(same & ~fit, none)
        .when(same & why.isNotNull(), verdict(CORROBORATES, F.lit(""), 0.95, F.concat(F.lit("identical claim, values "), why)))
        .when(same, verdict(None, F.lit(""), 0.0, F.lit("identical claim, values disagree"), True))
        .when(why.isNotNull() & one & (d == "period"), none)
        .when(why.isNotNull(), verdict(CORROBORATES, listed, 0.75, F.concat(F.lit("values agree despite differing "), listed)))
        .when(one & (F.col("sure") < 0.5), none)
        .when(one & (d == "period"), verdict(RECONCILED, period_reason(), 0.9, F.lit("single differing qualifier: period")))
        .when(one & d.isin("scope", "basis", "unit"), verdict(RECONCILED, d, 0.85, F.concat(F.lit("single differing qualifier: "), d)))
        .when(one, none)
        .when(fit & (c("a", "doc_id") != c("b", "doc_id")) & (F.col("sure") >= 0.6), verdict(None, listed, 0.0, F.lit("several differing qualifiers"), True))
        .otherwise(none)
    )
    own = own.withColumn("v", out)
    return own.select("loose_key", "rank", "a", "b", "sure", "v.*")


def undecided(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs that no model has decided before, whichever way round it was stored."""
    asked = relations.where("decided_by = 'llm'").select(F.least("fact_a", "fact_b").alias("lo"), F.greatest("fact_a", "fact_b").alias("hi")).distinct()
    return pairs.join(asked, (pairs["a.id"] == asked["lo"]) & (pairs["b.id"] == asked["hi"]), "left_anti")


def dated(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """earlier and later fact of each pair, by the documents' dates (unknown last) and then ids."""
    when = documents.select("doc_id", F.coalesce("published_on", F.lit("9999-99-99")).alias("on"))
    own = pairs.join(when.toDF("da", "ona"), F.col("a.doc_id") == F.col("da")).join(when.toDF("db", "onb"), F.col("b.doc_id") == F.col("db"))
    first = F.struct(F.col("ona"), F.col("a.id")) <= F.struct(F.col("onb"), F.col("b.id"))
    return own.select(F.when(first, F.col("a.id")).otherwise(F.col("b.id")).alias("earlier"), F.when(first, F.col("b.id")).otherwise(F.col("a.id")).alias("later"))


def pending(verdicts: DataFrame, most: int = 250) -> DataFrame:
    """The pairs a model should read first, the most confident: a budget, so limited by meaning."""
    return verdicts.where("needs_model").orderBy(F.desc("sure"), "a.id", "b.id").limit(most)


def relations(verdicts: DataFrame) -> DataFrame:
    """Edges of decided pairs, smaller id first."""
    own = verdicts.where("label IS NOT NULL")
    return own.select(F.col("a.id").alias("fact_a"), F.col("b.id").alias("fact_b"), F.col("label").alias("type"), "discriminator", "confidence", F.lit("rule").alias("decided_by"), F.col("rule").alias("rule_label"))


def new_relations(found: DataFrame, stored: DataFrame) -> DataFrame:
    """What a store that keeps one edge for each pair and type takes in: known labels, canonical order (but for SUPERSEDES), each once."""
    keep = F.col("type") == SUPERSEDES
    own = found.where(F.col("type").isin(LABELS)).withColumns(
        {"fact_a": F.when(keep, F.col("fact_a")).otherwise(F.least("fact_a", "fact_b")), "fact_b": F.when(keep, F.col("fact_b")).otherwise(F.greatest("fact_a", "fact_b"))}
    )
    w = Window.partitionBy("fact_a", "fact_b", "type").orderBy(F.desc("confidence"), "decided_by", "rule_label", "discriminator")
    own = own.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return own.join(stored, ["fact_a", "fact_b", "type"], "left_anti")


def narrated(edges: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """A sentence for each corroborating or reconciled edge that a rule decided. Its wording is fixed."""
    f = facts.join(documents, "doc_id").select("id", F.coalesce("publisher", "title").alias("src"), "value_raw", "period_label", "scope", "basis")
    own = edges.where("decided_by = 'rule'").join(f.toDF("fact_a", "sa", "va", "pa", "ca", "ba"), "fact_a").join(f.toDF("fact_b", "sb", "vb", "pb", "cb", "bb"), "fact_b")
    says = F.concat(F.col("sa"), F.lit(" reports "), F.col("va"), F.lit(" and "), F.col("sb"), F.lit(" reports "), F.col("vb"))
    what = F.when(F.col("discriminator") != "", F.col("discriminator")).otherwise("context")
    key = F.substring_index(what, " ", 1)
    side = lambda n: F.coalesce(F.when(key == "period", F.col("p" + n)).when(key == "scope", F.col("c" + n)).otherwise(F.col("b" + n)), F.lit("not stated"))
    detail = F.when(key.isin("period", "scope", "basis"), F.concat(F.lit(" — "), side("a"), F.lit(" against "), side("b"))).otherwise("")
    text = (
        F.when((F.col("type") == CORROBORATES) & (F.col("discriminator") != ""), F.concat(says, F.lit(". These differ by "), F.col("discriminator"), F.lit(", but the values still agree.")))
        .when(F.col("type") == CORROBORATES, F.concat(says, F.lit(" for the same claim; the values agree.")))
        .when(F.col("type") == RECONCILED, F.concat(says, F.lit(". These are not the same claim: they differ by "), what, detail, F.lit(", which accounts for the difference.")))
    )
    return own.withColumn("explanation", text).where("explanation IS NOT NULL").select("fact_a", "fact_b", "type", "explanation")
