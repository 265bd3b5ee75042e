"""Stated percentages that other facts imply: ratios of two amounts, and growth between adjoining periods.

Facts without a number, a period or evidence take no part. Of derivations that are equally close the one of smaller ids counts. An
empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import keys

TOLERANCE, GAP_DAYS, SHORTEST_QUOTE = 0.06, 40, 18
# Words that say nothing about a measure, names too general for arithmetic, and words of ratio-like measures.
WEAK = ["total", "net", "gross", "value", "amount", "rate", "growth", "margin", "share", "ratio", "yoy", "change", "increase", "percentage", "per", "cent"]
GENERIC = [
    "value", "amount", "total", "other", "other line", "note", "footnote", "section", "reference", "data", "figure", "number", "level",
    "period", "item", "line", "detail", "particulars", "description", "remarks", "miscellaneous", "unlabelled row",
]
RATIO = ["margin", "ratio", "percentage", "proportion", "share"]


def content_words(attribute: Column) -> Column:
    return F.filter(F.split(keys.phrase(attribute), " "), lambda w: (F.length(w) > 2) & ~w.isin(WEAK))


def usable(quote: Column, value: Column, attribute: Column) -> Column:
    """Evidence of some length, one number at most, and a name that says something."""
    numbers = F.size(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"-?\(?[0-9][0-9,]*\.?[0-9]*\)?%?"), F.lit(0)))
    return (F.length(F.coalesce(quote, F.lit(""))) >= SHORTEST_QUOTE) & (numbers <= 1) & ~keys.phrase(attribute).isin(GENERIC)


def _parts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stated percentages and amounts, with their keys and words."""
    own = facts.where(usable(F.col("evidence_quote"), F.col("value_raw"), F.col("attribute")) & F.col("value_num").isNotNull() & F.col("period_start").isNotNull())
    own = own.select(
        keys.phrase(F.col("subject")).alias("who"), "id", "value_num", "unit_family", F.col("period_start").alias("p0"), F.col("period_end").alias("p1"),
        content_words(F.col("attribute")).alias("words"), F.arrays_overlap(F.split(keys.phrase(F.col("attribute")), " "), F.lit(RATIO)).alias("ratio"),
    )
    unit = F.col("unit_family")
    return own.where(unit == "percent"), own.where((F.col("value_num") != 0) & (unit.startswith("currency:") | unit.startswith("quantity:") | (unit == "number")))


def _named(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])


def _best(tried: DataFrame, kind: str, computed: Column, a: str, b: str) -> DataFrame:
    """The closest derivation within the tolerance for each target; ties by the parts' ids."""
    own = tried.withColumn("computed", computed)
    own = own.withColumn("error", F.abs(F.col("computed") - F.col("t_value_num")) / F.greatest(F.abs("t_value_num"), F.lit(1e-9))).where(F.col("error") <= TOLERANCE)
    w = Window.partitionBy("t_id").orderBy("error", f"{a}_id", f"{b}_id")
    own = own.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return own.select(F.lit(kind).alias("kind"), F.col("t_id").alias("target"), F.col(f"{a}_id").alias("part_a"), F.col(f"{b}_id").alias("part_b"), "computed", F.col("t_value_num").alias("stated"), "error")


#: Buckets of amounts on a logarithmic scale, wider than the tolerance to either side, and of days, wider than the gap.
AMOUNT, DAYS = math.log((1 + 2 * TOLERANCE) / (1 - 2 * TOLERANCE)), GAP_DAYS + 1


def _about(x: Column) -> Column:
    return F.floor(F.log(F.abs(x)) / AMOUNT).cast("long")


def _sharing(t: DataFrame, n: DataFrame) -> DataFrame:
    """Targets with the amounts of their subject and period that share a word with them: an equi-join on that word too, so that a subject
    of very many facts is spread over its words. Each pair is taken at its first common word."""
    words = lambda df, p: df.withColumn("word", F.explode(F.array_distinct(f"{p}_words")))
    same = F.col("t_word") == F.col("n_word")
    for c in ("who", "p0", "p1"):
        same = same & (F.col(f"t_{c}") == F.col(f"n_{c}"))
    both = words(t, "t").withColumnRenamed("word", "t_word").join(words(n, "n").withColumnRenamed("word", "n_word"), same)
    first = F.get(F.filter("t_words", lambda w: F.array_contains(F.col("n_words"), w)), F.lit(0))
    return both.where(F.col("t_word") == first).drop("t_word", "n_word")


def ratios(facts: DataFrame) -> DataFrame:
    """Percentages of ratio-like measures that one amount makes of another, in one subject and period and one unit.

    What the other amount must be follows from the percentage, so it is found by an equi-join on its bucket; only percentages of zero
    are tried with every amount of their subject and period."""
    percent, level = _parts(facts)
    t, n, d = _named(percent.where("ratio"), "t"), _named(level, "n"), _named(level, "d")
    tried = _sharing(t, n)
    same = (F.col("t_who") == F.col("d_who")) & (F.col("t_p0") == F.col("d_p0")) & (F.col("t_p1") == F.col("d_p1")) & (F.col("n_unit_family") == F.col("d_unit_family")) & (F.col("n_id") != F.col("d_id"))
    some = F.abs("t_value_num") >= 1e-9
    want = _about(F.col("n_value_num") / F.col("t_value_num") * 100)
    near = tried.where(some).withColumn("bucket", F.explode(F.array(want - 1, want, want + 1)))
    found = near.join(d.withColumn("d_bucket", _about(F.col("d_value_num"))), same & (F.col("bucket") == F.col("d_bucket"))).drop("bucket", "d_bucket")
    found = found.unionByName(tried.where(~some).join(d, same))
    return _best(found, "ratio", F.col("n_value_num") / F.col("d_value_num") * 100, "n", "d")


def growth(facts: DataFrame) -> DataFrame:
    """Percentages that are the change of one measure from the period just before, at most 40 days away: an equi-join on a bucket of
    the earlier period's last day."""
    percent, level = _parts(facts)
    t, now, old = _named(percent, "t"), _named(level, "n"), _named(level, "o")
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    last = F.floor((day("n_p0") - 1) / DAYS)
    tried = _sharing(t, now).withColumn("bucket", F.explode(F.array(last, last - 1)))
    old = old.withColumn("o_bucket", F.floor(day("o_p1") / DAYS))
    near = (F.col("o_p1") < F.col("n_p0")) & (F.datediff("n_p0", "o_p1") <= GAP_DAYS)
    same = (F.col("n_who") == F.col("o_who")) & (F.col("n_unit_family") == F.col("o_unit_family")) & (F.col("bucket") == F.col("o_bucket"))
    tried = tried.join(old, same & near & F.arrays_overlap("n_words", "o_words"))
    return _best(tried, "growth", (F.col("n_value_num") - F.col("o_value_num")) / F.abs("o_value_num") * 100, "o", "n")


def derived(facts: DataFrame) -> DataFrame:
    """Ratios and growth as edges from the stated fact to the first part, ratios before growth where both name one edge."""
    both = ratios(facts).unionByName(growth(facts))
    edge = both.select(
        F.least("target", "part_a").alias("fact_a"), F.greatest("target", "part_a").alias("fact_b"), F.lit("DERIVED_CONSISTENT").alias("type"), "kind",
        F.greatest(F.lit(0.6), 1 - 5 * F.col("error")).alias("confidence"), F.array("part_a", "part_b").alias("parts"),
    )
    w = Window.partitionBy("fact_a", "fact_b").orderBy(F.desc("kind"), F.desc("confidence"), "parts")
    return edge.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
