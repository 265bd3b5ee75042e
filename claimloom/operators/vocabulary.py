"""The vocabulary of attributes: distinct names, fuzzy blocking, unit collisions, relinking.

A null unit fits any in blocking, and is a unit of its own elsewhere, compared null-safely. Ties go to the commoner name, then by the
alphabet. Empty tables give empty ones.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions import keys
from claimloom.functions.grounding import indel_ratio
from claimloom.operators.components import connected
from claimloom.sources.store import written

MERGE = 85.0


def distinct_attributes(facts: DataFrame) -> DataFrame:
    """Names and units with their number of facts and an example, most frequent first."""
    return facts.groupBy(F.col("attribute").alias("attribute_raw"), "unit_family").agg(F.count(F.lit(1)).alias("n"), F.min("value_raw").alias("example"))


def sort_ratio(a: str, b: str) -> float:
    """Likeness of two phrases whatever the order of their words."""
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _blocked(items: list[dict], known: list[dict]) -> list[dict]:
    """Each item's group, greedily in order: the group with the likeliest surface, from 85 on and of one unit family (or none)."""
    groups = [{"canon": k["canon"], "unit": k["unit_family"] or "", "surfaces": [k["phrase"], *k["phrases"]]} for k in known]
    out = []
    for it in items:
        unit, best, score = it["unit_family"] or "", None, 0.0
        for g in groups:
            if g["unit"] and unit and g["unit"] != unit:
                continue
            s = max(sort_ratio(it["phrase"], x) for x in g["surfaces"])
            if s > score:
                best, score = g, s
        if best is None or score < MERGE:
            best = {"canon": it["attribute_raw"], "unit": unit, "surfaces": []}
            groups.append(best)
        best["surfaces"].append(it["phrase"])
        best["unit"] = best["unit"] or unit
        out.append({"attribute_raw": it["attribute_raw"], "unit_family": it["unit_family"], "n": it["n"], "canon": best["canon"]})
    return out


def _grams(phrase: Column) -> Column:
    """The pairs of neighbouring characters of a phrase with its words in order, its ends marked, each told from its repeats."""
    own = F.concat(F.lit("\x02"), F.array_join(F.array_sort(F.split(phrase, " ")), " "), F.lit("\x03"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(own) - 1), lambda i: F.substring(own, i, F.lit(2)))
    return F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda x: x == g)).cast("string")))


def _families(surfaces: DataFrame) -> DataFrame:
    """node and family: names (node, phrase) that may lie in one group have one family.

    Phrases of a likeness of 85 differ by 15 % of their joint length in single characters, each of which changes two pairs of neighbours at
    most. So of a phrase of n characters at least 0.29 n + 1 pairs are the other's too, and one of its rarest n + 1 - 0.29 n is among the
    other's rarest. Names that share one of these are linked, each pair's least with the others.
    """
    own = surfaces.withColumn("surface", F.monotonically_increasing_id())
    own = written(own.select("node", "surface", F.length("phrase").alias("size"), F.explode(_grams(F.col("phrase"))).alias("gram")), "grams")
    often = own.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("surface").orderBy("often", "gram"))
    rare = own.join(often, "gram").withColumn("rank", rank).where(F.col("rank") <= F.col("size") + 1 - F.floor(F.col("size") * 0.29)).select("node", "gram")
    least = rare.groupBy("gram").agg(F.min("node").alias("a"))
    links = rare.join(least, "gram").where("a < node").select("a", F.col("node").alias("b")).distinct()
    low = connected(links)
    return surfaces.select("node").distinct().join(low, "node", "left").select("node", F.coalesce("label", "node").alias("family"))


def blocked(items: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct attributes with the name of their group. The fold is in one order (n falling, then name and unit), so it is one
    task for each family of names that may be alike, over names and not facts. Known names (canon, unit_family, aliases) seed groups."""
    own = items.withColumn("phrase", keys.phrase(F.col("attribute_raw"))).withColumn("node", F.monotonically_increasing_id())
    own = written(own.select("node", "attribute_raw", "unit_family", "n", "phrase"), "items")
    none = F.array().cast("array<string>")
    if known is None:
        seeds = own.limit(0).select("node", F.col("attribute_raw").alias("canon"), F.col("unit_family").cast("string").alias("unit_family"), "phrase", none.alias("phrases"))
    else:
        seeds = known.select((-1 - F.monotonically_increasing_id()).alias("node"), "canon", F.col("unit_family").cast("string").alias("unit_family"), keys.phrase(F.col("canon")).alias("phrase"), F.transform(F.coalesce("aliases", none), keys.phrase).alias("phrases"))
        seeds = written(seeds, "seeds")
    spelt = seeds.select("node", F.explode(F.concat(F.array("phrase"), "phrases")).alias("phrase"))
    family = written(_families(own.select("node", "phrase").unionByName(spelt)), "families")

    def fold(names: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        plain = lambda p: p.astype(object).where(p.notna(), None).to_dict("records")
        rows = sorted(plain(names), key=lambda r: (-r["n"], r["attribute_raw"], r["unit_family"] or ""))
        start = [{**g, "phrases": list(g["phrases"])} for g in sorted(plain(groups), key=lambda g: g["canon"])]
        return pd.DataFrame(_blocked(rows, start), columns=["attribute_raw", "unit_family", "n", "canon"])

    schema = T.StructType([items.schema[c] for c in ("attribute_raw", "unit_family", "n")]).add("canon", "string")
    side = lambda df, tag: written(df.join(family, "node"), tag).groupBy("family")
    return side(own, "names").cogroup(side(seeds, "known")).applyInPandas(fold, schema)


def split_units(mapped: DataFrame) -> DataFrame:
    """A name used with several unit families stays with the commonest (ties: alphabetical); the others get the unit as suffix."""
    n = mapped.groupBy("canon", "unit_family").agg(F.sum("n").alias("n_unit"))
    w = Window.partitionBy("canon").orderBy(F.desc("n_unit"), F.coalesce("unit_family", F.lit("")))
    n = n.withColumn("rn", F.row_number().over(w)).drop("n_unit").withColumnsRenamed({"canon": "c", "unit_family": "u"})
    own = mapped.join(n, (F.col("canon") == F.col("c")) & F.col("unit_family").eqNullSafe(F.col("u")))
    suffix = F.substring_index(F.coalesce("unit_family", F.lit("unknown")), ":", -1)
    name = F.when(F.col("rn") == 1, F.col("canon")).otherwise(F.concat("canon", F.lit(" ("), suffix, F.lit(")")))
    return own.select("attribute_raw", "unit_family", "n", name.alias("canon"))


def relinked(facts: DataFrame, mapped: DataFrame) -> DataFrame:
    """facts with the canonical name of their attribute and unit, both compared null-safely; theirs where there is none."""
    m = mapped.select(F.col("attribute_raw").alias("ra"), F.col("unit_family").alias("ru"), "canon")
    own = facts.join(m, (F.col("attribute") == F.col("ra")) & F.col("unit_family").eqNullSafe(F.col("ru")), "left")
    return own.withColumn("canon", F.coalesce("canon", "attribute")).drop("ra", "ru")


def schema_of(linked: DataFrame) -> DataFrame:
    """The vocabulary: names with their facts and other spellings."""
    own = linked.groupBy("canon", "unit_family").agg(F.count(F.lit(1)).alias("n_facts"), F.array_sort(F.collect_set("attribute")).alias("spelt"))
    return own.select("canon", "unit_family", "n_facts", F.array_join(F.array_remove("spelt", F.col("canon")), "; ").alias("aliases"))
