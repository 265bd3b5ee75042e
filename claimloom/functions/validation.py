"""Proposed facts: coercion and the checks they must pass before grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that stand for nothing, words that end a cut phrase, and the kinds a proposal may name.
NOTHING = ["", "null", "none", "n/a", "unknown"]
DANGLING = ["of", "the", "a", "an", "in", "with", "to", "for", "and", "or", "from", "by", "at", "as", "on", "is", "than", "over", "under"]
KINDS = ["money", "percent", "count", "ratio", "date", "text", "entity"]


def clean(text: Column, limit: int = 400) -> Column:
    """Trimmed and cut; null where nothing is said."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(~F.lower(t).isin(NOTHING), F.substring(t, 1, limit))


def row_dump(value: Column) -> Column:
    return F.contains(value, F.lit("=")) & F.contains(value, F.lit(";"))


def truncated(value: Column) -> Column:
    last = F.regexp_extract(F.lower(value), r"(\S+)\s*$", 1)
    return F.regexp_replace(last, "[.,;:]+$", "").isin(DANGLING)


def validated(raw: DataFrame) -> DataFrame:
    """Proposals with their fields coerced and a reason, empty where they pass."""
    out = raw.withColumns(
        {n: clean(F.col(n), k) for n, k in (("subject", 200), ("attribute", 200), ("value", 300), ("evidence_quote", 1200), ("value_kind", 400), ("period", 60), ("scope", 120), ("basis", 240), ("geography", 120))}
    )
    reason = (
        F.when(F.col("attribute").isNull(), "missing attribute")
        .when(F.col("value").isNull(), "missing value")
        .when(F.col("evidence_quote").isNull(), "missing evidence quote")
        .when(row_dump(F.col("value")), "value looks like a whole table row, not one cell")
        .when(truncated(F.col("value")), "value looks truncated mid-phrase")
        .otherwise("")
    )
    kind = F.lower(F.coalesce("value_kind", F.lit("")))
    return out.withColumns(
        {
            "reason": reason,
            "subject": F.coalesce("subject", F.lit("(unspecified)")),
            "attribute": F.lower("attribute"),
            "value_kind": F.when(kind.isin(KINDS), kind).otherwise(""),
            "confidence": F.least(F.greatest(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.7)), F.lit(0.0)), F.lit(1.0)),
        }
    )


def resolved_period(stated: Column, quote: Column) -> Column:
    """The stated period, else the quote's if it has just one."""
    from claimloom.functions import periods

    found = periods.find(quote)
    return F.coalesce(periods.parse(stated), F.when(F.size(found) == 1, F.get(found, F.lit(0))))


def canonical_detail(detail: Column) -> Column:
    """A rejection's detail without the digits that one case is about."""
    d = F.trim(F.coalesce(detail, F.lit("")))
    return F.when(d.rlike("^value digits '.*' not present in the quoted evidence$"), "value not present in the quoted evidence").otherwise(d)
