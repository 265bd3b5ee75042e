"""Is a quote really in its source, and the value in the quote? Exact gates as expressions, the fuzzy one in an Arrow kernel."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD, SHORTEST = 88.0, 12
# Look-alikes of the hyphen and of quotation marks, and ligatures.
DASHES, SINGLE, DOUBLE = "‐‑‒–—―−", "‘’‚", "“”„"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def folded(text: Column, nfkc: bool = True) -> Column:
    """Text without differences that mean nothing: width and ligature forms, dashes, quotation marks, white space, case.

    Only texts with a character beyond ASCII go through the Arrow kernel for NFKC; others stay in the JVM."""
    own = F.coalesce(text, F.lit(""))
    if nfkc:
        own = F.when(own.rlike(r"[^\x00-\x7F]"), _nfkc(own)).otherwise(own)
    own = F.replace(F.replace(own, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    own = F.translate(own, DASHES + SINGLE + DOUBLE, "-" * len(DASHES) + "'" * len(SINGLE) + '"' * len(DOUBLE))
    return F.lower(F.trim(F.regexp_replace(own, r"\s+", " ")))


def token(text: Column) -> Column:
    """A word as read from a page: ligatures as letters, white space as single blanks, none at the ends. Null stays null."""
    own = F.replace(F.replace(text, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return F.trim(F.regexp_replace(own, r"[\s\x{00A0}]+", " "))


def value_in_span(value: Column, span: Column) -> Column:
    """Why a value is not in its evidence, empty where it is; both folded. As written, else by its digits, else by its words."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    words = F.regexp_extract_all(value, F.lit("[a-z]{3,}"), F.lit(0))
    absent = "value not present in the quoted evidence"
    return (
        F.when(value == "", "empty value")
        .when(F.contains(span, value), "")
        .when(digits != "", F.when(F.contains(F.regexp_replace(span, "[^0-9]", ""), digits), "").otherwise(F.concat(F.lit("value digits '"), digits, F.lit("' not present in the quoted evidence"))))
        .when((F.size(words) > 0) & F.forall(words, lambda w: F.contains(span, w)), "")
        .otherwise(absent)
    )


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def distance(a: str, b: str) -> int:
    """Edits of one character that make b of a: the table's columns as bits of differences, a step for each character of b."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        level = (((same & up) + up) ^ up) | same | down
        rise, fall = down | ~(level | up) & full, up & level
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | ~(level | rise) & full, rise & level
    return score


def similarity(a: str, b: str) -> float:
    return 100.0 * (1 - distance(a, b) / max(len(a), len(b), 1))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with any stretch of the longer that is no longer than it."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return 100.0 if not b else 0.0
    chars, best = set(a), 0.0
    for i in range(1 - n, len(b)):
        part = b[max(i, 0) : i + n]
        if part and (part[-1] in chars or part[0] in chars):
            best = max(best, indel_ratio(a, part))
            if best == 100.0:
                break
    return best


def best_window(quote: str, source: str) -> tuple[int, int, float]:
    """Where in source a stretch of the quote's length is most like it: strides of an eighth, then every place around the best."""
    n, best = len(quote), (-1, -1, 0.0)
    stride = max(1, n // 8)
    last = len(source) - n

    def look(places: range) -> None:
        nonlocal best
        for at in places:
            s = similarity(quote, source[at : at + n])
            if s > best[2]:
                best = (at, at + n, s)

    look(range(0, max(1, last + 1), stride))
    look(range(max(0, best[0] - stride), min(last + 1, best[0] + stride + 1)))
    return best


def _fuzzy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for q, s in zip(b["__nq"], b["__ns"], strict=True):
            score = partial_ratio(q, s)
            rows.append((-1, -1, score) if score < THRESHOLD else best_window(q, s))
        b["start"], b["end"], b["score"] = zip(*rows, strict=True) if rows else ((), (), ())
        yield b


def grounded(facts: DataFrame, fuzzy: bool = True, nfkc: bool = True) -> DataFrame:
    """facts with quote, value and source, and for each a status (verbatim, fuzzy, failed), score, start, end (in the folded
    source) and reason.

    A quote must be in the source as written, or, from 12 characters on, by a fuzzy window of 88 or more; then the value must be
    in the evidence. Only quotes that fail the exact test and are long enough go to the kernel. Nulls count as empty; a fact
    without a quote fails. Repeated rows are kept; an empty table stays empty.
    """
    own = facts.withColumn("__nq", folded(F.col("quote"), nfkc)).withColumn("__ns", folded(F.col("source"), nfkc)).withColumn("__nv", folded(F.col("value"), nfkc))
    at = F.position(F.col("__nq"), F.col("__ns")) - 1
    blank = F.trim(F.coalesce("quote", F.lit(""))) == ""
    own = own.withColumn("start", F.when(~blank & (at >= 0), at).otherwise(-1))
    own = own.withColumn("end", F.when(F.col("start") >= 0, F.col("start") + F.length("__nq")).otherwise(-1)).withColumn("score", F.when(F.col("start") >= 0, 100.0).otherwise(0.0))
    why = F.when(blank, "empty quote").when((F.col("start") < 0) & (F.length("__nq") < SHORTEST), "short quote not found verbatim")
    own = own.withColumn("__why", why)
    hard = (F.col("start") < 0) & F.col("__why").isNull()
    if fuzzy:
        tried = own.where(hard)
        own = own.where(~hard).unionByName(tried.mapInPandas(_fuzzy, tried.schema))
    found = F.col("start") >= 0
    span = F.substring(F.col("__ns"), F.col("start") + 1, F.col("end") - F.col("start"))
    bad = F.when(F.col("__why").isNotNull(), F.col("__why")).when(~found | (F.col("score") < THRESHOLD), "quote not found in the source text").otherwise(value_in_span(F.col("__nv"), span))
    out = own.withColumn("reason", bad)
    status = F.when(F.col("reason") != "", "failed").when(F.col("score") == 100.0, "verbatim").otherwise("fuzzy")
    return out.withColumn("status", status).drop("__nq", "__ns", "__nv", "__why")
