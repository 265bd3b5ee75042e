"""Extraction units of documents: prefilter, packing, table rendering and chunks, running lines, prompts, hashes.

Null texts, sections and notes count as empty; a text without a line that isn't blank has no block. Repeated rows are units of
their own; empty tables give empty ones.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions.binding import let

# Phrases of boilerplate, by a part without which none of them is there, and words by which a text without digits may still state a fact.
PHRASES = {
    "looking statements": r"forward[- ]looking statements", "safe harbo": r"safe harbou?r", "no part of it shall": r"no part of it shall", "this presentation is prepared": r"this presentation is prepared",
    "without regards to specific objectives": r"without regards to specific objectives", "all rights reserved": r"all rights reserved", "shall not be reproduced": r"shall not be reproduced",
}
BOILERPLATE = "|".join(PHRASES.values())
CUES = (
    r"\b(appointed|resigned|retired|re-?designated|ceased|inducted|elected|registered office|corporate office|principal place|situated at|located at|"
    r"auditor|auditors|chairman|chairperson|managing director|director|company secretary|incorporated|renamed|merged|acquired|subsidiary|listed on|headquartered)\b"
)
# Fixed value: a number as a table cell has it.
NUMERIC = r"^[(\[]?[-−+]?[0-9][0-9,]*(\.[0-9]+)?[)\]]?%?$"
SHORTEST, PACK, PACK_MOST, CHUNK = 25, 5000, 7000, 1500


def numeric_token(token: Column) -> Column:
    """A number as a table cell has it: brackets, a sign, digits, per cent; stops after it don't count, and what has a slash is none."""
    t = F.regexp_replace(F.trim(token), "[.,;]+$", "")
    return ~F.contains(t, F.lit("/")) & t.rlike(NUMERIC)


def prefilter(text: Column, kind: Column) -> Column:
    """Why a block isn't worth extraction, empty where it is. Each form of a text is made once, where it is filtered by too."""
    bare = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    some = lambda low: reduce(or_, [F.contains(low, F.lit(x)) for x in PHRASES])
    why = lambda t, low: (
        F.when(some(low) & low.rlike(BOILERPLATE), "boilerplate")
        .when(kind == "table", "")
        .when(F.length(bare(t)) < SHORTEST, "too short")
        .when(~t.rlike("[0-9]") & ~low.rlike(CUES), "no numeric or semantic content")
        .otherwise("")
    )
    return let(F.coalesce(text, F.lit("")), lambda t: let(F.lower(t), lambda low: why(t, low)))


def block_sha(kind: Column, section: Column, text: Column, notes: Column) -> Column:
    c = lambda x: F.coalesce(x, F.lit(""))
    return F.sha2(F.concat_ws("\n", c(kind), c(section), c(text), F.array_join(F.coalesce(notes, F.array().cast("array<string>")), "|")), 256)


def prompt_text(section: Column, text: Column, notes: Column, most: int = 6) -> Column:
    """What a model is shown: section, text, and the first notes, each on a line of its own."""
    own = F.slice(F.coalesce(notes, F.array().cast("array<string>")), 1, most)
    head = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("[Section: "), section, F.lit("]")))
    return F.array_join(F.concat(F.array(head, F.coalesce(text, F.lit(""))), F.transform(own, lambda n: F.concat(F.lit("[Footnote on same page: "), n, F.lit("]")))), "\n")


SLICES = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("head", T.IntegerType())]))


def _slices(sizes, target: int, most: int) -> list[tuple[int, int, int]]:
    """Places and numbers of adjacent items that go together."""
    out, at, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > target:
            out.append((at, i - at, -1))
            at, total = i, 0
        total += n
        if total >= most:
            out.append((at, i + 1 - at, -1))
            at, total = i + 1, 0
    return [*out, (at, len(sizes) - at, -1)] if at < len(sizes) else out


def _table_slices(sizes, banners, most: int) -> list[tuple[int, int, int]]:
    """The same for a table's rows: no more than `most`, and the banner in force (-1: none, or within), without slices of banners alone."""
    out, at, total, last = [], 0, 0, -1

    def close(end: int) -> None:
        if not all(banners[at:end]):
            out.append((at, end - at, last if last < at else -1))

    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            close(i)
            at, total = i, 0
        if banners[i]:
            last = i
        total += n
    close(len(sizes))
    return out


def _sliced(sizes: Column, target: int, most: int) -> Column:
    @F.pandas_udf(SLICES)
    def run(own: pd.Series) -> pd.Series:
        return own.map(lambda x: None if x is None else [dict(zip(("at", "n", "head"), s, strict=True)) for s in _slices(list(map(int, x)), target, most)])

    return run(sizes)


def packs(items: Column, target: int = PACK, most: int = PACK_MOST) -> Column:
    """Adjacent texts of an ordered array joined by blank lines: a new pack begins where the next would pass target, and after
    one that has reached `most`. Only the texts' lengths go through the Arrow kernel; its time grows with their number. Null: null."""
    return F.transform(_sliced(F.transform(items, F.length), target, most), lambda s: F.array_join(F.slice(items, s["at"] + 1, s["n"]), "\n\n"))


def chunked_rows(rows: Column, most: int = CHUNK) -> Column:
    """A table's rows as arrays of at most `most` rendered characters (one row at least), each with the banner that is in force where it
    begins unless it holds one itself; a chunk of banners alone is left out."""

    @F.pandas_udf(SLICES)
    def run(sizes: pd.Series, banners: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [dict(zip(("at", "n", "head"), s, strict=True)) for s in _table_slices(list(map(int, x)), list(map(bool, b)), most)] for x, b in zip(sizes, banners, strict=True)])

    size = lambda r: F.length(F.coalesce(r["label"], F.lit(""))) + F.aggregate(r["cells"], F.lit(0), lambda a, c: a + F.length(c["header"]) + F.length(c["value"]) + 2)
    head = lambda s: F.when(s["head"] >= 0, F.slice(rows, s["head"] + 1, F.lit(1))).otherwise(F.slice(rows, F.lit(1), F.lit(0)))
    return F.transform(run(F.transform(rows, size), F.transform(rows, lambda r: r["section"])), lambda s: F.concat(head(s), F.slice(rows, s["at"] + 1, s["n"])))


def rendered(rows: Column, caption: Column) -> Column:
    """Table rows (section, label, cells of header and value) as lines: a banner in brackets, else label and cells with a value; a row
    without such cells has no line."""
    cells = lambda r: F.array_join(F.transform(F.filter(r["cells"], lambda c: c["value"] != ""), lambda c: F.concat(c["header"], F.lit("="), c["value"])), "; ")
    named = lambda r: F.when(F.coalesce(r["label"], F.lit("")) != "", r["label"]).otherwise("(unlabelled row)")
    line = lambda r: F.when(r["section"], F.concat(F.lit("["), r["label"], F.lit("]"))).when(cells(r) != "", F.concat(named(r), F.lit(": "), cells(r)))
    head = F.when(F.coalesce(caption, F.lit("")) != "", caption)
    return F.array_join(F.concat(F.array(head), F.transform(rows, line)), "\n")


def running_lines(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Lines (doc_id, page_no, text, margin) that a document repeats in its margins, digits aside: on 3 pages and 35 % of them at
    least, of documents of 4 pages or more. Pages count that have a line, or, where pages are given, all."""
    pages = (lines if pages is None else pages).groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages")).where("pages >= 4")
    shape = F.regexp_replace(F.trim("text"), "[0-9]+", "#")
    own = lines.where("margin").select("doc_id", "page_no", shape.alias("shape")).where(F.length("shape").between(3, 90)).distinct()
    n = own.groupBy("doc_id", "shape").count()
    return n.join(pages, "doc_id").where(F.col("count") >= F.greatest(F.lit(3), F.floor(F.col("pages") * 0.35))).select("doc_id", "shape", F.col("count").alias("n_pages"))


def document_blocks(documents: DataFrame) -> DataFrame:
    """Paragraph blocks of each document's text, packed, with their ordinal, prefilter and hash."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    own = documents.select("doc_id", F.posexplode(packs(lines)).alias("ordinal", "text"))
    kind = F.lit("paragraph")
    return own.withColumn("skip", prefilter(F.col("text"), kind)).withColumn("sha256", block_sha(kind, F.lit(""), F.col("text"), F.lit(None)))


def token_window(spends: DataFrame, seconds: int = 60) -> DataFrame:
    """What each user spent within the last `seconds`, this spend too: a sliding budget as a range frame."""
    frame = f"PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {int(seconds)} SECONDS PRECEDING AND CURRENT ROW"
    return spends.withColumn("spent", F.expr(f"sum(amount) OVER ({frame})"))
