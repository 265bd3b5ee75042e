"""Words with their places, as the layout operators take them: (doc_id, page_no, x0, y0, x1, y1, text, size, bold).

A reader of PDF files gives such rows; here plain texts and tables are laid on pages as a typewriter would, so that every operator runs
over whole tables without one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, BODY = 612.0, 792.0, 10.0
PITCH, LEADING, TOP = 6.0, 14.0, 36.0
LINES_A_PAGE, CHARS = 50, 90


def dimensions(words: DataFrame, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """A row for each page: doc_id, page_no, width, height, body_size (the upper median of its words' sizes, 10 without any). Sizes are
    counted before they are sorted."""
    counted = words.groupBy("doc_id", "page_no", "size").agg(F.count("size").alias("n"))
    some = F.when(F.col("size").isNotNull(), F.struct("size", "n"))
    own = counted.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(some)).alias("sizes"), F.floor(F.sum("n") / 2).alias("half"))
    upto = lambda s: F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + F.when(x["size"] <= s["size"], x["n"]).otherwise(0))
    body = F.get(F.filter("sizes", lambda s: upto(s) > F.col("half")), F.lit(0))["size"]
    return own.select("doc_id", "page_no", F.coalesce(body, F.lit(BODY)).alias("body_size"), F.lit(width).alias("width"), F.lit(height).alias("height"))


def folded_lines(text: Column, chars: int = CHARS) -> Column:
    """Lines of a text, white space as blanks, those of more than `chars` characters cut; blank lines stay, as null."""
    whole = lambda x: F.regexp_replace(x, r"[\t\x0B\f\r]", " ")
    cut = lambda x: F.when(F.trim(x) == "", F.array(F.lit(None).cast("string"))).otherwise(F.regexp_extract_all(x, F.lit(rf"[\s\S]{{1,{chars}}}"), F.lit(0)))
    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: cut(whole(x))))


def laid(lines: DataFrame, size: float = BODY) -> DataFrame:
    """Words of lines (doc_id, page_no, row, left, text): a character is PITCH wide, a row LEADING high; a row may be a fraction. A batch of
    lines is parted at once."""

    def run(batches):
        for b in batches:
            parts = pc.split_pattern(b["text"], " ")
            line, word = pc.list_parent_indices(parts).to_numpy(), pc.list_flatten(parts)
            n = pc.utf8_length(word).to_numpy()
            before = np.cumsum(n + 1) - (n + 1)
            some = n > 0
            first = np.append(True, line[1:] != line[:-1])[: len(line)]
            at = (before - before[first][np.cumsum(first) - 1])[some]
            line, n = line[some], n[some]
            of = pa.array(line)
            x0 = b["left"].to_numpy(zero_copy_only=False)[line] + at * PITCH
            y0 = b["row"].to_numpy(zero_copy_only=False)[line] * LEADING + TOP
            columns = [b["doc_id"].take(of), b["page_no"].take(of), *map(pa.array, (x0, y0, x0 + n * PITCH, y0 + size)), word.filter(pa.array(some)), pa.array(np.full(len(n), size)), pa.array(np.zeros(len(n), bool))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "page_no", "x0", "y0", "x1", "y1", "text", "size", "bold"])

    own = lines.select("doc_id", F.col("page_no").cast("int").alias("page_no"), F.col("row").cast("double").alias("row"), F.col("left").cast("double").alias("left"), "text")
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, page_no int, x0 double, y0 double, x1 double, y1 double, text string, size double, bold boolean")


def text_words(documents: DataFrame, columns: int = 1) -> DataFrame:
    """Words of every document's whole text on pages of 50 rows, in one column or two. Null texts and null doc_ids have no words. Texts are
    dealt first, for a file may come as one partition."""
    chars = CHARS if columns == 1 else 44
    own = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartition("doc_id")
    own = own.select("doc_id", F.posexplode(folded_lines(F.col("text"), chars)).alias("n", "text")).where("trim(text) <> ''")
    place = F.col("n") % (LINES_A_PAGE * columns)
    left = F.floor(place / LINES_A_PAGE) * (WIDTH / columns + 6.0) + 12.0
    row = place % LINES_A_PAGE + F.floor(place / LINES_A_PAGE) / 2  # the right column stands half a row lower, so that lines aren't one
    return laid(own.select("doc_id", F.floor(F.col("n") / (LINES_A_PAGE * columns)).alias("page_no"), row.alias("row"), left.alias("left"), "text"))
