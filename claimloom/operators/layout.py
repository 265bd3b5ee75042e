"""Words with their places on a page to lines, tables, columns, tiles, paragraphs, sections and boxes.

All but three are windows and expressions over lines; line banding, tables and section paths are folds, in Arrow kernels over one
page, table or document. Every operator groups by page or smaller, but for running lines and sections, which go by document. Null boxes and
texts are the reader's to leave out; a page without words has no lines, and an empty table gives an empty one. Rows that repeat are
words of their own. Other columns are not read.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.blocks import NUMERIC, numeric_token

LINES = (
    "doc_id long, page_no int, line_no int, x0 double, y0 double, x1 double, y1 double, mid double, size double, bold boolean, text string, "
    "words array<struct<x0: double, y0: double, x1: double, y1: double, text: string>>"
)
PAGE = ["doc_id", "page_no"]
# What makes a line look like a table's head, opens a paragraph, marks a footnote, opens a figure, or ends no heading;
# footnote marks that stand where a number might.
HEADERISH = r"(?i)[0-9]{4}|\bQ[1-4]\b|\bFY\b|\bH[12]\b|^[0-9]{2}/[0-9]{2}$"
MARKER = r"^(?:[IVXLC]+\.[0-9]+|[0-9]+\.[0-9]+(?:\.[0-9]+)?|\(\w{1,3}\)|[•▪●○–—*]|[0-9]+\.\s)"
NOTE = r"^\s*(?:\([0-9]{1,2}\)|[0-9]{1,2}[.)]|[*†‡])\s+\S"
FIGURE, NUMBERED = r"^[₹$€£]|^Rs\.?\s*[0-9]|^\(?[0-9]", r"^[0-9]{1,2}[.)]\s+[A-Z]"
OPEN_ENDS = [",", ";", ":", "-", "and", "the", "of", "in"]
REFERENCE = r"^\([0-9]\)$"
YEAR = r"^(?:19|20)[0-9]{2}[.,;]?$"
LABEL = r"^(?:[ivxlcIVXLC]{1,7}|[0-9]{1,4})$"


# ---- lines
def banded(mid: np.ndarray, x0: np.ndarray, tall: np.ndarray, share: float = 0.6) -> list[np.ndarray]:
    """Words to lines, as their places from left to right: down the page and then across, each word joins the newest of the last three
    lines whose middle (a running median) is within a share of the median height. Words of one middle go the same way, so they
    are dealt with at once."""
    tall = tall[tall > 0]
    tol = share * (float(np.median(tall)) if len(tall) else 8.0)
    order = np.lexsort((x0, mid))
    lines: list[tuple[float, list[np.ndarray]]] = []
    for own in np.split(order, np.flatnonzero(np.diff(mid[order])) + 1):
        at = float(mid[own[0]])
        home = next((i for i in range(len(lines) - 1, max(-1, len(lines) - 4), -1) if abs(lines[i][0] - at) <= tol), None)
        if home is None:
            lines.append((at, [own]))
        else:
            parts = [*lines[home][1], own]
            lines[home] = float(np.median(mid[np.concatenate(parts)])), parts
    across = [(m, w[np.argsort(x0[w], kind="stable")]) for m, w in ((m, np.concatenate(p)) for m, p in lines)]
    return [w for _, w in sorted(across, key=lambda x: (x[0], x0[x[1][0]]))]


def medians(v: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """The median of each part's values: NaN where it holds one, or none at all."""
    n = np.bincount(part, minlength=parts)
    begin = np.cumsum(n) - n
    out = np.full(parts, np.nan)
    some = n > 0
    v_ = v[np.lexsort((v, part))]
    lo, hi = v_[(begin + (n - 1) // 2)[some]], v_[(begin + n // 2)[some]]
    out[some] = np.where(lo == hi, lo, (lo + hi) / 2)
    out[part[np.isnan(v)]] = np.nan
    return out


def _parted(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Where rows differ from those before them in a key, the first row aside."""
    out = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        c = batch[k]
        none, v = c.is_null().to_numpy(zero_copy_only=False), c.fill_null(0).to_numpy(zero_copy_only=False)
        out |= (v[1:] != v[:-1]) | (none[1:] != none[:-1])
    return out


def whole_groups(batches, keys: list[str]):
    """Rows that come in the order of their keys (whole numbers) as tables that hold whole groups, about a batch at a time."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.flatnonzero(_parted(b, keys)) + 1
        if kept and _parted(pa.Table.from_batches([kept[-1].slice(kept[-1].num_rows - 1), b.slice(0, 1)]), keys)[0]:
            ends = np.append(0, ends)
        if len(ends):
            head = [*kept, b.slice(0, int(ends[-1]))]
            yield pa.Table.from_batches(head).combine_chunks()
            kept = []
        kept.append(b.slice(int(ends[-1]) if len(ends) else 0))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _floats(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t[c].to_numpy() for c in names]


def _banded_pages(begin: np.ndarray, mid: np.ndarray, x0: np.ndarray, tall: np.ndarray, share: float = 0.6) -> tuple[np.ndarray, np.ndarray]:
    """banded() for pages one after another, whose words begin at `begin`: words in the order of their lines, and where lines begin. Where
    a page's middles are all equal or farther apart than what makes a line, they are its lines; only other pages are folded."""
    n = np.diff(np.append(begin, len(mid)))
    part = np.repeat(np.arange(len(begin)), n)
    high = tall > 0
    tol = medians(tall[high], part[high], len(begin))
    tol = share * np.where(np.bincount(part[high], minlength=len(begin)) > 0, tol, 8.0)
    order = np.lexsort((x0, mid, part))
    gap = np.diff(mid[order])
    fresh = np.append(True, gap != 0)
    fresh[begin] = True
    near = ~(gap > tol[part[1:]]) & fresh[1:]
    near[begin[1:] - 1] = False
    for p in np.unique(np.append(part[1:][near], part[np.isnan(mid) | np.isnan(x0)])):
        a, z = begin[p], begin[p] + n[p]
        lines = banded(mid[a:z], x0[a:z], tall[a:z], share)
        order[a:z] = a + np.concatenate(lines)
        fresh[a:z] = False
        fresh[a + np.cumsum([0, *map(len, lines[:-1])])] = True
    return order, np.flatnonzero(fresh)


def lines_of(words: DataFrame, keep_words: bool = True) -> DataFrame:
    """Lines of each page, in order, with their box, middle, median size, whether most of it is bold, and (keep_words) their words. Pages are
    read in the order that their words are sorted in, many at a time."""

    def pages(t: pa.Table) -> pa.RecordBatch:
        x0, y0, x1, y1, size = _floats(t, "x0", "y0", "x1", "y1", "size")
        bold = t["bold"].fill_null(False).to_numpy().astype(np.int64)
        page = np.append(0, np.flatnonzero(_parted(t, PAGE)) + 1)
        mid = (y0 + y1) / 2
        own, begin = _banded_pages(page, mid, x0, y1 - y0)
        n = np.diff(np.append(begin, len(own)))
        line = np.repeat(np.arange(len(n)), n)
        of = np.searchsorted(page, begin, "right") - 1
        nth = np.arange(len(n)) - np.searchsorted(begin, page)[of]
        text = t["text"].combine_chunks().take(pa.array(own))
        ends = pa.array(np.append(begin, len(own)).astype(np.int32))
        first = pa.array(begin)
        columns = {
            "doc_id": t["doc_id"].combine_chunks().take(first), "page_no": t["page_no"].combine_chunks().take(first), "line_no": pa.array(nth.astype(np.int32)),
            **{k: pa.array(f.reduceat(v[own], begin)) for k, f, v in (("x0", np.minimum, x0), ("y0", np.minimum, y0), ("x1", np.maximum, x1), ("y1", np.maximum, y1))},
            "mid": pa.array(medians(mid[own], line, len(n))), "size": pa.array(medians(size[own], line, len(n))), "bold": pa.array(2 * np.add.reduceat(bold[own], begin) > n),
            "text": pc.binary_join(pa.ListArray.from_arrays(ends, text), " "),
        }
        if keep_words:
            struct = pa.StructArray.from_arrays([pa.array(x0[own]), pa.array(y0[own]), pa.array(x1[own]), pa.array(y1[own]), text], ["x0", "y0", "x1", "y1", "text"])
            columns["words"] = pa.ListArray.from_arrays(ends, struct)
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches):
        return (pages(t) for t in whole_groups(batches, PAGE))

    own = words.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "text", F.col("size").cast("double").alias("size"), "bold")
    return own.repartition(*PAGE).sortWithinPartitions(*PAGE).mapInArrow(run, LINES if keep_words else LINES[: LINES.index(", words")])


def in_margin(mid: Column, height: Column) -> Column:
    return (mid <= height * 0.10) | (mid >= height * 0.90)


def page_labels(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """The number printed on each page that has one: the first line in its margins that is a Roman or Arabic number."""
    own = lines.join(pages.select(*PAGE, "height"), PAGE).where(((F.col("mid") > F.col("height") * 0.90) | (F.col("mid") < F.col("height") * 0.10)) & F.trim("text").rlike(LABEL))
    return own.groupBy(*PAGE).agg(F.min_by(F.trim("text"), "line_no").alias("label"))


def scanned(words: DataFrame, pages: DataFrame, least: float = 0.5) -> DataFrame:
    """Pages of less than `least` characters for each 1,000 square points, words without text on them too: pictures of pages."""
    chars = words.groupBy(*PAGE).agg(F.sum(F.length("text")).alias("chars"))
    own = pages.join(chars, PAGE, "left").withColumn("density", F.coalesce("chars", F.lit(0)) / (F.col("width") * F.col("height") / 1000))
    return own.where(F.col("density") < least).select(*PAGE, "density")


# ---- tables
def numbers(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: numeric_token(w["text"])))


def table_regions(lines: DataFrame) -> DataFrame:
    """first and last line_no of what looks like a table on each page: three lines or more from the first of two numbers or more to the
    last, with single other lines between at most; and up to five lines above that are short or look like a head."""
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    own = lines.select(*PAGE, "line_no", numbers(F.col("words")).alias("n"), (F.size("words") <= 12).alias("short"), F.col("text").rlike(HEADERISH).alias("head"))
    joins = (F.col("n") >= 2) | F.col("short") | F.col("head")
    climb = F.when(F.lit(False), 0)
    for k in range(1, 6):
        climb = climb.when(~F.coalesce(F.lag(joins, k).over(w), F.lit(False)), k - 1)
    own = own.withColumn("climb", climb.otherwise(5)).where("n >= 2")
    own = own.withColumn("island", F.sum(F.when(F.col("line_no") - F.lag("line_no").over(w) > 2, 1).otherwise(0)).over(w))
    own = own.groupBy(*PAGE, "island").agg(F.min("line_no").alias("body"), F.max("line_no").alias("last"), F.min_by("climb", "line_no").alias("climb"))
    return own.where("last - body >= 2").select(*PAGE, (F.col("body") - F.col("climb")).alias("first"), "last")


def columns_of(tokens: DataFrame, share: float = 0.02) -> DataFrame:
    """Columns of numbers on each page: middles (x) apart by more than a share of the width part columns, which need two tokens.
    Digits in brackets are marks of footnotes (column text), and no column."""
    w = Window.partitionBy("doc_id", "page_no").orderBy("x")
    own = tokens.where(~F.trim("text").rlike(REFERENCE)) if "text" in tokens.columns else tokens
    own = own.withColumn("gap", F.col("x") - F.lag("x").over(w))
    own = own.withColumn("col", F.sum(F.when(F.col("gap") > F.col("width") * share, 1).otherwise(0)).over(w))
    own = own.groupBy("doc_id", "page_no", "col").agg(F.count(F.lit(1)).alias("n"), F.median("x").alias("centre"))
    return own.where("n >= 2").select("doc_id", "page_no", "n", "centre")


def is_number(text: str) -> bool:
    own = text.strip().rstrip(".,;")
    return "/" not in own and re.match(NUMERIC, own) is not None


class Grid:
    """A table's columns of numbers, and where a line's words belong."""

    def __init__(self, lines: list[list[dict]], width: float):
        tol = width * 0.02
        x = np.sort([(w["x0"] + w["x1"]) / 2 for line in lines for w in line if is_number(w["text"]) and not re.match(REFERENCE, w["text"].strip())])
        parts = np.split(x, np.flatnonzero(np.diff(x) > tol) + 1) if len(x) >= 3 else []
        self.centres = np.array([np.median(p) for p in parts if len(p) >= 2])
        self.reach = 1.8 * tol
        self.edge = self.centres.min() - 2 * tol if len(self.centres) else 0.0

    def placed(self, line: list[dict]) -> tuple[list[str], list[tuple[int, str]]]:
        """Words before the first column, and (column, word) of those near one."""
        label, cells = [], []
        for w in line:
            if w["x0"] < self.edge:
                label.append(w["text"])
                continue
            d = np.abs(self.centres - (w["x0"] + w["x1"]) / 2)
            if d.min() < self.reach:
                cells.append((int(d.argmin()), w["text"]))
        return label, cells


def _like_head(text: str, cells: list[tuple[int, str]]) -> bool:
    """Does a line with numbers look like a table's head? It has a year, quarter or half, and every column with a number has a year."""
    numbers: dict[int, bool] = {}
    for c, word in cells:
        if is_number(word) and not re.match(REFERENCE, word.strip()):
            numbers[c] = numbers.get(c, False) or re.match(YEAR, word.strip()) is not None
    return re.search(HEADERISH, text) is not None and all(numbers.values())


def _heads(placed: list[list[tuple[int, str]]], counts: list[int], texts: list[str], columns: int) -> tuple[int, list[str]]:
    """The line that names the columns (-1: none), the nearest of five above the body with names for half of them, and the names: what it
    leaves open the next two lines may name, else the column's number does. Where three lines of numbers or more look like heads, they
    are the body, for figures may look like years."""
    numeric = [i for i, n in enumerate(counts) if n >= 2]
    alike = next((k for k, i in enumerate(numeric) if not _like_head(texts[i], placed[i])), len(numeric))
    body = numeric[0] if alike >= 3 else numeric[alike] if alike < len(numeric) else len(texts)
    enough = max(2, (columns + 1) // 2)
    head = next((i for i in range(body - 1, max(-1, body - 6), -1) if len({c for c, _ in placed[i]}) >= enough), -1)
    names = [""] * columns
    if head >= 0:
        sources = [head]
        for i in range(head + 1, min(head + 3, len(texts))):
            if counts[i] >= 2:
                break
            sources.append(i)
        for i in sources:
            for c in {c for c, _ in placed[i]}:
                names[c] = names[c] or " ".join(t for k, t in placed[i] if k == c)
    return head, [n or f"col{c + 1}" for c, n in enumerate(names)]


def table_of(lines: list[list[dict]], width: float) -> tuple[str, list[dict]] | None:
    """Caption and rows (section, label, cells of header and value) of a table's lines; None where there are no columns or a cell would
    hold two numbers, which means that the columns were misread.

    A line without numbers is a section's banner (two words or more). Parts of a number that ends in a point or comma are put
    together again. A row without a label has the one above."""
    grid = Grid(lines, width)
    if not len(grid.centres):
        return None
    texts = [" ".join(w["text"] for w in x) for x in lines]
    counts = [sum(is_number(w["text"]) for w in x) for x in lines]
    placed = [grid.placed(x) for x in lines]
    head, names = _heads([cells for _, cells in placed], counts, texts, len(grid.centres))
    rows: list[dict] = []
    for i in range(head + 1, len(lines)):
        if not counts[i]:
            if len(texts[i].split()) >= 2:
                rows.append({"section": True, "label": texts[i].strip(), "cells": {}})
            continue
        label, found = placed[i]
        cells: dict[str, str] = {}
        for c, word in found:
            before = cells.get(names[c], "")
            cells[names[c]] = before + ("" if not before or before[-1] in ".," else " ") + word
        if any(sum(map(is_number, v.split())) > 1 for v in cells.values()):
            return None
        if cells:
            rows.append({"section": False, "label": " ".join(label) or (rows[-1]["label"] if rows else ""), "cells": cells})
    caption = " ".join(texts[: max(head, 0)]).strip()[:300]
    return caption, [{**r, "cells": [{"header": k, "value": v} for k, v in r["cells"].items()]} for r in rows]


TABLE = "doc_id long, page_no int, first int, last int, caption string, rows array<struct<section: boolean, label: string, cells: array<struct<header: string, value: string>>>>"
CELLS = pa.list_(pa.struct([("section", pa.bool_()), ("label", pa.string()), ("cells", pa.list_(pa.struct([("header", pa.string()), ("value", pa.string())])))]))


def tables_of(lines: DataFrame, regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Tables read from their regions, see table_of(); a region that can't be read gives none."""

    by = [*PAGE, "first"]

    def run(batches):
        for t in whole_groups(batches, by):
            out = []
            for _, rows in itertools.groupby(t.to_pylist(), lambda r: tuple(r[k] for k in by)):
                own = list(rows)
                got = table_of([r["words"] for r in own], own[0]["width"])
                if got and got[1]:
                    out.append((own[0]["doc_id"], own[0]["page_no"], own[0]["first"], own[0]["last"], *got))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), CELLS]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "page_no", "first", "last", "caption", "rows"])

    own = lines.join(regions, PAGE).where(F.col("line_no").between(F.col("first"), F.col("last"))).join(pages.select(*PAGE, "width"), PAGE)
    return own.select(*PAGE, "first", "last", "line_no", "width", "words").repartition(*by).sortWithinPartitions(*by, "line_no").mapInArrow(run, TABLE)


# ---- columns and tiles
def gutters(lines: DataFrame, pages: DataFrame, bins: int = 200) -> DataFrame:
    """Where pages of two columns are parted: split, the middle of the free strip across the page's centre that is 2.5 % of its width
    or more, with five lines on either side, of eight or more in all."""
    own = lines.join(pages.select(*PAGE, "width"), PAGE)
    lo = F.greatest(F.lit(0), F.floor(F.col("x0") / F.col("width") * bins))
    hi = F.least(F.lit(bins - 1), F.floor(F.col("x1") / F.col("width") * bins))
    w = Window.partitionBy(*PAGE).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    free = own.withColumns({"lo": lo, "hi": hi}).withColumn("from", F.max("hi").over(w) + 1)
    free = free.where((F.col("lo") - F.col("from") >= bins * 0.025) & (F.col("from") <= bins // 2) & (F.col("lo") >= bins // 2))
    split = free.groupBy(*PAGE).agg(F.max_by((F.col("from") + F.col("lo")) / 2 / bins * F.col("width"), F.col("lo") - F.col("from")).alias("split"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sides = lines.join(split, PAGE).groupBy(*PAGE, "split").agg(n(F.col("x1") <= F.col("split")).alias("left"), n(F.col("x0") >= F.col("split")).alias("right"), F.count(F.lit(1)).alias("n"))
    return sides.where("n >= 8 AND left >= 5 AND right >= 5").select(*PAGE, "split")


def tiles(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines of slides as segments (tile, nth, text), in reading order: lines are parted at wide gaps between words; segments wider than
    55 % of the page are the banner, tile 0; the others form tiles, from left to right, where their middles lie close together."""
    own = lines.join(pages.select(*PAGE, "width"), PAGE).select(*PAGE, "line_no", "width", F.explode("words").alias("w"))
    across = Window.partitionBy(*PAGE, "line_no").orderBy("w.x0", "w.x1")
    own = own.withColumn("part", F.sum(F.when(F.col("w.x0") - F.lag("w.x1").over(across) > F.col("width") * 0.035, 1).otherwise(0)).over(across))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w.x0", "w.x1", "w.text"))), lambda s: s["text"]), " ")
    seg = own.groupBy(*PAGE, "width", "line_no", "part").agg(F.min("w.x0").alias("x0"), F.max("w.x1").alias("x1"), F.median((F.col("w.y0") + F.col("w.y1")) / 2).alias("mid"), text.alias("text"))
    seg = seg.withColumns({"banner": F.col("x1") - F.col("x0") > F.col("width") * 0.55, "centre": (F.col("x0") + F.col("x1")) / 2})
    down = Window.partitionBy(*PAGE, "banner").orderBy("centre")
    step = F.when(F.col("centre") - F.lag("centre").over(down) > F.col("width") * 0.05, 1).otherwise(0)
    seg = seg.withColumn("step", step).withColumn("tile", F.when(F.col("banner"), 0).otherwise(F.sum("step").over(down) + 1).cast("int"))
    nth = F.row_number().over(Window.partitionBy(*PAGE, "tile").orderBy("mid", "x0", "line_no"))
    return seg.select(*PAGE, "tile", nth.alias("nth"), "text", "x0", "x1", "mid")


# ---- paragraphs
def paragraphs(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines of each `by` (with col_width), in their order, as paragraphs: para, first line_no, text and box. One begins after a wide
    gap or a short line, at a marker, or where the size changes. A word parted by a hyphen is put together with its hyphen."""
    part, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("line_no")
    own = lines.withColumns({"t": F.trim("text"), "gap": F.col("y0") - F.lag("y1").over(w)})
    usual = F.coalesce(F.median(F.when(F.col("gap") > -2, F.col("gap"))).over(part), F.lit(2.0))
    tall = F.median(F.col("y1") - F.col("y0")).over(part)
    own = own.withColumns({"usual": usual, "tall": tall})
    new = (
        F.lag("line_no").over(w).isNull()
        | (F.col("gap") > F.greatest(F.col("usual") + F.col("tall") * 0.6, F.col("tall") * 0.9))
        | F.col("text").rlike(MARKER)
        | (F.lag(F.col("x1") - F.col("x0")).over(w) < F.col("col_width") * 0.55)
        | (F.abs(F.col("size") - F.lag("size").over(w)) > 1.2)
    )
    hyphen = F.lag("t").over(w).endswith("-") & F.col("t").rlike(r"^\p{Ll}")
    own = own.withColumns({"new": new, "hyphen": hyphen}).withColumn("para", F.sum(F.col("new").cast("int")).over(w))
    own = own.withColumn("s", F.concat(F.when(F.col("new") | F.col("hyphen"), "").otherwise(" "), F.col("t")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "s"))), lambda x: x["s"]), "")
    out = own.groupBy(*by, "para").agg(
        F.min("line_no").alias("line_no"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    return out.where("text <> ''")


def heading(text: Column, x0: Column, x1: Column, size: Column, bold: Column, body: Column, col_width: Column) -> Column:
    """Is a line a heading? Short of the column's width, larger than the body or bold or in capitals, and neither a sentence, nor a line
    that goes on, nor a figure."""
    t = F.trim(text)
    n = F.length(t)
    goes_on = F.lit(False)
    for end in OPEN_ENDS:
        goes_on = goes_on | t.endswith(end)
    figure = t.rlike(FIGURE) & ~t.rlike(NUMBERED)
    capitals = (F.upper(t) == t) & (F.lower(t) != t) & (n > 4)
    styled = (size >= body * 1.12) | ((bold | capitals) & (n < 70))
    return n.between(3, 110) & ~goes_on & ~(t.rlike(r"[.!?]$") & (n > 40)) & (x1 - x0 <= col_width * 0.85) & ~figure & styled


def pushed(stack: list[tuple[float, str]], size: float, text: str) -> list[tuple[float, str]]:
    """A stack of headings with a new one, under those larger than it; three at most."""
    return [*(x for x in stack if x[0] > size), (size, text)][-3:]


def sections(headings: DataFrame) -> DataFrame:
    """doc_id, nth and path (outer > inner) after each heading (doc_id, nth, size, text) of a document, in order of nth; a null text clears
    the path."""

    def run(batches):
        doc, stack = object(), []
        for b in batches:
            out = []
            for d, size, text in zip(*(b[c].to_pylist() for c in ("doc_id", "size", "text")), strict=True):
                doc, stack = d, stack if d == doc else []
                stack = [] if text is None else pushed(stack, size, text)
                out.append(" > ".join(x for _, x in stack))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["nth"], pa.array(out, pa.string())], ["doc_id", "nth", "path"])

    own = headings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("nth").cast("long").alias("nth"), F.col("size").cast("double").alias("size"), "text")
    return own.repartition("doc_id").sortWithinPartitions("doc_id", "nth").mapInArrow(run, "doc_id long, nth long, path string")


def footnotes(lines: DataFrame, pages: DataFrame, most: int = 8) -> DataFrame:
    """The first `most` footnotes of each page as an array: lines in its lowest 30 % that are small or begin with a mark."""
    own = lines.join(pages.select(*PAGE, "height", "body_size"), PAGE)
    small = (F.col("size") > 0) & (F.col("size") <= F.col("body_size") * 0.94)
    own = own.where((F.col("y0") >= F.col("height") * 0.70) & (small | F.col("text").rlike(NOTE)) & F.length(F.trim("text")).between(8, 300))
    own = own.withColumn("rn", F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_no"))).where(F.col("rn") <= most)
    notes = F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t")))), lambda x: x["t"])
    return own.groupBy(*PAGE).agg(notes.alias("notes"))


# ---- boxes
def inside(box: Column, within: Column, pad: float = 6.0) -> Column:
    """Do two boxes meet, give or take pad? Anything is within null."""
    hit = (box["x1"] >= within["x0"] - pad) & (box["x0"] <= within["x1"] + pad) & (box["y1"] >= within["y0"] - pad) & (box["y0"] <= within["y1"] + pad)
    return within.isNull() | F.coalesce(hit, F.lit(False))


def barred(boxes: list[tuple[float, float, float, float]], tol: float = 4.0) -> list[tuple[float, float, float, float]]:
    """Boxes that lie on one line as one: a box whose top is within tol of the first of a line, the earliest that fits, belongs to it."""
    lines: list[list[tuple]] = []
    for b in sorted(boxes, key=lambda b: (b[1], b[0])):
        home = next((x for x in lines if abs(x[0][1] - b[1]) <= tol), None)
        lines.append([b]) if home is None else home.append(b)
    return [(min(b[0] for b in x), min(b[1] for b in x), max(b[2] for b in x), max(b[3] for b in x)) for x in lines]


def merged_boxes(boxes: DataFrame, tol: float = 4.0) -> DataFrame:
    """Boxes of each fact (fact_id, x0, y0, x1, y1) that lie on one line, as one; see barred(). Boxes of one top are one before they are dealt."""

    def run(batches):
        for t in whole_groups(batches, ["fact_id"]):
            x0, y0, x1, y1 = _floats(t, "x0", "y0", "x1", "y1")
            fact = np.append(True, _parted(t, ["fact_id"]))
            fresh, top = [], 0.0
            for f, y in zip(fact.tolist(), y0.tolist(), strict=True):
                fresh.append(f or abs(top - y) > tol)
                top = y if fresh[-1] else top
            begin = np.flatnonzero(fresh)
            own = np.flatnonzero(fact)
            nth = np.arange(len(begin)) - np.searchsorted(begin, own)[np.searchsorted(own, begin, "right") - 1] + 1
            edges = [pa.array(f.reduceat(v, begin)) for f, v in ((np.minimum, x0), (np.minimum, y0), (np.maximum, x1), (np.maximum, y1))]
            yield pa.RecordBatch.from_arrays([t["fact_id"].combine_chunks().take(pa.array(begin)), pa.array(nth), *edges], ["fact_id", "line", "x0", "y0", "x1", "y1"])

    own = boxes.select(F.col("fact_id").cast("long").alias("fact_id"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    own = own.groupBy("fact_id", "y0").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return own.repartition("fact_id").sortWithinPartitions("fact_id", "y0").mapInArrow(run, "fact_id long, line long, x0 double, y0 double, x1 double, y1 double")


def _tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def located_in(quote: str, value: str, words: list[dict], within: dict | None) -> tuple[str, list[tuple[float, float, float, float]]]:
    """How a fact's evidence is found among a page's words (quote, value, block, none) and its boxes: the stretch of words that has the
    quote's tokens best (of several, the first of those that reach over the fewest rows), three quarters of them at least; else up to four words with the value's digits, or six with one of its
    tokens; else the block."""
    near = lambda w: within is None or (w["x1"] >= within["x0"] - 6 and w["x0"] <= within["x1"] + 6 and w["y1"] >= within["y0"] - 6 and w["y0"] <= within["y1"] + 6)
    box = lambda w: (w["x0"], w["y0"], w["x1"], w["y1"])
    own = [w for w in words if near(w)]
    want = _tokens(quote)
    flat = [(t, i) for i, w in enumerate(own) for t in _tokens(w["text"])]
    if len(want) >= 3 and flat:
        code = {t: i for i, t in enumerate(dict.fromkeys(want))}
        have = np.array([code.get(t, -1) for t, _ in flat] + [-1] * max(len(want) - len(flat), 0))
        places = len(have) - len(want) + 1
        hits = sum((have[j : j + places] == code[t]).astype(int) for j, t in enumerate(want))
        best = np.flatnonzero(hits == hits.max())
        top = np.array([own[i]["y0"] for _, i in flat])
        at = int(best[np.argmin(top[np.minimum(best + len(want), len(flat)) - 1] - top[best])])
        if hits[at] >= 0.75 * len(want):
            lo, hi = flat[at][1], flat[min(at + len(want), len(flat)) - 1][1]
            return "quote", barred([box(w) for w in own[lo : hi + 1]])
    digits = re.sub(r"\D", "", value)
    if digits:
        found = [box(w) for w in own if re.sub(r"\D", "", w["text"]) == digits][:4]
    else:
        found = [box(w) for w in own if set(_tokens(value)) & set(_tokens(w["text"]))][:6]
    if found:
        return "value", barred(found)
    return ("block", [box(within)]) if within else ("none", [])


RECTS = pa.list_(pa.struct([("x0", pa.float64()), ("y0", pa.float64()), ("x1", pa.float64()), ("y1", pa.float64())]))


def located(facts: DataFrame, words: DataFrame) -> DataFrame:
    """fact_id, how and rects of every fact (fact_id, doc_id, page_no, quote, value, block: a box or null), see located_in(). A page's words
    come in their lines' order. Null quotes and values count as empty; a page without words has none. Pages stay dealt out for the join:
    sent to the facts, which may be one partition, they would all be searched there."""
    order = F.array_sort(F.collect_list(F.struct("line_no", "words")))
    page = lines_of(words).groupBy(*PAGE).agg(F.flatten(F.transform(order, lambda x: x["words"])).alias("words"))
    own = facts.select(F.col("fact_id").cast("long").alias("fact_id"), *PAGE, F.coalesce("quote", F.lit("")).alias("quote"), F.coalesce("value", F.lit("")).alias("value"), "block")
    own = own.hint("merge").join(page.hint("merge"), PAGE, "left")

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            got = [located_in(r["quote"], r["value"], r["words"] or [], r["block"]) for r in rows]
            rects = [[dict(zip(("x0", "y0", "x1", "y1"), x, strict=True)) for x in found] for _, found in got]
            yield pa.record_batch([pa.array([r["fact_id"] for r in rows], pa.int64()), pa.array([h for h, _ in got], pa.string()), pa.array(rects, RECTS)], ["fact_id", "how", "rects"])

    return own.mapInArrow(run, "fact_id long, how string, rects array<struct<x0: double, y0: double, x1: double, y1: double>>")
