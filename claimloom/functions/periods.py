"""Periods as written in documents: parsing to date intervals and their relations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.binding import let

# Months by their first letters, and the month in which a fiscal year begins.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
FISCAL_MONTH = 4

PAIR = r"(?:fy\s*([0-9]{2,4})|((?:19|20)[0-9]{2}))\s*[-/]\s*([0-9]{2,4})"
ALONE = r"fy\s*([0-9]{2,4})"
EITHER = rf"(?:{PAIR}|{ALONE})"
DAY_FIRST = r"([0-9]{1,2})\s+([a-z]{3,9})\.?,?\s+([0-9]{4})"
MONTH_FIRST = r"([a-z]{3,9})\.?\s+([0-9]{1,2}),?\s+([0-9]{4})"


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def _first(y: Column, m: Column | int) -> Column:
    return _day(y, m if isinstance(m, Column) else F.lit(m), F.lit(1))


def century(y: Column) -> Column:
    return F.when(y >= 100, y).when(y < 70, y + 2000).otherwise(y + 1900)


def pair_end(first: Column, second: Column) -> Column:
    """The year in which the fiscal year of a written pair ends: 2023-24, 1999-00, 2023/2024."""
    near = lambda a: a - a % 100 + second
    return let(century(first), lambda a: F.when(second >= 100, second).when(near(a) < a, near(a) + 100).otherwise(near(a)))


def fiscal_quarter(date: Column) -> Column:
    """1 to 4, the first from April."""
    return F.floor(((F.month(date) + 12 - FISCAL_MONTH) % 12) / 3).cast("int") + 1


def fiscal_year_of(date: Column) -> Column:
    """The year in which the fiscal year of a date ends."""
    return F.year(date) + F.when(F.month(date) >= FISCAL_MONTH, 1).otherwise(0)


def quarter_start(end_year: Column, q: Column) -> Column:
    return F.add_months(_first(end_year - 1, FISCAL_MONTH), (q - 1) * 3)


def quarters(end_year: Column, q: Column, n: Column | int) -> tuple[Column, Column]:
    """First and last day of n quarters from the q-th."""
    n = n if isinstance(n, Column) else F.lit(n)
    return quarter_start(end_year, q), F.date_sub(F.add_months(quarter_start(end_year, q), n * 3), 1)


def fiscal_label(end_year: Column) -> Column:
    return F.concat(F.lit("FY"), (end_year - 1).cast("string"), F.lit("-"), F.substring(end_year.cast("string"), 3, 4))


def month_no(word: Column) -> Column:
    at = F.array_position(F.lit(MONTHS), F.substring(word, 1, 3)).cast("int")
    return F.when(at > 0, at)


def _interval(start: Column, end: Column, gran: str | Column, fiscal: bool | Column, label: Column, ambiguous: Column | bool = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(start.alias("start"), end.alias("end"), lit(gran).alias("gran"), lit(fiscal).alias("fiscal"), label.alias("label"), lit(ambiguous).alias("ambiguous"))


def parse(raw: Column) -> Column:
    """start, end (both days within), gran, fiscal, label and ambiguous; null where nothing reads as a period.

    Tried in this order: a day; a quarter, half or nine months of a fiscal year; a calendar year; a fiscal year as a pair, not
    if the pair spans years; a fiscal year alone; a month; a bare year.
    """
    tidy = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " ")), "[.,;:]+$", "")
    return let(F.lower(tidy), _parsed)


def _year_of(t: Column, pattern: str, skip: int) -> Column:
    """The fiscal year's end from the groups of EITHER after `skip` others; null where the pattern isn't found."""
    n = lambda i: _int(F.regexp_extract(t, pattern, skip + i))
    first = F.coalesce(n(1), n(2))
    return F.when(first.isNotNull(), pair_end(first, n(3))).otherwise(century(n(4)))


def _parsed(t: Column) -> Column:
    get = lambda p, i: F.regexp_extract(t, p, i)
    n = lambda p, i: _int(get(p, i))
    q, h = rf"\bq([1-4])\s*(?:of\s*)?{EITHER}", rf"\bh([12])\s*(?:of\s*)?{EITHER}"
    nine, cy = rf"\b(?:9m|nine\s+months?)\s*(?:of\s*)?{EITHER}", r"\b(?:cy|calendar\s+year)\s*([0-9]{4})\b"
    pair, alone, bare, my = rf"\b{PAIR}\b", rf"\b{ALONE}\b", r"^((?:19|20)[0-9]{2})$", r"\b([a-z]{3,9})\.?\s+([0-9]{4})\b"

    def of_day(text: Column) -> Column:
        by_day = text.rlike(f"^{DAY_FIRST}$")
        part = lambda a, b: F.when(by_day, F.regexp_extract(text, f"^{DAY_FIRST}$", a)).otherwise(F.regexp_extract(text, f"^{MONTH_FIRST}$", b))
        return F.struct(month_no(part(2, 1)).isNotNull().alias("is"), _day(_int(part(3, 3)), month_no(part(2, 1)), _int(part(1, 2))).alias("day"))

    year = lambda y: (_first(y, 1), _day(y, F.lit(12), F.lit(31)))
    named = lambda a, y: F.concat(a, F.lit(" "), fiscal_label(y))
    fiscal = lambda y, ambiguous=False: _interval(*quarters(y, F.lit(1), 4), "year", True, fiscal_label(y), ambiguous)
    calendar = lambda y, ambiguous=False: _interval(*year(y), "year", False, F.concat(F.lit("CY"), y.cast("string")), ambiguous)
    first = F.coalesce(n(pair, 1), n(pair, 2))
    spans = (F.length(get(pair, 3)) == 4) & (n(pair, 3) - century(first) > 1)
    month = _first(n(my, 2), month_no(get(my, 1)))

    def rest(d: Column) -> Column:
        return (
            F.when(d["is"] & d["day"].isNull(), F.lit(None))
            .when(d["is"], _interval(d["day"], d["day"], "instant", False, d["day"].cast("string")))
            .when(t.rlike(q), let(_year_of(t, q, 1), lambda y: _interval(*quarters(y, n(q, 1), 1), "quarter", True, named(F.concat(F.lit("Q"), get(q, 1)), y))))
            .when(t.rlike(h), let(_year_of(t, h, 1), lambda y: _interval(*quarters(y, n(h, 1) * 2 - 1, 2), "half", True, named(F.concat(F.lit("H"), get(h, 1)), y))))
            .when(t.rlike(nine), let(_year_of(t, nine, 0), lambda y: _interval(*quarters(y, F.lit(1), 3), "nine_month", True, named(F.lit("9M"), y))))
            .when(t.rlike(cy), let(n(cy, 1), lambda y: calendar(y)))
            .when(t.rlike(pair) & ~spans, let(pair_end(first, n(pair, 3)), lambda y: fiscal(y)))
            .when(t.rlike(alone), let(century(n(alone, 1)), lambda y: fiscal(y, F.length(get(alone, 1)) == 4)))
            .when(month.isNotNull(), let(month, lambda m: _interval(m, F.last_day(m), "month", False, F.date_format(m, "yyyy-MM"))))
            .when(t.rlike(bare), let(n(bare, 1), lambda y: calendar(y, True)))
        )

    return let(let(F.regexp_extract(t, f"(?:{DAY_FIRST}|{MONTH_FIRST})", 0), of_day), rest)


SCANNED = [
    rf"(?i)\bq[1-4]\s*{EITHER}", rf"(?i)\bh[12]\s*{EITHER}", rf"(?i)\b(?:9m|nine\s+months?)\s*{EITHER}", r"(?i)\b(?:cy|calendar\s+year)\s*[0-9]{4}\b",
    r"(?i)\bfy\s*[0-9]{2,4}\s*[-/]\s*[0-9]{2,4}\b", r"(?i)\b(?:19|20)[0-9]{2}\s*[-/]\s*[0-9]{2,4}\b", r"(?i)\bfy\s*[0-9]{2,4}\b",
    r"(?i)\bas\s+(?:of|at|on)\s+[a-z0-9,\s]{6,20}[0-9]{4}\b",
]


def find(text: Column) -> Column:
    """The periods in a text, by pattern and then place, each interval once."""
    hits = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)) for p in SCANNED]))
    seen = lambda a, p: F.exists(a, lambda x: (x["start"] == p["start"]) & (x["end"] == p["end"]))
    once = lambda own: F.aggregate(own, F.filter(own, lambda p: F.lit(False)), lambda a, p: F.when(seen(a, p), a).otherwise(F.concat(a, F.array(p))))
    return let(F.filter(F.transform(hits, parse), lambda p: p.isNotNull()), once)


def relation(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How two intervals with both ends within lie: of equal bounds, one in the other, sharing days, or apart."""
    return (
        F.when((a0 == b0) & (a1 == b1), "equal")
        .when((a0 <= b0) & (a1 >= b1), "contains")
        .when((b0 <= a0) & (b1 >= a1), "contained_by")
        .when((a0 <= b1) & (b0 <= a1), "overlaps")
        .when(a0.isNotNull() & b0.isNotNull(), "disjoint")
    )
