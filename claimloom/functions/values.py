"""Values as written in documents: parsing, comparability and agreement, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.binding import let

# Scale words, currency marks in the order they are tried, and unit names.
SCALES = {
    "hundred": 1e2, "thousand": 1e3, "k": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "million": 1e6, "millions": 1e6,
    "mn": 1e6, "mln": 1e6, "m": 1e6, "crore": 1e7, "crores": 1e7, "cr": 1e7, "billion": 1e9, "billions": 1e9, "bn": 1e9,
    "trillion": 1e12, "tn": 1e12, "lakh crore": 1e12, "lakh crores": 1e12, "thousand crore": 1e10, "thousand crores": 1e10,
}
CURRENCIES = [("₹", "INR"), ("rs.", "INR"), ("rs", "INR"), ("inr", "INR"), ("us$", "USD"), ("usd", "USD"), ("$", "USD"), ("€", "EUR"), ("eur", "EUR"), ("£", "GBP"), ("gbp", "GBP")]
WORDY = {"rs", "inr", "usd", "eur", "gbp"}  # no letter may stand beside these
UNITS = {"ton": "tons", "tons": "tons", "tonne": "tons", "tonnes": "tons", "mt": "tons", "kg": "kg", "km": "km", "sqft": "sqft", "sq ft": "sqft", "days": "days", "day": "days", "x": "times", "times": "times"}

_SCALE = "|".join(sorted(SCALES, key=len, reverse=True))
NUMBER = rf"(?i)([0-9][0-9, ]*(?:\.[0-9]+)?)\s*({_SCALE})?\b"


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _forms() -> tuple[str, str]:
    """Characters that compatibility folding (NFKC) makes another single one: full-width, superscript, circled and the like."""
    own = [(c, n) for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c and not 0xF900 <= ord(c) < 0xFB00]
    return "".join(c for c, _ in own), "".join(n for _, n in own)


FORMS = _forms()


def tidy(raw: Column) -> Column:
    """One space for runs of white space (no-break spaces too), a minus for its look-alike, and the usual form of characters that have
    another: full-width digits and signs, for one. Characters that fold to several (fractions, unit signs) stay as they are."""
    own = F.coalesce(raw, F.lit(""))
    own = F.when(own.rlike(r"[^\x00-\x7F]"), F.translate(own, *FORMS)).otherwise(own)
    return F.trim(F.regexp_replace(F.replace(own, F.lit("−"), F.lit("-")), "[\\s ]+", " "))


def sig_figs(number: Column) -> Column:
    """Significant digits of a number as written; trailing zeros count only after a point."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    lead = F.regexp_replace(digits, "^0+", "")
    own = F.when(F.contains(number, F.lit(".")), lead).otherwise(F.regexp_replace(lead, "0+$", ""))
    return F.greatest(F.length(own), F.lit(1))


def _mark(text: Column) -> Column:
    """The number (from 1) of the first mark in the list that the text holds; wordy marks count at their first place alone."""

    def first(low: Column) -> Column:
        out = F.when(F.lit(False), 0)
        for i, (mark, _) in enumerate(CURRENCIES, 1):
            at = F.locate(mark, low)
            if mark in WORDY:
                near = F.concat(F.when(at > 1, F.substring(low, at - 1, F.lit(1))).otherwise(""), F.lit("0"), F.substring(low, at + len(mark), F.lit(1)))
                out = out.when((at > 0) & ~near.rlike(r"\p{L}"), i)
            else:
                out = out.when(at > 0, i)
        return out

    return let(F.lower(text), first)


def _code(mark: Column) -> Column:
    return F.get(F.lit([c for _, c in CURRENCIES]), mark - 1)


def currency(text: Column) -> Column:
    return _code(_mark(text))


def _without_mark(text: Column, mark: Column) -> Column:
    sign = F.get(F.lit([m for m, _ in CURRENCIES]), mark - 1)
    cut = let(F.position(sign, F.lower(text)), lambda at: F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(sign), F.length(text))))
    return F.when(mark.isNull(), text).otherwise(cut)


def scale(text: Column, own: Column) -> Column:
    """The factor of the scale word after the number; a compound of lakh or thousand with crore anywhere counts before it."""
    both = F.regexp_extract(F.lower(text), r"\b(lakh|thousand)\s+crores?\b", 1)
    return F.coalesce(_lookup(SCALES, F.when(both != "", F.concat(both, F.lit(" crore"))).when(own != "", F.lower(own))), F.lit(1.0))


def unit(tail: Column) -> Column:
    """The first two words after a number, by their usual name where they have one; empty without words."""
    t = F.regexp_replace(F.lower(F.trim(tail)), "^[^a-z]+", "")
    words = F.slice(F.filter(F.split(F.regexp_extract(t, "^([^,.]*)", 1), " +"), lambda w: w != ""), 1, 2)
    return let(words, lambda w: let(F.array_join(w, " "), lambda two: F.coalesce(_lookup(UNITS, two), _lookup(UNITS, F.get(w, F.lit(0))), two)))


def parse(raw: Column) -> Column:
    """kind, number, unit, unit_family and sig_figs of a value as written.

    A parenthesis with a digit, or a leading minus, makes it negative. Basis points, percentage points, per cent, a currency and a unit
    of measure decide the kind in that order; without a number it is text.
    """
    def unbracketed(t: Column) -> Column:
        paren = t.rlike(r"\(\s*[^)]*[0-9][^)]*\)")
        bare = F.when(paren, F.translate(t, "()", "  ")).otherwise(t)
        return let(F.struct(bare.alias("text"), (paren | t.rlike(r"^\s*-")).alias("negative")), marked)

    def marked(t: Column) -> Column:
        return let(_mark(t["text"]), lambda m: let(_without_mark(t["text"], m), lambda text: numbered(text, _code(m), t["negative"])))

    def numbered(text: Column, code: Column, negative: Column) -> Column:
        size = F.regexp_replace(F.trim(F.regexp_extract(text, NUMBER, 1)), "[, ]", "").try_cast("double") * scale(text, F.regexp_extract(text, NUMBER, 2))
        named = unit(F.regexp_extract(text, NUMBER + r"(.*)$", 3))
        low = F.lower(text)
        points = low.rlike(r"\bpercentage points?\b|\bppt?s?\b")
        found = F.struct(
            size.alias("size"), named.alias("unit"), low.rlike(r"\bbps\b|\bbasis points?\b").alias("bps"), points.alias("points"),
            (low.rlike(r"%|\bper\s?cents?\b|\bpercent(?:age)?\b") & ~points).alias("percent"),
        )
        return let(found, lambda f: classed(text, code, negative, f))

    def classed(text: Column, code: Column, negative: Column, f: Column) -> Column:
        kind = F.when(f["size"].isNull(), "text").when(f["bps"] | f["points"], "points").when(f["percent"], "percent").when(code.isNotNull(), "money").when(f["unit"] != "", "quantity").otherwise("number")
        number = F.when(negative, -F.abs(f["size"])).otherwise(f["size"])
        figures = F.when(f["size"].isNotNull(), sig_figs(F.trim(F.regexp_extract(text, NUMBER, 1)))).otherwise(0)

        def shaped(k: Column) -> Column:
            family = F.when(k == "money", F.concat(F.lit("currency:"), code)).when(k == "quantity", F.concat(F.lit("quantity:"), f["unit"])).otherwise(k)
            shown = F.when(k == "points", "pp").when(k == "percent", "%").when(k == "money", code).when(k == "quantity", f["unit"])
            return F.struct(k.alias("kind"), F.when(f["bps"], number / 100).otherwise(number).alias("number"), shown.alias("unit"), family.alias("unit_family"), figures.alias("sig_figs"))

        return let(kind, shaped)

    return let(tidy(raw), unbracketed)


def comparable(a_num: Column, a_unit: Column, b_num: Column, b_unit: Column) -> Column:
    """Numbers of one unit family, or a bare number beside per cent or points."""
    bare = lambda x, y: (x == "number") & y.isin("percent", "points")
    return F.coalesce(a_num.isNotNull() & b_num.isNotNull() & ((a_unit == b_unit) | bare(a_unit, b_unit) | bare(b_unit, a_unit)), F.lit(False))


def round_sig(x: Column, sig: Column) -> Column:
    """x to sig significant digits, ties to the even digit."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - sig + 1)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.bround(x / step, 0) * step)


def agreement(a_num: Column, a_sig: Column, b_num: Column, b_sig: Column, tolerance: float = 0.005) -> Column:
    """Why two comparable numbers agree, or null: equal, within the tolerance, or equal once both are rounded to the fewer digits."""
    most = F.greatest(F.abs(a_num), F.abs(b_num))
    digits = lambda s: F.when(F.coalesce(s, F.lit(0)) > 0, s).otherwise(15)
    sig = F.greatest(F.lit(2), F.least(digits(a_sig), digits(b_sig)))
    return (
        F.when(a_num == b_num, "exact match")
        .when(F.abs(a_num - b_num) / most <= tolerance, f"within {tolerance:.1%} relative tolerance")
        .when(round_sig(a_num, sig) == round_sig(b_num, sig), F.concat(F.lit("agree at "), sig.cast("string"), F.lit(" significant figures (one source is rounded)")))
    )
