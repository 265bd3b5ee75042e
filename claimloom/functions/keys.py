"""Phrase and claim keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Filler words of a phrase, and endings of company names.
FILLER = ["the", "a", "an", "of", "for", "in", "on", "at", "to", "and", "s", "total"]
COMPANY = ["limited", "ltd", "inc", "plc", "corporation", "corp", "company", "co"]
COMPONENTS = ["subject", "attribute", "period", "scope", "basis", "unit"]


def _words(text: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]+", " "), " +")


def _without(words: Column, gone: list[str]) -> Column:
    return F.filter(words, lambda w: (w != "") & ~w.isin(gone))


def phrase(text: Column) -> Column:
    """Lower-case words in their order, without punctuation and filler; null is empty."""
    return F.array_join(_without(_words(text), FILLER), " ")


def subject_key(text: Column) -> Column:
    return F.array_join(_without(_words(text), FILLER + COMPANY), " ")


def period_key(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull(), F.concat_ws("/", start.cast("string"), end.cast("string"))).otherwise("")


def claim(subject: Column, attribute: Column, start: Column, end: Column, scope: Column, basis: Column, unit: Column) -> Column:
    """The six components as a struct: what a component holds can't shift the others."""
    own = [subject_key(subject), phrase(attribute), period_key(start, end), phrase(scope), phrase(basis), F.coalesce(unit, F.lit(""))]
    return F.struct(*[c.alias(n) for c, n in zip(own, COMPONENTS, strict=True)])


def claim_key(c: Column) -> Column:
    return F.concat_ws("|", *[c[n] for n in COMPONENTS])


def loose_key(subject: Column, attribute: Column) -> Column:
    return F.concat(subject_key(subject), F.lit("|"), phrase(attribute))


def differing(a: Column, b: Column) -> Column:
    """Names of the components that differ, in their order."""
    return F.filter(F.array(*[F.when(a[n] != b[n], n) for n in COMPONENTS]), lambda x: x.isNotNull())
