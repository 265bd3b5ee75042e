"""Model answers as JSON: repair and salvage of what was cut off."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salvaged(text: str) -> list | None:
    """The whole objects of an array that was cut off: up to the last bracket that closed an element."""
    start = text.find("[")
    depth, inside, escaped, last = 0, False, False, -1
    for i in range(max(start, 0), len(text) if start >= 0 else 0):
        c = text[i]
        if inside:
            inside, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if depth == 1:
                last = i
    if last < 0:
        return None
    try:
        return json.loads(text[start : last + 1] + "]")
    except ValueError:
        return None


def repaired(text: str | None):
    """A model's JSON: fenced, bare, or its outer brackets, trailing commas dropped; else what can be salvaged; else None."""
    text = text or ""
    tries = re.findall(r"```(?:json)?\s*(.*?)```", text, re.S) + [text]
    for a, b in ("[]", "{}"):
        if 0 <= text.find(a) < text.rfind(b):
            tries.append(text[text.find(a) : text.rfind(b) + 1])
    for t in tries:
        for s in (t, re.sub(r",\s*([\]}])", r"\1", t)):
            try:
                return json.loads(s)
            except ValueError:
                pass
    return salvaged(text)


def parsed(answers: DataFrame, column: str = "answer") -> DataFrame:
    """answers with json, its answer as JSON text (null where nothing can be saved). Only what isn't JSON as it stands goes to Python."""
    good = F.coalesce(F.get_json_object(column, "$").isNotNull(), F.lit(False))
    own = answers.withColumn("json", F.when(good, F.col(column)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p["json"] = [None if (x := repaired(t)) is None else json.dumps(x, ensure_ascii=False) for t in p[column]]
            yield p

    bad = own.where("json IS NULL")
    return own.where("json IS NOT NULL").unionByName(bad.mapInPandas(run, bad.schema))


def facts_in(answer: Column) -> Column:
    """The facts of an answer: a list, or an object's list `facts`; each as JSON text."""
    return F.coalesce(F.from_json(answer, "array<string>"), F.from_json(F.get_json_object(answer, "$.facts"), "array<string>"))
