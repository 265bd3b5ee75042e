"""Binding within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once and standing in the plan once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))
