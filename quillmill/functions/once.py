"""Expressions worked out once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(f: Callable[..., Column], *cols: Column) -> Column:
    """``f`` of the columns, each worked out once a row however often ``f`` names it, in lambdas too."""
    held = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)])
    return F.element_at(F.transform(F.array(held), lambda h: f(*[h.getField(f"c{i}") for i in range(len(cols))])), 1)
