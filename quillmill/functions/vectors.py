"""Arithmetic on vector columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; null if either is all zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_unit(v: Column, eps: float = 1e-12, floor: bool = True) -> Column:
    """Vector over its length. ``floor``: length is at least eps; else eps only stands in for zero."""
    n = norm(v)
    n = F.greatest(n, F.lit(eps)) if floor else F.when(n == 0, F.lit(eps)).otherwise(n)
    return F.transform(v, lambda x: x / n)


def fit_dims(v: Column, dims: int) -> Column:
    """Padded with zeros or cut to ``dims``; a missing vector becomes all zero."""
    zeros = F.array_repeat(F.lit(0.0), dims)
    return F.slice(F.concat(F.coalesce(v, zeros), zeros), 1, dims)
