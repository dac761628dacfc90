"""Numbers over arrays, inside whole-stage code: no explode, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def smoothness(values: Column) -> Column:
    """The mean absolute difference of neighbours; null for fewer than two values."""
    steps = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values)), lambda a, b: F.abs(b.cast("double") - a.cast("double")))
    return F.when(F.size(values) > 1, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / (F.size(values) - 1))


def half_similarity(values: Column, same) -> Column:
    """The share of places at which the two halves of an array agree (``same`` of both); an odd middle is left out."""
    half = F.floor(F.size(values) / 2).cast("int")
    hits = F.zip_with(F.slice(values, 1, half), F.slice(values, half + 1, half), lambda a, b: same(a, b).cast("int"))
    return F.when(half > 0, F.aggregate(hits, F.lit(0), lambda s, x: s + x) / half)
