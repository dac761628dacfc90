"""First-wins and last-wins deduplication, and choices by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import fresh


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One whole row for each key: the first by ``order`` (a total order makes the result the same at every run).

    Rank filters of 1 are pushed below the shuffle, so a hot key sends one row a task. Null keys are one key.
    """
    (n,) = fresh(df, "n")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(n, rank).where(F.col(n) == 1).drop(n)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row for each key: the last by ``order``."""
    return first_wins(df, keys, [F.col(c).desc_nulls_last() for c in order])


def priority_pick(df: DataFrame, key: str, kind: str, priorities: list[str], value: str, ties: list[str], alias: str) -> DataFrame:
    """``(key, kind, alias)``: each key's value of the kind that comes first in ``priorities``; ties go by ``ties``, then value.

    Rows of a kind that isn't listed don't count; keys without any other have no row. One aggregation with map-side combine.
    """
    place = F.array_position(F.array(*[F.lit(p) for p in priorities]), F.col(kind))
    best = F.min(F.struct(place.alias("place"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)], F.col(value).alias("value"), F.col(kind).alias("kind")))
    out = df.where(place > 0).groupBy(key).agg(best.alias("best"))
    return out.select(key, F.col("best.kind").alias(kind), F.col("best.value").alias(alias))
