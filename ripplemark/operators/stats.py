"""Outcome statistics: first failing reason, rolled-up buckets, unique values, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails the row (its predicate is true), null where none does; a null predicate is no failure."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, fails in checks:
        out = out.when(F.coalesce(fails, F.lit(False)), F.lit(name))
    return out


def outcome_buckets(df: DataFrame, outcome: str, kind: str, parents: dict[str, list[str]]) -> DataFrame:
    """``(bucket, kind, n)``: how many rows of each kind each bucket has, and with a null kind how many in all.

    An outcome counts in its own bucket and in those of ``parents``. Counts are taken before the parents are
    looked up, so the table is aggregated once, map-side first, and the rest is a few rows.
    """
    counts = df.groupBy(F.col(outcome).alias("o"), F.coalesce(F.col(kind), F.lit("Unknown")).alias("kind")).agg(F.count("*").alias("n"))
    into = F.create_map(*[x for o, ps in parents.items() for x in (F.lit(o), F.array(*[F.lit(p) for p in ps]))])
    spread = counts.select(F.explode(F.concat(F.array("o"), F.coalesce(F.try_element_at(into, F.col("o")), F.array().cast("array<string>")))).alias("bucket"), "kind", "n")
    return spread.rollup("bucket", "kind").agg(F.sum("n").alias("n")).where("bucket is not null").select("bucket", F.col("kind").alias(kind), "n")


def unique_values(df: DataFrame, key: str, value: str, n: str, only: str) -> DataFrame:
    """``(key, n, only)``: how many distinct values a key has, and the value where it is the only one."""
    return df.groupBy(key).agg(F.count_distinct(value).alias(n), F.min(value).alias("least")).select(key, n, F.when(F.col(n) == 1, F.col("least")).alias(only))


def summary(df: DataFrame, column: str) -> Column:
    """A one-row table's column ``k:n, k:n`` sorted by name."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit("null")).alias("k")).agg(F.count("*").alias("n"))
    return counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: F.concat(x["k"], F.lit(":"), x["n"].cast("string"))), ", ").alias("summary"))


def union_distinct(parts: list[tuple[DataFrame, str]], alias: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The distinct ids of several tables; nulls and ids outside ``low < id < high`` are left out before the shuffle."""
    out = None
    for df, column in parts:
        c = F.col(column).cast("bigint")
        ids = df.select(c.alias(alias)).where(c.isNotNull())
        if low is not None:
            ids = ids.where(F.col(alias) > low)
        if high is not None:
            ids = ids.where(F.col(alias) < high)
        ids = ids.distinct()
        out = ids if out is None else out.unionByName(ids)
    return out.distinct()
