"""Ordered lookups: fallback chains, scored matching, merges and snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import fresh
from .dedup import first_wins


@dataclass(frozen=True)
class Step:
    """One attempt of a chain: ``table`` holds unique ``key``s; ``on`` is the expression of the base row to look up."""

    name: str
    table: DataFrame
    key: str
    value: str
    on: Column


def fallback_chain(base: DataFrame, steps: list[Step], alias: str, source: str, default: Column | None = None) -> DataFrame:
    """``base`` with the value of the first step that has one, and that step's name; order is data, not join order.

    Tables are deduplicated on their key (least value), so rows never multiply; a null key or value finds nothing.
    Nothing found: ``default`` (null) and the source ``none``.
    """
    out, names = base, fresh(base, *[f"v{i}" for i in range(len(steps))], *[f"k{i}" for i in range(len(steps))])
    values, keys = names[: len(steps)], names[len(steps) :]
    for s, v, k in zip(steps, values, keys):
        table = s.table.where(F.col(s.key).isNotNull()).groupBy(F.col(s.key).alias(k)).agg(F.min(s.value).alias(v))
        out = out.join(table, s.on == F.col(k), "left")
    found = F.coalesce(*[F.col(v) for v in values], *([default] if default is not None else []))
    by = F.when(F.lit(False), F.lit(None))
    for s, v in zip(steps, values):
        by = by.when(F.col(v).isNotNull(), F.lit(s.name))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], found.alias(alias), by.otherwise("none").alias(source))


def scored_match(pairs: DataFrame, key: str, candidate: str, score: Column, alias: str) -> DataFrame:
    """``(key, alias, score, n_candidates)``: each key's best candidate, null where the best score is shared.

    ``pairs`` has a row for each candidate of each key. A sole candidate is taken whatever its score.
    """
    w = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("candidate"))
    ranked = pairs.select(F.col(key).alias("key"), F.col(candidate).alias("candidate"), score.alias("score"))
    ranked = ranked.withColumns({"rank": F.row_number().over(w), "second": F.lead("score").over(w), "n": F.count("*").over(Window.partitionBy("key"))})
    sure = (F.col("n") == 1) | (F.col("score") > F.col("second"))
    return ranked.where("rank = 1").select(F.col("key").alias(key), F.when(sure, F.col("candidate")).alias(alias), "score", F.col("n").alias("n_candidates"))


def merge_with_defaults(left: DataFrame, right: DataFrame, key: str, columns: list[str], critical: tuple[str, ...] = ()) -> DataFrame:
    """Full merge on ``key``: a column is the left one's unless that is unset (null, '' or 0) or the column is critical.

    A critical column is the right one's where it is not null. Keys must be unique on each side; null keys match nothing.
    """
    kinds = dict(left.dtypes)
    l = left.select(F.col(key).alias("lk"), *[F.col(c).alias(f"l_{c}") for c in columns])
    r = right.select(F.col(key).alias("rk"), *[F.col(c).alias(f"r_{c}") for c in columns])
    both = l.join(r, F.col("lk") == F.col("rk"), "full_outer")

    def pick(c: str) -> Column:
        a, b = F.col(f"l_{c}"), F.col(f"r_{c}")
        if c in critical:
            return F.coalesce(b, a)
        unset = a.isNull() | (a == (F.lit("") if kinds[c] == "string" else F.lit(0)))
        return F.when(unset, F.coalesce(b, a)).otherwise(a)

    return both.select(F.coalesce("lk", "rk").alias(key), *[pick(c).alias(c) for c in columns])


def incremental_diff(current: DataFrame, previous: DataFrame, key: str, checksum: str) -> DataFrame:
    """``(key, status)``: new, unchanged, changed or removed, by comparing checksums of two runs' snapshots.

    Only keys and hashes move. Keys must be unique on each side; a null checksum equals a null checksum.
    """
    c = current.select(F.col(key).alias("ck"), F.col(checksum).alias("cv"), F.lit(True).alias("here"))
    p = previous.select(F.col(key).alias("pk"), F.col(checksum).alias("pv"), F.lit(True).alias("there"))
    both = c.join(p, F.col("ck") == F.col("pk"), "full_outer")
    status = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "removed").when(F.col("cv").eqNullSafe(F.col("pv")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("ck", "pk").alias(key), status.alias("status"))


def orphans(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """The rows whose key no owner has (null keys included)."""
    return rows.join(owners.select(F.col(key)).distinct(), key, "left_anti")


def enumerate_candidates(rows: DataFrame, key: list[str], candidates: DataFrame, order: list[str], accept: Column) -> DataFrame:
    """Each row with the first candidate, by ``order``, that ``accept`` holds for; rows without one are left out.

    ``candidates`` is a fixed small table (formats, alignments); the optimizer broadcasts it if its size allows.
    """
    return first_wins(rows.crossJoin(candidates).where(accept), key, [F.col(c) for c in order])
