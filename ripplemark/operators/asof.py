"""Nearest-preceding lookups.

Both sides meet in one union, hashed on the keys and sorted by the position, so a lookup costs one shuffle and a
running window: no range join, and no pair of rows is ever formed. Where one key has many rows, positions are cut into slices: a task
gets a slice of a key, and what precedes a slice is carried into it from a table of a row for each key and slice.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import fresh

#: Rows of one key that one task sorts; a key with more is cut into slices.
HOT_ROWS = 2_000_000
SLICES = 512


def _cuts(rows: DataFrame, at: str, hot_rows: int) -> list[float]:
    """Positions between slices, fixed on the driver; none where no key is hot."""
    most = rows.groupBy(*[c for c in rows.columns if c != at]).count().agg(F.max("count")).first()[0] or 0
    if most <= hot_rows:
        return []
    n = min(SLICES, 4 * math.ceil(most / hot_rows))
    return sorted(set(rows.agg(F.percentile_approx(F.col(at).cast("double"), [i / n for i in range(1, n)], 10_000)).first()[0] or []))


def asof_preceding(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, alias: str, default_first: bool = False, allow_equal: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` with ``alias``: the ``value`` of the last ``right`` row of the same keys whose ``on`` is less.

    Of rows with equal ``on`` the greatest value is the last. ``allow_equal`` takes rows with an equal ``on`` too.
    Without a preceding row the result is null, or with ``default_first`` the value at the least ``on``. Null
    keys and positions match nothing (with ``default_first`` a null position takes the first). A null value is skipped.
    A key may have any number of rows (``hot_rows``: beyond which they are cut into slices; positions are then numbers or times).
    """
    row, side, at, found = fresh(left, "row", "side", "at", "found")
    keys = [f"k{i}" for i in range(len(by))]
    kind = right.schema[value].dataType
    here = left.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(by)], F.col(on).alias(at), F.lit(1 if allow_equal else 0).alias(side), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias(row), F.lit(None).cast(kind).alias(found))
    there = right.where(F.col(on).isNotNull() & F.col(value).isNotNull())
    for k in by:
        there = there.where(F.col(k).isNotNull())
    there = there.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(by)], F.col(on).alias(at), F.lit(0 if allow_equal else 1).alias(side), F.lit(None).cast(here.schema[row].dataType).alias(row), F.col(value).alias(found))
    both = here.unionByName(there)
    sliceable = isinstance(left.schema[on].dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType))
    cuts = _cuts(here.select(*keys, at).unionByName(there.select(*keys, at)).where(F.col(at).isNotNull()), at, hot_rows) if sliceable else []
    last = lambda w: F.last(found, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if not cuts:
        order = Window.partitionBy(*keys).orderBy(at, side, found)
        got = last(order)
        if default_first:
            got = F.coalesce(got, F.first(found, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        out = both.withColumn(found, got)
    else:
        part, before, first, most = fresh(left.limit(0).select(F.lit(1).alias(row)), "part", "before", "first", "most")
        place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(at).cast("double")))
        both = both.withColumn(part, F.coalesce(place, F.lit(-1)))
        ends = there.withColumn(part, place).groupBy(*keys, part).agg(F.max(F.struct(at, found))[found].alias(most), F.min(F.struct(at, found))[found].alias(first))
        # At most a row for each key and slice: a key's window is as long as there are slices.
        spots = both.select(*keys, part).distinct().join(ends, [*keys, part], "left")
        whole = Window.partitionBy(*keys).orderBy(part)
        spots = spots.withColumn(before, F.last(most, ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1)))
        spots = spots.withColumn(first, F.first(first, ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        got = last(Window.partitionBy(*keys, part).orderBy(at, side, found))
        # Rows with a null key meet no spot and match nothing.
        out = both.withColumn(found, got).join(spots.select(*keys, part, before, first), [*keys, part], "left")
        out = out.withColumn(found, F.coalesce(found, before, *([first] if default_first else [])))
    out = out.where(F.col(row).isNotNull())
    return out.select(*[F.col(row)[c].alias(c) for c in left.columns], F.col(found).alias(alias))
