"""Ordinals, positional zips, slices between offsets and carried-forward states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import fresh

SPLITS = 64
#: Rows whose keys tell where the parts of a table end; they only balance the parts.
SAMPLE = 10_000


def positions(df: DataFrame, order: list[str], alias: str, splits: int = SPLITS) -> DataFrame:
    """``df`` with each row's place from 1 in the total order of the columns ``order``.

    Rows are parted by whole keys, at ``splits`` places of a bounded sample, so a frequent value of the first column is parted by the next
    ones; they are ranked within their part and shifted by the sizes of the parts before: no single task sorts the table. Nulls come first.
    """
    kinds = [df.schema[c].dataType for c in order]
    keys = df.select(*order).orderBy(F.xxhash64(*order)).limit(SAMPLE).collect()
    one = lambda v: F.struct(*[F.lit(x).cast(k).alias(f"k{i}") for i, (x, k) in enumerate(zip(v, kinds))])
    least = lambda r: tuple((x is not None, x) for x in r)
    keys = sorted({tuple(r) for r in keys}, key=least)
    cuts = [keys[len(keys) * i // splits] for i in range(1, splits)] if len(keys) > splits else keys[1:]
    part, n, before = fresh(df, "part", "n", "before")
    firsts = [c[0] for c in cuts]
    if not cuts:
        place = F.lit(0)
    elif None not in firsts and len(set(firsts)) == len(firsts):
        # No value of the first column spans parts: it alone is compared.
        lead = F.array(*[F.lit(v).cast(kinds[0]) for v in firsts])
        place = F.coalesce(F.size(F.filter(lead, lambda c: c <= F.col(order[0]))), F.lit(0))
    else:
        own = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
        place = F.size(F.filter(F.array(*[one(c) for c in cuts]), lambda c: c <= own))
    parted = df.withColumn(part, place)
    # At most ``splits`` rows: a global window over them is one small task.
    sizes = parted.groupBy(part).agg(F.count("*").alias(n))
    sizes = sizes.select(part, (F.sum(n).over(Window.orderBy(part)) - F.col(n)).alias(before))
    rank = F.row_number().over(Window.partitionBy(part).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    ranked = parted.withColumn(n, rank).join(F.broadcast(sizes), part)
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(n) + F.col(before)).cast("bigint").alias(alias))


def positional_zip(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """The first left row with the first right row, the second with the second ...; left rows without a partner have nulls."""
    (pos,) = fresh(left.limit(0).crossJoin(right.limit(0)), "pos")
    return positions(left, left_order, pos).join(positions(right, right_order, pos), pos, "left").withColumnRenamed(pos, "position")


def slices(offsets: DataFrame, key: str, offset: str, total: str, start: str = "start", end: str = "end") -> DataFrame:
    """Each offset's slice: it ends at the key's next offset, the last one at ``total``."""
    w = Window.partitionBy(key).orderBy(offset)
    return offsets.select(key, F.col(offset).alias(start), F.coalesce(F.lead(offset).over(w), F.col(total)).alias(end))


def carry_forward(df: DataFrame, by: list[str], order: list[str], value: str, alias: str) -> DataFrame:
    """``df`` with the last value that is not null up to and with the row, in the order of its keys' rows."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(alias, F.last(value, ignorenulls=True).over(w))
