"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

Rows of a group stay together wherever the group fits a shard: groups, largest first, go whole to the shard where the dot
product of their size and the residual capacity is highest, of the shards that have room for them. A group that no shard has room for (one
larger than a shard always is such a group) is cut by a hash of the id into parts of ``1 / PARTS`` of a shard, which are placed last, one by
one, by the same rule. Groups under ``1 / BUNDLED`` of a shard are bundled by a hash of the group, so the number
of items is bounded by the number of shards, whatever the number of groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, word_count

SHARDS = 64
PARTS = 8
BUNDLED = 64
#: How far over its even part a shard may be filled by whole groups, as a share of it.
TOLERANCE = 0.05
DIMS = ("bytes", "tokens", "rows")


def slots(shards: int) -> int:
    """Hash classes of ids within a group: a group that is the whole table still has ``PARTS`` parts for each shard."""
    return 1 << max(12, (2 * shards * PARTS - 1).bit_length())


def place(items: np.ndarray, shards: int, owners: np.ndarray | None = None, tolerance: float = TOLERANCE) -> np.ndarray:
    """The shard of each item (rows of sizes, one column a dimension), each placed where size . residual is highest.

    Sizes count in shares of a shard's even part of the total. Items of one of the ``owners`` (a group's parts) go to one shard together,
    owners with the greatest share in any dimension first, if one has room for all of them (up to ``tolerance``); those that nowhere
    fit whole follow, part by part, the largest first. Ties (to nine decimals) go by the order of the items, and to the lowest shard.
    """
    total = items.sum(axis=0)
    share = items / np.where(total > 0, total, 1) * shards
    residual = np.ones((shards, items.shape[1]))
    out = np.full(len(items), -1, np.int64)
    if owners is not None and len(items):
        _, first, owner = np.unique(owners, return_index=True, return_inverse=True)
        whole = np.zeros((len(first), items.shape[1]))
        np.add.at(whole, owner, share)
        big = np.round(whole.max(axis=1), 9)
        members = np.split(np.argsort(owner, kind="stable"), np.cumsum(np.bincount(owner))[:-1])
        for g in np.lexsort((first, -big)):
            fit = np.flatnonzero((residual + tolerance >= whole[g]).all(axis=1)) if big[g] <= 1 + tolerance else ()
            if len(fit):
                at = fit[np.round(residual[fit] @ whole[g], 9).argmax()]
                out[members[g]] = at
                residual[at] -= whole[g]
    rest = np.flatnonzero(out < 0)
    for i in rest[np.argsort(-np.round(share[rest].max(axis=1, initial=0), 9), kind="stable")]:
        out[i] = int(np.round(residual @ share[i], 9).argmax())
        residual[out[i]] -= share[i]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """``(<id>, <group>, shard_id)`` for every row.

    A null text counts a row without bytes and tokens; a null group is a group of its own; rows that repeat
    an id within a group go to one shard, so a single id with more than a shard's rows leaves that shard the largest. An empty table gives an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    n_slots = slots(shards)
    slot = F.pmod(F.xxhash64(docs[id_col]), F.lit(n_slots)).cast("int")
    group = F.coalesce(docs[group_col].cast("string"), F.lit("\x00null"))
    size = F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)).cast("bigint")
    sized = docs.select(group.alias("g"), slot.alias("slot"), size.alias("bytes"), word_count(docs[text_col]).alias("tokens"))
    counted = materialize(sized.groupBy("g", "slot").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "slots")
    totals = counted.agg(*[F.sum(d).alias(f"all_{d}") for d in DIMS])
    by_group = Window.partitionBy("g")
    share = F.greatest(*[F.coalesce(F.sum(d).over(by_group) / F.nullif(F.col(f"all_{d}"), F.lit(0)), F.lit(0.0)) for d in DIMS]) * shards
    cut = F.least(F.lit(n_slots), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("share") * PARTS))))).cast("int")
    bundle = F.concat(F.lit("\x00bundle"), F.pmod(F.xxhash64("g"), F.lit(shards * BUNDLED)).cast("string"))
    small = F.col("share") < 1.0 / BUNDLED
    item = counted.crossJoin(F.broadcast(totals)).withColumn("share", share).select("g", "slot", *DIMS, F.when(small, bundle).otherwise(F.col("g")).alias("item"), F.when(small, 0).otherwise(F.col("slot") % cut).alias("part"))
    # At most about shards * (BUNDLED + 2 * PARTS) rows, ordered so that ties are broken alike at every run.
    items = item.groupBy("item", "part").agg(*[F.sum(d).alias(d) for d in DIMS]).orderBy("item", "part").toArrow()
    sizes = np.column_stack([items[d].to_numpy().astype(float) for d in DIMS]) if len(items) else np.zeros((0, 3))
    names = items["item"].to_pylist()
    number = {name: i for i, name in enumerate(dict.fromkeys(names))}
    chosen = place(sizes, shards, np.array([number[n] for n in names], np.int64), tolerance)
    placed = spark.createDataFrame([(a, b, int(s)) for a, b, s in zip(names, items["part"].to_pylist(), chosen)], "item string, part int, shard_id int")
    # One row per (group, slot): the join key of a hot group is spread over its slots.
    verdict = item.join(placed, ["item", "part"]).select("g", "slot", "shard_id")
    rows = docs.select(docs[id_col].alias("id"), docs[group_col].alias("grp"), group.alias("g"), slot.alias("slot"))
    return rows.join(verdict, ["g", "slot"]).select(F.col("id").alias(id_col), F.col("grp").alias(group_col), "shard_id")
