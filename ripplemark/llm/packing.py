"""Best-fit packing of token sequences into bins of a fixed capacity by a configuration linear program.

Documents are cut at the capacity; lengths are rounded up to ``capacity // UNITS`` tokens, so the histogram has
at most ``UNITS`` classes whatever the corpus. A configuration is a multiset of classes that fits a bin; the
linear program covers each class's count with the fewest bins. Multiplicative weights solve it: a class's price is its size times a
weight that falls with its coverage, and an unbounded-knapsack dynamic program finds the configuration of the highest price, for
``PRICINGS`` slightly different price lists at once, so that ties are broken in many ways.
Each configuration's bins are rounded down; what is left over is packed best fit, longest first, into the room that those bins have and
then into new ones. The same best fit without the program's bins is tried too, and the plan with fewer bins is taken.

Only the histogram reaches the driver. Pieces then find their bin from their rank within their class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, word_count

CAPACITY = 2048
UNITS = 256
#: Coverage that a class may gain in one step, how fast its price falls with it, and the price lists of a step with their spread.
DELTA, ETA, PRICINGS, SPREAD = 0.05, 10.0, 16, 0.05
#: Rows of one class that one task ranks, about.
RANKED_ROWS = 200_000


def knapsacks(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """For each row of ``prices``: copies of each size (ascending) that have the highest total price and fit the capacity."""
    lists, at = len(prices), np.arange(len(prices))
    by_size = np.ascontiguousarray(prices.T)
    best = np.zeros((capacity + 1, lists))
    pick = np.full((capacity + 1, lists), -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            value = best[c - sizes[:k]] + by_size[:k]
            i = value.argmax(axis=0)
            better = value[i, at] > best[c]
            best[c] = np.where(better, value[i, at], best[c])
            pick[c] = np.where(better, i, -1)
    copies = np.zeros((lists, len(sizes)), np.int64)
    room = np.full(lists, capacity)
    while (room > 0).any():
        chosen = np.where(room > 0, pick[room, at], -1)
        hit = chosen >= 0
        copies[at[hit], chosen[hit]] += 1
        room = np.where(hit, room - sizes[np.maximum(chosen, 0)], np.maximum(room - 1, 0))
    return copies


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each size (ascending) that have the highest total price and fit the capacity."""
    return knapsacks(sizes, prices[None], capacity)[0]


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, delta: float = DELTA, whole: bool = True) -> list[tuple[np.ndarray, float]]:
    """Configurations and how many bins of each, fractional; they cover each count exactly.

    Without ``whole`` it stops where the first class is covered: from there on configurations lack partners, and best fit does better.
    """
    rng = np.random.default_rng(0)
    covered, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    found: dict[bytes, list] = {}
    while open_.any():
        at = np.flatnonzero(open_)
        price = sizes[at] / capacity * np.exp(-ETA * (covered[at] - covered[at].min()))
        lists = price * np.exp(SPREAD * rng.standard_normal((PRICINGS, len(at))))
        lists[0] = price
        allowed = np.minimum(covered[at] + delta, 1)
        for copies in knapsacks(sizes[at], lists, capacity):
            copies = np.minimum(copies, counts[at])
            used = copies > 0
            step = float((counts[at][used] / copies[used] * (allowed - covered[at])[used]).min())
            if step > 0:
                covered[at] += copies * step / counts[at]
                full = np.zeros(len(sizes), np.int64)
                full[at] = copies
                found.setdefault(full.tobytes(), [full, 0.0])[1] += step
        open_ = covered < 1 - 1e-9
        if not whole and not open_.all():
            break
    return [(c, x) for c, x in found.values()]


class Layout:
    """Bins as groups of alike ones, and for each size the segments ``(first rank, first bin, copies a bin, first slot)``."""

    def __init__(self, sizes: list[int], capacity: int):
        self.capacity, self.bins = capacity, 0
        self.segments: dict[int, list[tuple[int, int, int, int]]] = {s: [] for s in sizes}
        self.rank = dict.fromkeys(sizes, 0)
        self.rooms: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, size: int, first: int, bins: int, copies: int, slot: int) -> None:
        self.segments[size].append((self.rank[size], first, copies, slot))
        self.rank[size] += bins * copies

    def configuration(self, copies: dict[int, int], bins: int) -> None:
        slot, room = 0, self.capacity
        for size, n in copies.items():
            self.put(size, self.bins, bins, n, slot)
            slot, room = slot + n, room - n * size
        self.rooms[room].append((self.bins, bins, slot))
        self.bins += bins

    def best_fit(self, size: int, n: int) -> None:
        """``n`` pieces one after another, each into the fullest bin that has room, else a new one."""
        room = size
        while n:
            while room <= self.capacity and not self.rooms[room]:
                room += 1
            if room > self.capacity:
                room = self.capacity
                fresh = -(-n // (room // size))
                self.rooms[room].append((self.bins, fresh, 0))
                self.bins += fresh
            first, bins, slot = self.rooms[room].pop()
            each = room // size
            if full := min(bins, n // each):
                self.put(size, first, full, each, slot)
                self.rooms[room - each * size].append((first, full, slot + each))
                first, bins, n = first + full, bins - full, n - full * each
            if bins and 0 < n < each:
                self.put(size, first, 1, n, slot)
                self.rooms[room - n * size].append((first, 1, slot + n))
                first, bins, n = first + 1, bins - 1, 0
            if bins:
                self.rooms[room].append((first, bins, slot))


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Layout:
    out = Layout(sorted(histogram), capacity)
    for s in sorted(histogram, reverse=True):
        out.best_fit(s, histogram[s])
    return out


def plan(histogram: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each size the segments ``(first rank, first bin, copies a bin, first slot)``, and the number of bins."""
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    out = Layout(sizes.tolist(), capacity)
    for copies, x in sorted(solve(sizes, left.copy(), capacity, whole=False), key=lambda f: -f[1]):
        used = np.flatnonzero(copies)
        bins = min(int(x + 1e-9), int((left[used] // copies[used]).min()))
        if bins:
            out.configuration({int(sizes[i]): int(copies[i]) for i in used[::-1]}, bins)
            left -= bins * copies
    for s, n in zip(sizes[::-1].tolist(), left[::-1].tolist()):
        out.best_fit(s, n)
    plain = best_fit_decreasing(histogram, capacity)
    out = out if out.bins <= plain.bins else plain
    return out.segments, out.bins


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: ``(bin_id, slot, <id>, piece, start, n_tokens)``.

    Lengths are words of the text. A document longer than the capacity has several pieces, all but the last
    of them full (any capacity of 1 or more is kept as given); ``start`` is the piece's first word. Pieces of a bin are ordered by ``slot`` and fit the capacity.
    Null, empty and word-free texts have one row with ``n_tokens`` 0 and a null bin and slot. Repeated rows are
    packed each; null ids are packed like any other. Columns besides id and text aren't read. Empty in, empty out.
    """
    spark = docs.sparkSession
    grain = max(1, capacity // UNITS)
    room = capacity // grain
    sized = materialize(docs.select(docs[id_col].alias("id"), word_count(docs[text_col]).alias("n")), "lengths")
    many = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int")
    cut = sized.select("id", "n", F.explode(F.sequence(F.lit(0), many - 1)).alias("piece")).select(
        "id", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("bigint") * capacity).cast("int").alias("n")
    )
    empty = cut.where("n = 0").select(F.lit(None).cast("bigint").alias("bin_id"), F.lit(None).cast("int").alias("slot"), F.col("id").alias(id_col), "piece", "start", F.col("n").alias("n_tokens"))
    cut = cut.where("n > 0").withColumn("size", F.least(F.ceil(F.col("n") / grain), F.lit(room)).cast("int"))  # a piece of the last class has a bin to itself
    sums = {r["size"]: r["count"] for r in cut.groupBy("size").count().collect()}  # UNITS rows at most
    lots = max(1, math.ceil(max(sums.values(), default=0) / RANKED_ROWS))
    cut = cut.withColumn("lot", F.pmod(F.xxhash64("id", "piece"), F.lit(lots)).cast("int"))
    before = cut.groupBy("size", "lot").count().select("size", "lot", (F.sum("count").over(Window.partitionBy("size").orderBy("lot")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("size", "lot").orderBy("id", "piece", "n")) - 1
    ranked = cut.withColumn("own", own).join(before, ["size", "lot"]).select("id", "piece", "start", "n", "size", (F.col("before") + F.col("own")).alias("rank"))
    segments, _ = plan(sums, room)
    shared = spark.sparkContext.broadcast({s: np.array(rows, np.int64).reshape(-1, 4) for s, rows in segments.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch["size"].to_numpy(), batch["rank"].to_numpy()
            bins, slots = np.empty(len(size), np.int64), np.empty(len(size), np.int32)
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                seg = shared.value[int(s)]
                seg = seg[np.searchsorted(seg[:, 0], rank[own], "right") - 1]
                off = rank[own] - seg[:, 0]
                bins[own], slots[own] = seg[:, 1] + off // seg[:, 2], seg[:, 3] + off % seg[:, 2]
            yield pa.record_batch([pa.array(bins), pa.array(slots), batch["id"], batch["piece"], batch["start"], batch["n"]], names=["bin_id", "slot", "id", "piece", "start", "n_tokens"])

    kind = sized.schema["id"].dataType.simpleString()
    packed = ranked.mapInArrow(place, f"bin_id bigint, slot int, id {kind}, piece int, start bigint, n_tokens int")
    return packed.withColumnRenamed("id", id_col).unionByName(empty)
