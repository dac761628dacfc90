"""Exact top-k neighbours of query vectors by multi-resolution segment statistics.

A vector is cut into segments; with segment means m, deviations s and length l, the squared distance of two vectors is at
least the sum over segments of l * ((m1 - m2)**2 + (s1 - s2)**2). That bound is itself a squared distance between vectors
of 2 numbers a segment, so a whole block of bounds is one matrix product. Bounds go coarse to fine: pairs whose
bound at one resolution exceeds the query's k-th best distance so far drop out, and only survivors get an exact distance. The finest
resolution has a segment for each element: its bound is the distance itself in single precision, less its rounding error. A resolution
that is found not to prune (``WORTH``) is passed over.

Rows are gathered by likeness (nearest of at most ``PIVOTS`` pivots in the space of the statistics) into blocks of about ``BLOCK`` rows, which
are written once to the shared folder, with their centre and radius in that space. A task owns a block of queries (or, where there are fewer of these than
cores, a share of their candidates). It takes the blocks from the nearest on, skips those whose centre is too far for every query, reads
one at a time and keeps only the best k of each query, so its memory doesn't grow with the table, and no vector is shuffled more than once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, scratch_path
from .warc import _open

K = 10
BLOCK, QUERY_BLOCK = 4096, 4096
#: Segments at each resolution, coarse to fine.
LEVELS = (4, 16)
#: Rows that the pivots are fitted on; they only decide which rows share a block.
SAMPLE, PIVOTS = 8192, 256
#: A resolution that leaves more than this share of the pairs, of the first PROBE pairs, isn't used any longer.
WORTH, PROBE = 0.8, 1 << 20
_ROWS = 256
_PAIRS = 1 << 15
#: A share of surviving pairs above which the next level is computed for all pairs of a block of rows.
_MANY = 0.002


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of weighted segment means and deviations whose squared distances bound those of the rows of ``x``."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    lens = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / lens
    square = np.add.reduceat((x - np.repeat(mean, lens, axis=1)) ** 2, edges[:-1], axis=1) / lens
    return np.concatenate((mean * np.sqrt(lens), np.sqrt(square * lens)), axis=1)


class Best:
    """The k best candidates so far of each query of a block, by distance, then id."""

    def __init__(self, n: int, k: int, kind: type = np.int64):
        self.k = k
        self.d = np.full((n, k), np.inf)
        self.id = np.full((n, k), "" if kind is object else np.iinfo(np.int64).max, kind)

    def add(self, i: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(i)
        at = np.concatenate((np.repeat(rows, self.k), i))
        dist = np.concatenate((self.d[rows].ravel(), d))
        who = np.concatenate((self.id[rows].ravel(), ids))
        order = np.lexsort((np.unique(who, return_inverse=True)[1] if who.dtype == object else who, dist, at))
        at = at[order]
        first = np.concatenate(([True], at[1:] != at[:-1]))
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        keep = rank < self.k
        self.d[at[keep], rank[keep]] = dist[order][keep]
        self.id[at[keep], rank[keep]] = who[order][keep]


class Rows:
    """A block of vectors with their ids, and what bounds need of them: for each resolution (0: every element) the numbers in
    single precision and their squared norms, less the share that rounding can add to a product of them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, segments: int) -> tuple[np.ndarray, np.ndarray]:
        if segments not in self.known:
            y = statistics(self.x, segments) if segments else self.x
            share = 1 - 4e-7 * (y.shape[1] + 8)
            self.known[segments] = y.astype(np.float32), (share * (y**2).sum(1)).astype(np.float32)
        return self.known[segments]


def bounds(q: Rows, c: Rows, segments: int, rows: slice) -> np.ndarray:
    """Lower bounds of the squared distances of some queries to all candidates; what overflows is NaN and bounds nothing."""
    (x, x2), (y, y2) = q.at(segments), c.at(segments)
    out = x[rows] @ y.T
    out *= -2
    out += y2
    out += x2[rows, None]
    return out


class Pruning:
    """How many pairs each resolution got and left, and how many got an exact distance."""

    def __init__(self, levels: tuple[int, ...] = LEVELS):
        self.levels = levels
        self.got, self.left = [0] * (len(levels) + 1), [0] * (len(levels) + 1)
        self.pairs = self.exact = self.blocks = self.skipped = 0

    def useful(self, n: int) -> bool:
        return self.got[n] < PROBE or self.left[n] <= WORTH * self.got[n]

    def note(self, n: int, got: int, left: int) -> None:
        self.got[n] += got
        self.left[n] += left


def search(q: Rows, c: Rows, best: Best, seen: Pruning, least: np.ndarray | None = None) -> None:
    """Let the candidates compete for each query. A candidate with the query's own id is none.

    ``least``: for each query a lower bound of its squared distance to any of these candidates.
    """
    there = set(c.ids) if c.ids.dtype == object else ()
    share = np.array([i in there for i in q.ids], bool) if there else np.isin(q.ids, c.ids)
    with np.errstate(over="ignore", invalid="ignore"):
        for s in range(0, len(q.x), _ROWS):
            part = slice(s, min(s + _ROWS, len(q.x)))
            limit = best.d[part, -1:]
            if least is not None and (least[part, None] > limit).all():
                continue
            left = np.ones((part.stop - s, len(c.x)), bool)
            for i in np.flatnonzero(share[part]):
                left[i] = c.ids != q.ids[s + i]
            seen.pairs += left.size
            if np.isfinite(limit).all():
                for n, m in enumerate(seen.levels):
                    if (many := int(left.sum())) > left.size * _MANY and seen.useful(n):
                        left &= ~(bounds(q, c, m, part) > limit)
                        seen.note(n, many, int(left.sum()))
            if (many := int(left.sum())) > left.size * _MANY:
                near = bounds(q, c, 0, part)
                left &= ~(near > limit)
                if left.sum() > 4 * best.k * len(left) and near.shape[1] > best.k:
                    # The k closest of these rows first, so that the others meet the final thresholds.
                    near[~left] = np.inf
                    i = np.repeat(np.arange(len(near)), best.k)
                    j = np.argpartition(np.nan_to_num(near, nan=0.0), best.k - 1, axis=1)[:, : best.k].ravel()
                    fine = left[i, j]
                    i, j = i[fine], j[fine]
                    best.add(i + s, ((q.x[i + s] - c.x[j]) ** 2).sum(1), c.ids[j])
                    seen.exact += len(i)
                    left[i, j] = False
                    left &= ~(near > best.d[part, -1:])
                seen.note(len(seen.levels), many, int(left.sum()))
            i, j = np.nonzero(left)
            i = i + s
            for p in range(0, len(i), _PAIRS):
                x, y = i[p : p + _PAIRS], j[p : p + _PAIRS]
                d = ((q.x[x] - c.x[y]) ** 2).sum(1)
                seen.exact += len(x)
                near = d <= best.d[x, -1]
                if near.any():
                    best.add(x[near], d[near], c.ids[y[near]])


def fit_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` centres of the rows of ``x`` (a few rounds of Lloyd's algorithm)."""
    centres = x[np.random.default_rng(0).permutation(len(x))[:n]]
    for _ in range(4):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.argmin(np.nan_to_num((centres**2).sum(1) - 2 * x @ centres.T, nan=np.inf), axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _ids(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), object) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)


def _write_blocks(rows: DataFrame, pivots: np.ndarray, size: int, path: str) -> int:
    """Write ``rows(id, v)`` as ``path/block=N`` and return the number of blocks. A pivot's rows lie in neighbouring blocks; they
    are dealt out in turn, so a vector that is repeated often fills many blocks like any other."""
    level = LEVELS[-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pivots), np.int64)
        for batch in batches:
            total += np.bincount(nearest(statistics(_matrix(batch["v"]), level), pivots), minlength=len(pivots)) if len(batch) else 0
        yield pa.record_batch([pa.array(np.arange(len(pivots))), pa.array(total)], names=["cell", "n"])

    counts = rows.select("v").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = {r["cell"]: r["n"] for r in counts.collect()}  # PIVOTS rows
    ends = np.cumsum([counts.get(i, 0) for i in range(len(pivots))])
    low = np.concatenate(([0], ends[:-1])) // size
    width = np.maximum((ends - 1) // size - low, 0) + 1
    blocks = int(-(-ends[-1] // size)) if len(ends) else 0
    if not blocks:
        return 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = None
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["v"])
            cell = nearest(statistics(x, level), pivots)
            if turn is None:  # tasks begin at different blocks, and a repeated task where it began before
                turn = np.full(len(pivots), int(np.abs(np.frombuffer(x[0].tobytes(), np.uint32).astype(np.int64)).sum()) % (1 << 31), np.int64)
            order = np.argsort(cell, kind="stable")
            rank = np.empty(len(cell), np.int64)
            n = np.bincount(cell, minlength=len(pivots))
            rank[order] = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
            block = low[cell] + (turn[cell] + rank) % width[cell]
            turn += n
            yield pa.record_batch([pa.array(block.astype(np.int32)), batch["id"], batch["v"]], names=["block", "id", "v"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "v"))
    placed = rows.select("id", "v").mapInArrow(deal, f"block int, {kinds}")
    placed.repartition(min(blocks, 10_000), "block").sortWithinPartitions("block", "id").write.partitionBy("block").parquet(path)
    return blocks


def _read_block(path: str, number: int) -> Rows | None:
    fs, base = _open(f"{path}/block={number}")
    if fs.get_file_info(base).type == pyarrow.fs.FileType.NotFound:
        return None
    files = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(base)) if f.path.endswith(".parquet"))
    parts = [pyarrow.parquet.ParquetFile(fs.open_input_file(f)).read(columns=["id", "v"]) for f in files]
    if not parts:
        return None
    table = pa.concat_tables(parts).combine_chunks()
    ids, v = (table[c].chunk(0) if table[c].num_chunks else pa.array([], table[c].type) for c in ("id", "v"))
    return Rows(_ids(ids), _matrix(v)) if len(ids) else None


def _summaries(spark, path: str, blocks: int) -> DataFrame:
    """``(block, centre, radius)`` of each block, in the space of the finest statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch["id"].to_pylist():
                if rows := _read_block(path, number):
                    y = statistics(rows.x, LEVELS[-1])
                    centre = y.mean(axis=0)
                    radius = float(np.sqrt(((y - centre) ** 2).sum(1)).max())
                    yield pa.record_batch([pa.array([number], pa.int32()), pa.array([centre], pa.list_(pa.float64())), pa.array([radius])], names=["block", "centre", "radius"])

    return spark.range(0, blocks, 1, min(blocks, 10_000)).mapInArrow(run, "block int, centre array<double>, radius double")


class Blocks:
    """The candidates' blocks as a task sees them: 34 numbers for each, and the rows when asked for."""

    def __init__(self, path: str, summaries: str):
        fs, base = _open(summaries)
        files = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(base)) if f.path.endswith(".parquet"))
        table = pa.concat_tables([pyarrow.parquet.ParquetFile(fs.open_input_file(f)).read() for f in files]).sort_by("block").combine_chunks()
        self.path, self.number = path, table["block"].to_numpy()
        self.centre, self.radius = _matrix(table["centre"].chunk(0)), table["radius"].to_numpy()

    def least(self, y: np.ndarray, which: slice | list[int]) -> np.ndarray:
        """Lower bounds of the squared distances of queries (their statistics ``y``) to the rows of some blocks."""
        c = self.centre[which]
        with np.errstate(over="ignore", invalid="ignore"):
            square = (y**2).sum(1)[:, None] + (c**2).sum(1) - 2 * y @ c.T
            slack = 1e-9 * ((y**2).sum(1)[:, None] + (c**2).sum(1))
            gap = np.sqrt(np.maximum(square - slack, 0)) - self.radius[which] * (1 + 1e-9)
            return np.nan_to_num(np.maximum(gap, 0) ** 2 * (1 - 1e-9), nan=0.0)


def answer(q: Rows, blocks: Blocks, k: int, share: int, shares: int, seen: Pruning) -> Best:
    """The best of every ``shares``-th block, the nearest block first."""
    y = statistics(q.x, LEVELS[-1])
    near = np.concatenate([blocks.least(y, slice(s, s + 512)).min(axis=0) for s in range(0, len(blocks.number), 512)])
    best = Best(len(q.x), k, object if q.ids.dtype == object else np.int64)
    for b in np.argsort(near, kind="stable")[share::shares].tolist():
        least = blocks.least(y, [b])[:, 0]
        seen.blocks += 1
        if (least > best.d[:, -1]).all():
            seen.skipped += 1
        elif c := _read_block(blocks.path, int(blocks.number[b])):
            search(q, c, best, seen, least)
    return best


def top_k(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", dim: int | None = None, block: int = BLOCK, queries: DataFrame | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(<id>, neighbor_id, rank, distance)``: the k nearest rows of ``vectors`` of each row of ``queries`` (by default of every row), Euclidean, exact.

    A row with the query's own id is not its neighbour. Ties go by the lesser id. Null ids, null vectors, vectors with a null, NaN or infinite element and
    vectors of another length than ``dim`` (by default the most frequent one of ``vectors``) neither search nor are found.
    Queries that are alike are answered each, rows that repeat an id are found each. With fewer than k others, all are
    given; an empty table gives an empty result. Other columns aren't read. Ids that aren't whole numbers come and compare as text.
    """
    spark = vectors.sparkSession
    whole = isinstance(vectors.schema[id_col].dataType, T.IntegralType)
    kind = "bigint" if whole else "string"
    element = vectors.schema[vec_col].dataType.elementType
    inner = "float" if isinstance(element, T.FloatType) else "double"

    def clean(df: DataFrame) -> DataFrame:
        v = df[vec_col].cast(f"array<{inner}>")
        rows = df.select(df[id_col].cast(kind).alias("id"), v.alias("v"))
        return rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    rows = clean(vectors)
    if dim is None:
        dim = rows.agg(F.mode(F.size("v"), True)).first()[0] or 1
    rows = rows.where(F.size("v") == dim)
    asked = rows if queries is None else clean(queries).where(F.size("v") == dim)
    sample = rows.select("v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE).toArrow()["v"].combine_chunks()
    x = statistics(_matrix(sample), LEVELS[-1]) if len(sample) else np.zeros((0, 1))
    path = scratch_path(spark, "topk")
    schema = f"block int, place int, id {kind}, neighbor_id {kind}, d double"
    pivots = fit_pivots(x, PIVOTS) if len(x) else x
    n_blocks = _write_blocks(rows, pivots, block, f"{path}/rows") if len(x) else 0
    n_queries = _write_blocks(asked, pivots, query_block, f"{path}/queries") if n_blocks else 0
    if not n_queries:
        found, shares = spark.createDataFrame([], schema), 1
    else:
        materialized = f"{path}/blocks"
        _summaries(spark, f"{path}/rows", n_blocks).write.parquet(materialized)
        shares = max(1, min(n_blocks, math.ceil(2 * spark.sparkContext.defaultParallelism / n_queries)))
        tasks = n_queries * shares

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = Blocks(f"{path}/rows", materialized)
            for batch in batches:
                for number in batch["id"].to_pylist():
                    at, share = divmod(number, shares)
                    if q := _read_block(f"{path}/queries", at):
                        best = answer(q, blocks, k, share, shares, Pruning())
                        i, r = np.nonzero(np.isfinite(best.d))
                        text = (lambda a: pa.array(a, pa.string())) if q.ids.dtype == object else pa.array
                        yield pa.record_batch([pa.array(np.full(len(i), at, np.int32)), pa.array(i.astype(np.int32)), text(q.ids[i]), text(best.id[i, r]), pa.array(best.d[i, r])], names=["block", "place", "id", "neighbor_id", "d"])

        found = spark.range(0, tasks, 1, min(tasks, 10_000)).mapInArrow(run, schema)
    if shares > 1:
        found = materialize(found, "partial")
    # A query's partial answers are at most k from each share.
    one = F.struct("d", F.col("neighbor_id").alias("n"))
    best = found.groupBy("block", "place").agg(F.first("id").alias("id"), F.slice(F.sort_array(F.collect_list(one)), 1, k).alias("best"))
    ranked = best.select(F.col("id").alias(id_col), F.posexplode("best").alias("rank", "b"))
    return ranked.select(id_col, F.col("b.n").alias("neighbor_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.sqrt("b.d").alias("distance"))
