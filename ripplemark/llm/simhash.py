"""SimHash near-duplicates by random bit sampling.

A text's fingerprint has ``BITS`` bits. Each distinct lower-case word votes on every bit with weight
min(length, 10) - 1 (1 at least), so long, rare words count more than particles; no corpus statistics are needed.

Search: each of several tables samples its own bit positions. Texts that agree on the sampled bits of a
table share a bucket; the number of bits follows the number of distinct fingerprints so that a bucket of
unrelated texts has about ``BUCKET`` members at any size of the corpus, and the number of tables follows the bits so
that even a pair at the greatest distance shares a bucket of some table with a chance of ``RECALL``. Buckets are counted before
any is gathered: one of over ``CAP`` gets additional bits of the same table, again and again until none is over the cap, so no task ever
holds more than a cap's rows of a bucket, whatever the data. Every pair within a bucket is then verified: the Hamming
distance of the whole fingerprints must be ``MAX_DISTANCE`` at most. Equal fingerprints are joined before the
search (distance 0, exact).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import fresh, materialize

BITS = 256
LONGS = BITS // 64
RECALL = 0.9
BUCKET = 512
CAP = 4096
MAX_DISTANCE = 46
SEED = 20_011
_WORD = re.compile(r"\w+")
_CHUNK = 1 << 13


def fingerprint(text: str | None) -> list[int] | None:
    """The four signed 64-bit parts of a text's fingerprint; None for null texts and texts without words."""
    words = set(_WORD.findall(text.lower())) if text else None
    if not words:
        return None
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    weight = np.fromiter(map(len, words), np.float32, len(words))
    weight = np.clip(weight, 2, 10) - 1
    votes = np.zeros(BITS, np.float32)
    for s in range(0, len(one), _CHUNK):
        votes += weight[s : s + _CHUNK] @ _spread(one[s : s + _CHUNK])
    # Half of the weight or more sets the bit; sums of small integers are exact in float32.
    return np.packbits(votes * 2 >= weight.sum(dtype=np.float64)).view(np.int64).tolist()


def _spread(one: np.ndarray) -> np.ndarray:
    """0/1 rows of BITS bits from 64-bit hashes (splitmix finalizer, a constant added for each part)."""
    parts = np.empty((len(one), LONGS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(LONGS):
            z = one + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            parts[:, k] = z ^ (z >> np.uint64(31))
    return np.unpackbits(parts.view(np.uint8), axis=1).astype(np.float32)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([fingerprint(t.as_py()) for t in batch], pa.list_(pa.int64()))


def fingerprints(docs: DataFrame, columns: list, text_col: str = "text") -> DataFrame:
    """The given columns of each document and its fingerprint as ``fp`` (null for null and word-free texts)."""
    return docs.select(*columns, _fingerprints(docs[text_col].cast("string")).alias("fp"))


def base_bits(n: int, bucket: int = BUCKET) -> int:
    """Sampled bits for ``n`` fingerprints: enough for ``bucket`` unrelated members a bucket."""
    return max(0, min(48, math.ceil(math.log2(max(1, n / bucket)))))


def table_count(bits: int, distance: int, recall: float = RECALL) -> int:
    """Tables that a pair at ``distance`` needs to agree on all ``bits`` sampled bits of one of them with that chance."""
    agree = (1 - distance / BITS) ** bits
    return 1 if agree >= recall else math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _orders(tables: int, seed: int) -> np.ndarray:
    """Each table's own order of all bit positions; its first bits are the base sample, the next the additional ones."""
    return np.array([np.random.default_rng([seed, t]).permutation(BITS) for t in range(tables)])


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1)


def _keyed(fps: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``(tab, bucket, id, fp)``: every fingerprint once for each table; ``bucket`` is a hash of the sampled bits."""
    orders = _orders(tables, seed)[:, :bits]
    place = 1 << np.arange(bits, dtype=np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), _CHUNK):
                part = batch.slice(s, _CHUNK)
                raw = np.frombuffer(part["fp"].flatten().to_numpy(zero_copy_only=False).tobytes(), np.int64).reshape(-1, LONGS)
                b = _bits(raw).astype(np.int64)
                keys = np.concatenate([b[:, orders[t]] @ place for t in range(tables)])
                number = np.repeat(np.arange(tables, dtype=np.int32), len(raw))
                packed = pa.array([raw[i].tobytes() for i in range(len(raw))], pa.binary())
                yield pa.record_batch(
                    [pa.array(number), pa.array(keys), pa.concat_arrays([part["id"]] * tables), pa.concat_arrays([packed] * tables)],
                    names=["tab", "bucket", "id", "fp"],
                )

    kind = fps.schema["id"].dataType.simpleString()
    return fps.select("id", "fp").mapInArrow(spread, f"tab int, bucket bigint, id {kind}, fp binary")


def _split(rows: DataFrame, used: int, more: int, tables: int, seed: int) -> DataFrame:
    """``(tab, bucket, id, fp)`` with the next ``more`` bits of each row's table, behind ``used`` ones, mixed into its bucket."""
    orders = _orders(tables, seed)[:, used : used + more]
    fresh_bits = np.random.default_rng([seed, used, more]).integers(-(2**63), 2**63, more, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch["fp"].to_pylist()), np.int64).reshape(-1, LONGS)
            one = np.take_along_axis(_bits(raw), orders[batch["tab"].to_numpy()], axis=1).astype(bool)
            mixed = np.bitwise_xor.reduce(np.where(one, fresh_bits, 0), axis=1)
            with np.errstate(over="ignore"):
                keys = (batch["bucket"].to_numpy() ^ mixed) * np.int64(-7046029254386353131) + np.int64(more)
            yield pa.record_batch([batch["tab"], pa.array(keys), batch["id"], batch["fp"]], names=["tab", "bucket", "id", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("tab", "bucket", "id", "fp").mapInArrow(run, f"tab int, bucket bigint, id {kind}, fp binary")


def _buckets(fps: DataFrame, bits: int, tables: int, cap: int, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """``(tab, bucket, id, fp)`` with no bucket over the cap, and the ``(id)`` of all rows whose buckets were split (None: no bucket was).

    Oversized buckets get more bits, twice as many in each round. Distinct fingerprints part at the latest when all bits are used, so
    the rounds end and no row is left out.
    """
    rows, used, more, done, hot = _keyed(fps, bits, tables, seed), bits, 2, None, None
    while True:
        sizes = rows.groupBy("tab", "bucket").count()
        over = materialize(sizes.where(F.col("count") > cap).select("tab", "bucket"), "oversized")
        if used >= BITS or over.isEmpty():
            return (rows if done is None else done.unionByName(rows)), hot
        # Oversized buckets are few (rows over the cap), so the optimizer can broadcast them where that is safe; hot ones are
        # split on the side of the rows.
        small = rows.join(over, ["tab", "bucket"], "left_anti")
        done = small if done is None else done.unionByName(small)
        more = min(more, BITS - used)
        rows = materialize(_split(rows.join(over, ["tab", "bucket"], "left_semi"), used, more, tables, seed), "split")
        hot = rows.select("id").distinct() if hot is None else hot
        used, more = used + more, 2 * more


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # Unsigned: for signed numbers bitwise_count counts the bits of the absolute value.
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int32)


def _pairs_in(raw: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the verified pairs (i < j) and their distances."""
    found = []
    for s in range(0, len(raw), 128):
        block = _distances(raw[s : s + 128, None, :], raw[None, s:, :])
        i, j = np.nonzero(block <= distance)
        up = j > i
        found.append((i[up] + s, j[up] + s, block[i[up], j[up]]))
    i, j, d = (np.concatenate(x) for x in zip(*found))
    return i, j, d


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each node's component root to the node: the pairs' components with the fewest edges."""
    root = np.arange(n)
    if not len(i):
        return []
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return [(int(r), k) for k, r in enumerate(root) if r != k]
        root = new


def _verified(fps: DataFrame, distance: int, tables: int, bits: int, cap: int, seed: int, forest: bool) -> tuple[DataFrame, DataFrame | None]:
    """The verified pairs of all buckets (with ``forest``, of each bucket only edges that span its components), and what ``_buckets`` tells of split ones."""
    buckets, hot = _buckets(fps, bits, tables, cap, seed)
    buckets = buckets.groupBy("tab", "bucket").agg(F.collect_list(F.struct("id", "fp")).alias("rows"))
    kind = fps.schema["id"].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, d = [], [], []
            for rows in batch["rows"]:
                own = rows.values.field("id")
                raw = np.frombuffer(b"".join(rows.values.field("fp").to_pylist()), np.int64).reshape(-1, LONGS)
                i, j, dist = _pairs_in(raw, distance)
                if forest:
                    i, j = np.array(_forest(len(raw), i, j), np.int64).reshape(-1, 2).T
                    dist = np.zeros(len(i), np.int32)
                a, b = own.take(pa.array(i)), own.take(pa.array(j))
                low = pc.less(a, b)
                u.append(pc.if_else(low, a, b))
                v.append(pc.if_else(low, b, a))
                d.append(dist)
            if u:
                yield pa.record_batch([pa.concat_arrays(u), pa.concat_arrays(v), pa.array(np.concatenate(d).astype(np.int32))], names=["u", "v", "distance"])

    return buckets.where(F.size("rows") > 1).select("rows").mapInArrow(verify, f"u {kind}, v {kind}, distance int").distinct(), hot


def identifier(docs: DataFrame, id_col: str):
    """The id as it is compared: whole numbers as bigint, anything else as text."""
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    return docs[id_col].cast("bigint" if whole else "string")


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE, recall: float = RECALL, bucket: int = BUCKET, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """``(a, b, distance)`` with a < b: pairs of ids whose fingerprints differ in ``distance`` bits at most.

    Every row is a query. Pairs of equal fingerprints are all found, the rest with the recall of the sampling
    (0.9 at the greatest distance, more below). Null ids, null texts and texts without words have no partner; rows that repeat
    an id count once (the least fingerprint); an empty table gives no pair; other columns aren't read. Ids that aren't whole numbers come and compare as text.
    """
    fps = fingerprints(docs, [identifier(docs, id_col).alias("doc")], text_col).where("doc is not null and fp is not null")
    fps = materialize(fps.groupBy("doc").agg(F.min("fp").alias("fp")), "fingerprints")
    alike = materialize(fps.groupBy("fp").agg(F.min("doc").alias("id")), "distinct")
    bits = base_bits(alike.count(), bucket)
    found, _ = _verified(alike.select("id", "fp"), distance, table_count(bits, distance, recall), bits, cap, seed, forest=False)
    of = fps.join(alike, "fp").select("doc", "id")
    zero = alike.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0).alias("distance"))
    pairs = found.unionByName(zero).join(of.select(F.col("doc").alias("x"), F.col("id").alias("u")), "u").join(of.select(F.col("doc").alias("y"), F.col("id").alias("v")), "v")
    return pairs.where("u <> v or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance").distinct()


def components(alike: DataFrame, recall: float, bucket: int, cap: int, seed: int, distance: int) -> DataFrame:
    """``(node, root)`` of the groups of two or more among distinct fingerprints ``(id, fp)``.

    Splitting a bucket parts rows that may belong together. So the rows of split buckets, one for each group found so far, are searched
    again with other tables, until no bucket is split or a round joins nothing: dense clusters collapse to a few rows, and the rest gets further chances.
    """
    todo, edges, turn = alike.select("id", "fp"), None, 0
    while True:
        bits = base_bits(todo.count(), bucket)
        found, hot = _verified(todo, distance, table_count(bits, distance, recall), bits, cap, seed + turn, forest=True)
        found = materialize(found.select("u", "v"), "links")
        edges = found if edges is None else edges.unionByName(found)
        if turn and found.isEmpty():
            return roots
        roots = connected_components(edges)
        if hot is None:
            return roots
        one = hot.join(roots, hot["id"] == roots["node"], "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("id").alias("id")).select("id")
        todo = materialize(alike.select("id", "fp").join(one, "id", "left_semi"), "again")
        turn += 1


def _grouped(fps: DataFrame, recall: float, bucket: int, cap: int, seed: int, distance: int) -> DataFrame:
    """``fps(row, fp, ...)`` with ``grp``: the least row of its group (its own row where it has no fingerprint)."""
    alike = materialize(fps.where("fp is not null").groupBy("fp").agg(F.min("row").alias("id")), "distinct")
    roots = components(alike, recall, bucket, cap, seed, distance)
    named = alike.join(roots, alike["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("grp"))
    return fps.join(named, "fp", "left").withColumn("grp", F.coalesce("grp", "row"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE, recall: float = RECALL, bucket: int = BUCKET, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """One row per document: its id, ``group_id`` (the least id of its group) and ``keep`` (true on one row of each group).

    Groups are the connected components of the verified pairs. Null texts and texts without words are
    alone in their group. Rows that repeat an id are in one group per fingerprint; of rows that are all alike, one is kept.
    Null ids are grouped under null with ``keep`` true. An empty table gives an empty result. Ids that aren't whole numbers come and compare as text.
    """
    numbered = fingerprints(docs, [identifier(docs, id_col).alias("row")], text_col).withColumn("at", F.monotonically_increasing_id())
    # The numbers tell rows apart that are all alike; once written they are data.
    fps = materialize(numbered, "fingerprints")
    out = materialize(_grouped(fps.where("row is not null"), recall, bucket, cap, seed, distance).select("row", "grp", "at", "fp"), "grouped")
    # A group's least row by aggregation: no task sorts a group, however large.
    kept = out.groupBy("grp").agg(F.min(F.struct("row", "fp", "at")).alias("least")).select(F.col("least.at").alias("at"), F.lit(True).alias("first"))
    out = out.join(kept, "at", "left").select(F.col("row").alias(id_col), F.col("grp").alias("group_id"), F.coalesce("first", F.lit(False)).alias("keep"))
    none = fps.where("row is null").select(F.col("row").alias(id_col), F.col("row").alias("group_id"), F.lit(True).alias("keep"))
    return out.unionByName(none)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE, recall: float = RECALL, bucket: int = BUCKET, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """``docs`` with one document of each group: the least id, of rows that repeat it the one with the least content hash.

    All columns stay and no other comes. Rows with a null id, and ids with a null text or a text without words, all stay (rows
    that repeat both id and text count once). Texts move once, to meet their verdict by (id, content hash).
    """
    row, mark, n = fresh(docs, "row", "mark", "n")
    ident, text = identifier(docs, id_col), docs[text_col].cast("string")
    there = docs.where(ident.isNotNull())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = there.withColumns({row: ident, mark: F.xxhash64(text)})
    # Repeated rows go before the shuffle: a rank limit of 1 is applied in the tasks that read them.
    marked = marked.withColumn(n, F.row_number().over(Window.partitionBy(row, mark).orderBy(mark))).where(F.col(n) == 1).drop(n)
    fps = materialize(fingerprints(there, [ident.alias("row"), F.xxhash64(text).alias("mark")], text_col).distinct(), "fingerprints")
    grouped = _grouped(fps.where("fp is not null"), recall, bucket, cap, seed, distance)
    kept = grouped.groupBy("grp").agg(F.min(F.struct("row", "mark")).alias("k")).select(F.col("k.row").alias(row), F.col("k.mark").alias(mark))
    alone = fps.where("fp is null").select(F.col("row").alias(row), F.col("mark").alias(mark))
    return marked.join(kept.unionByName(alone), [row, mark], "left_semi").select(*columns).unionByName(docs.where(ident.isNull()).select(*columns))
