"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its share of the weights times the budget, over its size. A document is
repeated as often as the inverse of the Poisson distribution with that mean says at a number hashed from the seed
and the document's id, so a run can be repeated, and no document depends on another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, materialize, uniform, word_count

SEED = "mix-v1"
#: Target weights of the sources; a source not listed has DEFAULT_WEIGHT.
WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 0.5}
DEFAULT_WEIGHT = 1.0
#: Size of the mixture in sizes of the input.
EPOCHS = 1.0


def poisson_cdf(rate: float | None) -> np.ndarray:
    """P(X <= k) for k = 0, 1, ... until the tail is far under 2**-52; [1.0] for a rate of zero. Linear in the rate."""
    if not rate or rate <= 0:
        return np.ones(1)
    k = np.arange(math.ceil(rate + 12 * math.sqrt(rate) + 30) + 1)
    return np.cumsum(np.exp(-rate + k * math.log(rate) - np.cumsum(np.log(np.maximum(k, 1)))))


def _with_cdf(found: DataFrame) -> DataFrame:
    """``(source, cdf)`` of ``(source, rate)``: a row for each source, so a handful of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                cdf = pa.array([poisson_cdf(batch["rate"][i].as_py())], pa.list_(pa.float64()))
                yield pa.record_batch([batch["source"].slice(i, 1), cdf], names=["source", "cdf"])

    return found.select("source", "rate").mapInArrow(run, "source string, cdf array<double>")


def identity(ident: Column, text: Column) -> Column:
    """What a document draws by: its id, or without one its text."""
    return F.coalesce(ident.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def rates(docs: DataFrame, weights: dict[str, float], default_weight: float = DEFAULT_WEIGHT, epochs: float = EPOCHS, source_col: str = "source", size: Column | None = None) -> DataFrame:
    """``(source, size, rate)`` over all documents; a null source is a source of its own, with the default weight.

    A source of size zero has rate zero. Weights count for the sources that are there.
    """
    size = word_count(docs["text"]) if size is None else size
    sums = docs.select(docs[source_col].cast("string").alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").cast("double").alias("size"))
    table = F.create_map(*[F.lit(x) for x in chain(*weights.items())]) if weights else F.create_map().cast("map<string,double>")
    sums = sums.withColumn("weight", F.when(F.col("source").isNull(), F.lit(default_weight)).otherwise(F.coalesce(F.try_element_at(table, F.coalesce("source", F.lit(""))), F.lit(default_weight))))
    whole = sums.agg(F.sum("weight").alias("w"), F.sum("size").alias("s"))
    rate = F.when(F.col("size") > 0, F.col("weight") / F.col("w") * F.col("s") * F.lit(float(epochs)) / F.col("size")).otherwise(0.0)
    return sums.crossJoin(whole).select("source", "size", rate.alias("rate"))


def _replicated(docs: DataFrame, weights, default_weight, epochs, seed, id_col, source_col, text_col, copy: str, key: str) -> DataFrame:
    found = rates(docs, weights, default_weight, epochs, source_col, word_count(docs[text_col]))
    # Written first, so that its true size decides between broadcast and shuffle before any text moves.
    found = materialize(_with_cdf(found), "rates")
    src, cdf, at = fresh(docs, "mix_source", "mix_cdf", "mix_at")
    found = found.select(F.coalesce("source", F.lit("\x00null")).alias(src), F.col("cdf").alias(cdf))
    u = uniform(seed, identity(docs[id_col], docs[text_col]))
    drawn = docs.withColumns({src: F.coalesce(docs[source_col].cast("string"), F.lit("\x00null")), at: u}).join(found, src)
    times = F.size(F.filter(F.col(cdf), lambda c: c <= F.col(at)))
    out = drawn.withColumn(copy, times).where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copy) - 1)))
    place = F.concat_ws(":", F.lit(seed), F.lit("order"), identity(out[id_col], out[text_col]), out[copy].cast("string"))
    out = out.withColumn(key, F.substring(F.md5(place), 1, 16)).select(*[F.col(f"`{c}`") for c in docs.columns], copy, key)
    return out.repartition(F.col(key)).sortWithinPartitions(key)


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, epochs: float = EPOCHS, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixture: the documents' columns, each document as often as drawn, in an order shuffled globally.

    Sizes are words of the text (null and empty texts have none, but are drawn like any other document of
    their source). Rows that repeat an id are each drawn, with the same outcome; a document without an id draws by its text.
    An empty table gives an empty mixture. Columns of any name are carried.
    """
    copy, key = fresh(docs, "mix_copy", "mix_key")
    return _replicated(docs, weights, default_weight, epochs, seed, id_col, source_col, text_col, copy, key).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture_rows(docs: DataFrame, weights: dict[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixture of a table of documents with each row's copy number and its place in the global order (``shuffle_key``)."""
    docs = docs.select("doc_id", "source", "text")
    return _replicated(docs, weights, default_weight, epochs, seed, "doc_id", "source", "text", "copy", "shuffle_key")
