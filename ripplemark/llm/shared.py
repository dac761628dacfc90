"""Helpers that the corpus operators share; tables in the shared folder and collision-free names are the core's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..storage import fresh, materialize, read, scratch_path, shared_dir

__all__ = ["WORD_COUNT_SQL", "fresh", "materialize", "read", "scratch_path", "shared_dir", "uniform", "word_count"]


def uniform(seed: str, *key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:key...); a null key part counts as ``null``."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("null")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab, newline, return and form feed; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)).cast("bigint")


WORD_COUNT_SQL = "coalesce(len(regexp_extract_all({0}, '[^ \\t\\n\\r\\f]+')), 0)"

