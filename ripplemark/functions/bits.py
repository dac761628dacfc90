"""Bit and alignment arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels that a row's width is rounded up to, by depth.
ALIGN = {1: 16, 2: 4, 4: 2, 8: 1, 16: 2, 32: 4}
ALIGN_DEFAULT = 4


def row_bytes(width: Column, depth: Column, align: Column) -> Column:
    """Bytes of a row of pixels, its width rounded up to the alignment."""
    return F.ceil(F.ceil(width / align) * align * depth / 8).cast("bigint")


def rgb555(v: Column) -> Column:
    """Red, green and blue of a 5-5-5 pixel, each in the upper five of eight bits."""
    part = lambda n: F.shiftleft(F.shiftright(v.cast("int"), n).bitwiseAND(F.lit(31)), 3)
    return F.struct(part(10).alias("r"), part(5).alias("g"), part(0).alias("b"))


def script_kind(flags: Column) -> Column:
    """The kind of script that a member's flags tell, the third bit before the second before the first of the upper nibble."""
    bit = lambda n: flags.cast("int").bitwiseAND(F.lit(n)) != 0
    return F.when(bit(8), 2).when(bit(4), 1).when(bit(2), 3).otherwise(0)


def progress_bucket(percent: Column) -> Column:
    """A share of a hundred, rounded down to tens."""
    return (F.floor(percent / 10) * 10).cast("int")


def varint(data: Column) -> Column:
    """A number from big-endian groups of seven bits, wrapped to 32 bits as a signed one; reads to the first byte under 128."""
    codes = F.transform(F.filter(F.split(F.hex(data), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("bigint"))
    start = F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(False).alias("done"))

    def step(acc: Column, b: Column) -> Column:
        more = F.shiftleft(acc["v"], 7).bitwiseOR(b.bitwiseAND(F.lit(127).cast("bigint"))).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.struct(F.when(acc["done"], acc["v"]).otherwise(more).alias("v"), (acc["done"] | (b < 128)).alias("done"))

    return F.aggregate(F.slice(codes, 1, 6), start, step, lambda a: a["v"].cast("int"))
