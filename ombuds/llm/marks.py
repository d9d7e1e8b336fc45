"""Sets of keys as bitmaps of a fixed size, built and asked with DataFrame functions.

A key sets one bit, so a set answers "present" for every key that was put in, and now and
then for another one. Its size does not grow with the data: at most ``bits / 8`` bytes, in rows
of 4 KB, which is the proven bound under which it is broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one row; what ``bitmap_construct_agg`` makes.
ROW_BITS = 32_768


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    slot = F.pmod(key, F.lit(bits))
    return F.floor(slot / ROW_BITS).cast("int"), (slot % ROW_BITS).cast("int")


def marks(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """(mark_row, mark_bits): the set of ``key`` over all rows; at most ``bits / ROW_BITS`` rows."""
    row, bit = _place(key, bits)
    return keys.select(row.alias("mark_row"), bit.cast("long").alias("bit")).groupBy("mark_row").agg(
        F.bitmap_construct_agg("bit").alias("mark_bits"))


def flagged(rows: DataFrame, key: Column, found: DataFrame, bits: int, name: str) -> DataFrame:
    """``rows`` with a column ``name``: whether ``key`` may be in the set ``found``. No shuffle."""
    row, bit = _place(key, bits)
    columns = rows.columns
    out = rows.select("*", row.alias("mark_row"), bit.alias("mark_bit")).join(F.broadcast(found), "mark_row", "left")
    byte = F.conv(F.hex(F.substring("mark_bits", F.floor(F.col("mark_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    bit_set = F.getbit(byte.cast("long"), F.col("mark_bit") % 8) == 1
    return out.select(*columns, F.coalesce(bit_set, F.lit(False)).alias(name))


def collected(found: DataFrame, bits: int) -> np.ndarray:
    """The whole set as ``bits / 8`` bytes, for ``among``; so many bytes reach the driver."""
    out = np.zeros(bits // 8, np.uint8)
    size = ROW_BITS // 8
    for r in found.toLocalIterator():
        out[r.mark_row * size:(r.mark_row + 1) * size] = np.frombuffer(r.mark_bits, np.uint8)
    return out


def among(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be in a ``collected`` set, whose number of bits is a power of two."""
    slot = keys.view(np.uint64) & np.uint64(8 * len(table) - 1)
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
