"""Average hash over a 64-value grid, and conversions of the 64-bit hash.

The last step of an average hash is: bit i = value i > mean of all values.
Over a stored vector (an 8x8 grid of gray levels, or any 64 numbers) this is
pure SQL; the image form in ``sources.images`` shrinks pixels to the grid
first and then uses the same expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def average_bits(values: Column) -> Column:
    """'0'/'1' string, one character per value: value > mean of the values."""
    e = F.transform(values, lambda x: x.cast("double"))
    mean = F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / F.size(e)
    return F.array_join(F.transform(e, lambda x: F.when(x > mean, F.lit("1")).otherwise(F.lit("0"))), "")


def bits_to_long(bits: Column) -> Column:
    """64-character bit string -> signed BIGINT (top bit set gives a negative)."""
    return F.conv(bits, 2, -10).cast("bigint")


def long_to_hex(h: Column) -> Column:
    """Signed BIGINT -> 16 lower-case hex digits (two's complement)."""
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
