"""Normalised distances as Column expressions; all are 0 for equal values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB = 60


def point(a: Column, b: Column) -> Column:
    """|a - b| over the larger, 0 if that is 0."""
    return F.coalesce(F.abs(a - b).cast("double") / F.nullif(F.greatest(a, b).cast("double"), F.lit(0.0)), F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def euclid(a: Column, b: Column) -> Column:
    """The length of the difference over the larger of both lengths, 0 if that is 0."""
    gap = norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))
    return F.coalesce(gap / F.nullif(F.greatest(norm(a), norm(b)), F.lit(0.0)), F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ over the bit length of the difference; a and b are limbs of 60 bits, low first."""
    zero = F.lit(0).cast("bigint")
    x = F.zip_with(a, b, lambda p, q: F.coalesce(p, zero).bitwiseXOR(F.coalesce(q, zero)))
    ones = F.aggregate(x, F.lit(0), lambda s, v: s + F.bit_count(v))
    length = F.array_max(F.transform(x, lambda v, i: F.when(v != 0, i * LIMB + F.length(F.bin(v))).otherwise(0)))
    return F.coalesce(ones.cast("double") / F.nullif(length, F.lit(0)), F.lit(0.0))


def limbs(octal: Column) -> Column:
    """The 60-bit limbs, low first, of a number in octal digits: 20 digits make a limb."""
    digits = F.regexp_replace(octal, "^0+", "")
    n = F.ceil(F.length(digits) / 20).cast("int")
    part = lambda i: F.conv(F.reverse(F.substring(F.reverse(digits), i * 20 + 1, F.lit(20))), 8, 10).cast("bigint")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), part)).otherwise(F.array().cast("array<bigint>"))
