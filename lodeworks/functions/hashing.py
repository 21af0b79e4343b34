"""Strings as big numbers modulo M, and the hash families of the sketches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus of the Bloom filter's hashes (fixed value).
BLOOM_MODULUS = 233333333333


def string_mod(c: Column, modulus: int) -> Column:
    """int(hex of the UTF-8 bytes, 16) mod modulus, byte by byte, so that no big number arises; null for null and empty."""
    h = F.hex(F.encode(c, "UTF-8"))
    byte = lambda i: F.conv(F.substring(h, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
    n = (F.length(h) / 2).cast("int")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("long"), lambda acc, i: (acc * 256 + byte(i)) % modulus))


def bloom_bits(c: Column, coefficients: list[tuple[int, int]], bits: int, modulus: int = BLOOM_MODULUS) -> Column:
    """The positions ((a * x + b) mod modulus) mod bits of a string's number x."""
    x = string_mod(c, modulus).cast("decimal(12,0)")
    one = lambda a, b: ((x * F.lit(a % modulus).cast("decimal(12,0)") + F.lit(b).cast("decimal(12,0)")) % F.lit(modulus).cast("decimal(12,0)")).cast("long") % bits
    return F.array(*[one(a, b) for a, b in coefficients])


def trailing_zeros(h: Column) -> Column:
    """Zeros at the end of the binary form; 1 for 0."""
    b = F.bin(h)
    return F.length(b) - F.length(F.regexp_replace(b, "0+$", ""))
