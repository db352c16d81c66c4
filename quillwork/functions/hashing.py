"""Deterministic draws and buckets from digests: the same numbers in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(n: Column | int, *parts: Column) -> Column:
    """A number in 0..n-1 from the first 8 hexadecimal digits of the parts' digest."""
    digest = F.sha2(F.concat_ws("/", *[p.cast("string") for p in parts]), 256)
    whole = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.pmod(whole, n if isinstance(n, Column) else F.lit(n))


def bucket(text: Column, modulus: int) -> Column:
    """The whole SHA-256 digest as a number, modulo modulus: one Horner step per digit, no big integers."""
    digits = F.transform(F.split(F.sha2(text, 256), ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * 16 + d) % F.lit(modulus))


#: Upper ends of the shares of 100, and their names (fixed values).
SHARES = ((10, "pilot_development"), (20, "pilot_validation"), (60, "optimization"), (75, "validation"), (100, "test"))


def partition_of(number: Column) -> Column:
    out = F.lit(None).cast("string")
    for end, name in reversed(SHARES):
        out = F.when(number < end, name).otherwise(out)
    return out
