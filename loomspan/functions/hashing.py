"""Deterministic draws from keys: the same in Spark and in any engine with md5."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2 ** 52: thirteen hexadecimal digits.
SPAN = 4503599627370496.0


def u01(key: Column) -> Column:
    """Uniform in [0, 1) from the first 52 bits of md5(key). Hash integers and strings only: doubles print differently elsewhere."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("long") / F.lit(SPAN)


def order_key(seed: str, key: Column) -> Column:
    """Sort key of a seeded shuffle (SRT-06)."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")))
