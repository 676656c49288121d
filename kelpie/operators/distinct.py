"""Exact distinct counts that add up: bitmaps by bucket of the counted number, kept for each day and facet.

daily() is stored once a day; any period or union of facets is then counted from its rows alone, without the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily(df: DataFrame, keys: list[Column], number: Column) -> DataFrame:
    """(keys, bucket_, bits_): which whole numbers occur, 32,768 of a bucket in one bitmap. Nulls do not count."""
    some = df.filter(number.isNotNull()).select(*keys, F.bitmap_bucket_number(number).alias("bucket_"), F.bitmap_bit_position(number).alias("at_"))
    names = [c for c in some.columns if c not in ("bucket_", "at_")]
    return some.groupBy(*names, "bucket_").agg(F.bitmap_construct_agg("at_").alias("bits_"))


def merged(parts: DataFrame, keys: list[Column]) -> DataFrame:
    """The same over coarser keys."""
    some = parts.select(*keys, "bucket_", "bits_")
    names = [c for c in some.columns if c not in ("bucket_", "bits_")]
    return some.groupBy(*names, "bucket_").agg(F.bitmap_or_agg("bits_").alias("bits_"))


def counted(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): how many different numbers each key has."""
    return parts.groupBy(*keys).agg(F.sum(F.bitmap_count("bits_")).alias("n"))


def both(parts: DataFrame, keys: list[str], facet: str, a: str, b: str) -> DataFrame:
    """(keys, n): how many different numbers have both facets, from the counts of either and of their union."""
    two = parts.filter(F.col(facet).isin(a, b))
    each = counted(merged(two, [*map(F.col, keys), F.col(facet)]), [*keys, facet]).groupBy(*keys).agg(F.sum("n").alias("sum_"))
    union = counted(merged(two, [F.col(k) for k in keys]), keys)
    return each.join(union, keys).select(*keys, (F.col("sum_") - F.col("n")).alias("n"))
