"""Array expressions: membership, set equality, merging, numbered chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def has_any(values: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted])), F.lit(False)) if wanted else F.lit(True)


def has_all(values: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), values)) == 0, F.lit(False)) if wanted else F.lit(True)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def merged_without(a: Column, b: Column, fallback: str) -> Column:
    """Both arrays' values in order of appearance; the fallback only where nothing else is left."""
    out = F.array_remove(F.array_union(a, b), fallback)
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit(fallback)))


def chunk_of(keys: list[str], order: list[Column], size: int) -> Column:
    """The number of a row's chunk of `size` rows inside its group."""
    return F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1) / size)
