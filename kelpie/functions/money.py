"""Amounts: exchange to one currency, value bands, tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper limits of the value bands; a value belongs to the first band whose limit it is below.
BANDS = (1_000.0, 5_000.0, 25_000.0, 100_000.0, 200_000.0, 350_000.0)


def exchanged(value: Column, currency: Column, rates: dict[str, float]) -> Column:
    """value in the base currency; an unknown currency gives null."""
    table = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    return value * F.element_at(table, currency)


def band(value: Column, limits: tuple[float, ...] = BANDS) -> Column:
    """The number of limits at or below the value; null stays null."""
    out = F.lit(len(limits))
    for k in range(len(limits) - 1, -1, -1):
        out = F.when(value < limits[k], k).otherwise(out)
    return F.when(value.isNotNull(), out)


def tier(value: Column, floors: tuple[tuple[float, str], ...], below: str) -> Column:
    """The name of the highest floor that the value reaches; floors from high to low."""
    out = F.lit(below)
    for floor, name in reversed(floors):
        out = F.when(value >= floor, name).otherwise(out)
    return out


def unit_band(code: Column, bands: dict[str, tuple[float | None, float | None]], rate: float) -> Column:
    """(low, high) in the base currency for a procedure code whose amounts lie between multiples of a unit."""
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (a, b) in bands.items():
        low = F.when(code == name, F.lit(None if a is None else a * rate).cast("double")).otherwise(low)
        high = F.when(code == name, F.lit(None if b is None else b * rate).cast("double")).otherwise(high)
    return F.struct(low.alias("low"), high.alias("high"))
