"""Operators of list pages, merges and order-dependent comparisons, as DataFrame compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def facets(filters: dict[str, list]) -> Column:
    """A conjunction of facets; an empty list restricts nothing. Nulls match no listed value."""
    out = F.lit(True)
    for column, values in filters.items():
        if values:
            out = out & F.col(column).isin(*values)
    return out


def interleaved(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Append turn: each key's rows by `order`, from 1. Sorting by turn and key takes the keys in rotation."""
    return df.withColumn("turn", F.row_number().over(W.partitionBy(key).orderBy(*order)))


def facet_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) for several columns in one pass and one shuffle of partial counts."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.facet", "p.value").groupBy("facet", "value").agg(F.count("*").alias("n"))


def previous_of(df: DataFrame, keys: list[str], order: list[Column], take: dict[str, str]) -> DataFrame:
    """The row before each row in its group: an as-of self-join without a join. take: new name -> column."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumns({name: F.lag(column).over(w) for name, column in take.items()})


def changes(df: DataFrame, keys: list[str], order: list[Column], column: str) -> DataFrame:
    """Rows at which `column` differs from the row before, nulls being a value; a group's first row is no change."""
    w = W.partitionBy(*keys).orderBy(*order)
    marked = df.withColumns({"old_": F.lag(column).over(w), "place_": F.row_number().over(w)})
    return marked.filter((F.col("place_") > 1) & ~F.col("old_").eqNullSafe(F.col(column))).drop("place_")


def merged(stored: DataFrame, new: DataFrame, key: str, fields: list[str], locked: Column) -> DataFrame:
    """Stored rows with a new row's non-null fields, unless `locked` (over the stored row); new keys are added whole.

    Keys are unique on both sides. Where `locked` is null the row is not locked.
    """
    a, b = stored.withColumn("locked_", F.coalesce(locked, F.lit(False))).alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    kept = F.coalesce(F.col("a.locked_"), F.lit(False))
    return joined.select(
        F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key),
        *[F.when(kept, F.col(f"a.{f}")).otherwise(F.coalesce(F.col(f"b.{f}"), F.col(f"a.{f}"))).alias(f) for f in fields],
        F.when(F.col(f"a.{key}").isNull(), "added").when(kept, "locked").when(F.col(f"b.{key}").isNull(), "kept").otherwise("merged").alias("outcome"),
    )
