"""Operators over notices: import gates, duplicates, merges of results, schedules, pages and order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.functions.rules import first_match
from kelpie.session import stored


def gated(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Append reject_reason: the first rule that turns the row away, null where none does."""
    return df.withColumn("reject_reason", first_match(rules))


def without_duplicates(df: DataFrame, key: Column, stored: Column, order: list[Column]) -> DataFrame:
    """Stored rows stay; a new row goes where its key is stored or an earlier new row has it. A null key has no twin."""
    w = W.partitionBy("key_")
    keyed = df.withColumns({"key_": key, "stored_": stored})
    ranked = keyed.filter("key_ is not null").withColumns({"any_": F.max(F.col("stored_").cast("int")).over(w), "rank_": F.row_number().over(w.orderBy(F.desc("stored_"), *order))})
    kept = ranked.filter(F.col("stored_") | ((F.col("any_") == 0) & (F.col("rank_") == 1))).drop("any_", "rank_")
    return kept.unionByName(keyed.filter("key_ is null")).drop("key_", "stored_")


def owned(df: DataFrame, key: list[str], order: list[Column], owner: str, stored: Column) -> DataFrame:
    """Rows of a key's first row's owner, and all stored rows."""
    first = F.first(owner).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return df.withColumn("owner_", first).filter(stored | F.col("owner_").eqNullSafe(F.col(owner))).drop("owner_")


def combined_awards(parts: DataFrame, key: str, supplier: str, amount: str, currency: str, day: str) -> DataFrame:
    """One row per award: suppliers told apart without case, last day, and the amount where the currency is one.
    Only suppliers are counted as distinct values: a second such count would send every row three times."""
    named = parts.withColumn("s_", F.lower(F.trim(supplier)))
    return named.groupBy(key).agg(
        F.countDistinct("s_").alias("suppliers"),
        F.max(day).alias("awarded"),
        F.min(currency).alias("least_"),
        F.max(currency).alias("most_"),
        F.sum(F.col(amount).cast("decimal(20,2)")).alias("sum_"),
    ).withColumn("amount", F.when(F.coalesce(F.col("least_") == F.col("most_"), F.lit(True)), F.col("sum_").cast("double"))).drop("sum_", "least_", "most_")


def filled(stored: DataFrame, found: DataFrame, key: str, fields: list[str], allowed: Column) -> DataFrame:
    """Stored rows whose empty fields take what was found, where `allowed` holds; present values never change."""
    a, b = stored.alias("a"), found.alias("b")
    ok = F.coalesce(allowed, F.lit(False))
    others = [F.col(f"a.{c}") for c in stored.columns if c not in fields]
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left")
    return joined.select(*others, *[F.coalesce(F.col(f"a.{f}"), F.when(ok, F.col(f"b.{f}"))).alias(f) for f in fields])


def order_violations(df: DataFrame, key: str, rank: str, day: str) -> DataFrame:
    """Stages of a schedule whose earliest day lies before the latest day of the stage before."""
    stages = df.groupBy(key, rank).agg(F.min(day).alias("earliest"), F.max(day).alias("latest"))
    before = F.lag("latest").over(W.partitionBy(key).orderBy(rank))
    return stages.withColumn("before", before).filter("earliest < before").select(key, rank, "earliest", "before")


def schedule_diff(stored: DataFrame, new: DataFrame, keys: list[str], day: str) -> DataFrame:
    """New schedule rows as insert (unknown), duplicate (same day) or conflict (another day)."""
    known = stored.select(*keys, F.col(day).alias("stored_day"), F.lit(True).alias("known_"))
    kind = F.when(F.col("known_").isNull(), "insert").when(F.col("stored_day").eqNullSafe(F.col(day)), "duplicate").otherwise("conflict")
    return new.join(known, keys, "left").withColumn("kind", kind).drop("known_")


def sibling_filled(df: DataFrame, family: str, order: list[Column], fields: list[str]) -> DataFrame:
    """Null fields take the first value among siblings."""
    w = W.partitionBy(family).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return df.withColumns({f: F.coalesce(f, F.first(f, ignorenulls=True).over(w)) for f in fields})


#: Rows up to the end of a page that is read from the front.
EARLY = 10_000


def page(df: DataFrame, order: list[Column], number: int, rows: int) -> DataFrame:
    """One page; a number outside 1 to the last page is moved to the nearest. order is total.

    An early page is among the first rows, of which each task keeps no more than lie up to its end. For a later one, rows are dealt to partitions by ranges of the order and stored, since another run might draw other ranges. The counts,
    one number a partition, tell which partitions hold the page, so no task ever holds more than its own range, however late
    the page is.
    """
    if number * rows <= EARLY:
        place = W.orderBy(*order)
        head = df.orderBy(*order).limit(max(number, 1) * rows).withColumn("place_", F.row_number().over(place))
        first = (F.least(F.lit(max(number, 1)), F.greatest(F.ceil(F.max("place_").over(W.partitionBy()) / rows), F.lit(1))) - 1) * rows
        return head.withColumn("first_", first).filter((F.col("place_") > F.col("first_")) & (F.col("place_") <= F.col("first_") + rows)).select(*df.columns)
    ranged = stored(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "pages")
    counts = ranged.groupBy("part_").agg(F.count("*").alias("n_"))
    upto = W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    # one row a partition of the exchange
    starts = counts.select("part_", "n_", F.coalesce(F.sum("n_").over(upto), F.lit(0)).alias("before_"), F.sum("n_").over(W.partitionBy()).alias("all_"))
    pages = F.greatest(F.ceil(F.col("all_") / rows), F.lit(1))
    first = (F.least(F.greatest(F.lit(number), F.lit(1)), pages) - 1) * rows
    hit = starts.withColumn("first_", first).filter((F.col("before_") < F.col("first_") + rows) & (F.col("before_") + F.col("n_") > F.col("first_")))
    held = ranged.join(F.broadcast(hit.select("part_", "before_", "first_")), "part_")
    place = F.col("before_") + F.row_number().over(W.partitionBy("part_").orderBy(*order))
    return held.withColumn("place_", place).filter((F.col("place_") > F.col("first_")) & (F.col("place_") <= F.col("first_") + rows)).select(*df.columns)


def floor_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], width: float) -> DataFrame:
    """The value at position floor(n * q) of each group's ascending order (the last one where q is 1).

    Counts per bin of `width` find the bin of each position; only rows of those bins are then ranked, so no group is
    sorted as a whole. Null values do not count.
    """
    binned = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v_"), F.floor(F.col(value) / width).alias("bin_"))
    bins = binned.groupBy(*keys, "bin_").agg(F.count("*").alias("n_"))
    upto = W.partitionBy(*keys).orderBy("bin_")
    bins = bins.withColumns({"end_": F.sum("n_").over(upto), "all_": F.sum("n_").over(W.partitionBy(*keys))})
    want = bins.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in shares])))
    want = want.withColumn("at_", F.least(F.floor(F.col("all_") * F.col("q")), F.col("all_") - 1))
    want = want.filter((F.col("at_") < F.col("end_")) & (F.col("at_") >= F.col("end_") - F.col("n_")))
    want = want.withColumn("place_", F.col("at_") - F.col("end_") + F.col("n_") + 1).select(*keys, "bin_", "q", "place_")
    needed = binned.join(want.select(*keys, "bin_").distinct(), [*keys, "bin_"], "left_semi")
    ranked = needed.withColumn("place_", F.row_number().over(W.partitionBy(*keys, "bin_").orderBy("v_")))
    return want.join(ranked, [*keys, "bin_", "place_"]).select(*keys, "q", F.col("v_").alias(value))
