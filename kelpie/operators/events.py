"""Operators over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_subtotals(df: DataFrame, keys: list[str], flag: str, aggregates: list[Column], all_value: str = "all") -> DataFrame:
    """Aggregates by keys and flag and by keys alone, told apart by `scope`, so that a null flag is not a subtotal."""
    sets = [keys + [flag], keys]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *keys, flag).agg(F.grouping_id().alias("level"), *aggregates)
    return out.withColumn("scope", F.when(F.col("level") > 0, all_value).otherwise(F.col(flag).cast("string"))).drop("level", flag)


def latest_state(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key; order is from newest to oldest and must be total."""
    return df.withColumn("rank_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("rank_ = 1").drop("rank_")


def dense_series(counts: DataFrame, day: str, value: str) -> DataFrame:
    """Every day between the first and the last, with 0 where there is no row."""
    span = counts.agg(F.min(day).alias("a"), F.max(day).alias("b")).filter("a is not null")
    days = span.select(F.explode(F.sequence("a", "b")).alias(day))
    return days.join(counts, day, "left").select(day, F.coalesce(value, F.lit(0)).alias(value))


def sliding_hits(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Each row with the number of its key's rows in the last `seconds`, itself included, the far end excluded."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(key).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return df.withColumn("hits", F.count("*").over(w))


def funnel(df: DataFrame, session: list[str], stages: dict[str, Column], group: str | None = None) -> DataFrame:
    """Sessions that reached each stage at least once, overall or by a group column (the session's least value)."""
    flags = df.groupBy(*session).agg(*[F.max(c.cast("int")).alias(n) for n, c in stages.items()], *([F.min(group).alias(group)] if group else []))
    sums = [F.sum(n).alias(n) for n in stages]
    return flags.groupBy(group).agg(F.count("*").alias("sessions"), *sums) if group else flags.agg(F.count("*").alias("sessions"), *sums)


def top_values(df: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each group, ties by value, in one list per group."""
    counted = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("n"), F.asc(value)))
    best = counted.withColumn("rank_", rank).filter(F.col("rank_") <= k)
    return best.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_", F.col(value).alias("v")))), lambda s: s["v"].cast("string")), ",").alias("top_values"))


def keep_recent(df: DataFrame, key: str, order: list[Column], keep: int) -> DataFrame:
    """Rows with their rank in their key and whether they stay among the `keep` first."""
    return df.withColumn("rank_", F.row_number().over(W.partitionBy(key).orderBy(*order))).withColumn("kept", F.col("rank_") <= keep)


def sessionize(df: DataFrame, key: str, ts: str, gap_minutes: int) -> DataFrame:
    """A session number per key: a new one begins after a gap longer than gap_minutes."""
    order = W.partitionBy(key).orderBy(ts, "event_id")
    fresh = (F.col(ts) - F.lag(ts).over(order)) > F.expr(f"interval {gap_minutes} minutes")
    return df.withColumn("session", F.sum(F.coalesce(fresh, F.lit(False)).cast("int")).over(order))
