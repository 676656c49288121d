"""Merging new rows into stored ones: protected columns, child tables, claims, tombstones, snapshots. All are joins and unions
of whole tables, so a run that is repeated gives the same result; none changes a table in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def protected_merge(stored: DataFrame, new: DataFrame, key: str, *, never_null: list[str], locks: str, day: str | None = None, estimated: str | None = None, translated: dict[str, str] | None = None, tier: str | None = None, amount: str | None = None, classify=None) -> DataFrame:
    """New rows as they are to be stored, and stored rows without a new one.

    In this order: a new key is taken whole; never_null columns keep their stored value where the new one is null; an
    estimated new day never replaces a stored one; a translation (translated: column -> its original) is kept while the
    original is the same and the translation differs from it; columns named in the stored array `locks` keep the stored
    value; where the merged amount is not the new row's own, the tier is classified again over the merged row (classify: a
    function from the column of amounts to a tier), unless it is locked or would newly exclude. Keys are unique.
    """
    a, b = stored.alias("a"), new.alias("b")
    known, had = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    columns = [c for c in new.columns if c != key]
    out: dict[str, Column] = {c: F.col(f"b.{c}") for c in columns}
    for c in never_null:
        out[c] = F.coalesce(out[c], F.col(f"a.{c}"))
    if day and estimated:
        keep = F.coalesce(F.col(f"b.{estimated}"), F.lit(False)) & F.col(f"a.{day}").isNotNull()
        out[day], out[estimated] = F.when(keep, F.col(f"a.{day}")).otherwise(out[day]), F.when(keep, F.coalesce(F.col(f"a.{estimated}"), F.lit(True))).otherwise(out[estimated])
    for c, original in (translated or {}).items():
        keep = F.col(f"a.{original}").eqNullSafe(F.col(f"b.{original}")) & F.col(f"a.{c}").isNotNull() & ~F.col(f"a.{c}").eqNullSafe(F.col(f"a.{original}"))
        out[c] = F.when(keep, F.col(f"a.{c}")).otherwise(out[c])
    locked = {c: F.coalesce(F.array_contains(f"a.{locks}", c), F.lit(False)) for c in columns}
    for c in columns:
        out[c] = F.when(locked[c], F.col(f"a.{c}")).otherwise(out[c])
    if tier and amount and classify:
        again = classify(out[amount])
        changed = known & ~locked[tier] & ~out[amount].eqNullSafe(F.col(f"b.{amount}")) & ~((again == "excluded") & (out[tier] != "excluded"))
        out[tier] = F.when(changed, again).otherwise(out[tier])
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    chosen = [F.when(~known, F.col(f"b.{c}")).when(~had, F.col(f"a.{c}")).otherwise(v).alias(c) for c, v in out.items()]
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *chosen)


def refreshed_children(stored: DataFrame, new: DataFrame, parent: str, locked: Column) -> DataFrame:
    """Children of refreshed parents are replaced by the new ones, except locked stored ones; other parents' children stay."""
    parents = new.select(parent).distinct()
    keep = stored.filter(F.coalesce(locked, F.lit(False))).unionByName(stored.filter(~F.coalesce(locked, F.lit(False))).join(parents, parent, "left_anti"))
    return keep.unionByName(new)


def superseded(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose keys the new rows have are replaced by them."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def added(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows, and new ones whose keys are not stored; of new rows with equal keys one is added."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def claimed(claims: DataFrame, wanted: DataFrame, key: str, now: Column, stale_minutes: int) -> DataFrame:
    """wanted rows that may be claimed now: never claimed, failed, or sent for longer than stale_minutes without an end."""
    old = claims.select(key, F.col("state").alias("state_"), F.col("at").alias("at_"))
    free = F.col("state_").isNull() | (F.col("state_") == "failed") | ((F.col("state_") == "sending") & (F.col("at_") < now - F.expr(f"interval {stale_minutes} minutes")))
    return wanted.join(old, key, "left").filter(free).drop("state_", "at_")


def purged(df: DataFrame, key: str, gone: Column, stones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, tombstones with those of the rows that go); a key has one stone."""
    stay = df.filter(~F.coalesce(gone, F.lit(False)))
    return stay, added(stones, df.filter(gone).select(key), [key])


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old, new) where a value differs between two states of a table; rows of one state alone are no change."""
    a, b = before.select(key, F.col(value).alias("old")), after.select(key, F.col(value).alias("new"))
    return a.join(b, key).filter(~F.col("old").eqNullSafe(F.col("new")))


def stamped_by_first_child(parents: DataFrame, key: str, stamp: str, children: DataFrame, parent: str, at: str) -> DataFrame:
    """Parents without a stamp take the time of their first child; a stamp never changes."""
    first = children.groupBy(F.col(parent).alias(key)).agg(F.min(at).alias("first_"))
    return parents.join(first, key, "left").withColumn(stamp, F.coalesce(stamp, "first_")).drop("first_")


def bounded(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows, and whether there were more: the bound is the feature, and it shows."""
    some = df.orderBy(*order).limit(most + 1)
    w = W.orderBy(*order)
    return some.withColumns({"place_": F.row_number().over(w), "truncated": F.count("*").over(W.partitionBy()) > most}).filter(F.col("place_") <= most).drop("place_")


def guarded(df: DataFrame, most: int) -> DataFrame:
    """All rows, or a failed job where there are more than `most`: never a part of them."""
    size = df.agg(F.count("*").alias("n_")).select(F.when(F.col("n_") > most, F.raise_error(F.concat(F.lit(f"more than {most} rows: "), F.col("n_").cast("string")))).otherwise(F.lit(True)).cast("boolean").alias("fits_"))
    return df.join(F.broadcast(size), F.coalesce("fits_", F.lit(True))).drop("fits_")
