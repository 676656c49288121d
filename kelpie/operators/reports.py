"""Operators of reports: first values, shares, explanations, awards, acquisition, single procurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ordered(list_: Column, field: str) -> Column:
    return F.transform(F.array_sort(list_), lambda s: s[field])


def first_distinct(df: DataFrame, keys: list[str], value: str, order: str, k: int) -> DataFrame:
    """(keys, firsts, n): the first k distinct values in order of appearance, comma-joined, and the number of all."""
    seen = df.groupBy(*keys, value).agg(F.min(order).alias("at_"))
    ranked = seen.withColumn("r_", F.row_number().over(W.partitionBy(*keys).orderBy("at_")))
    firsts = F.collect_list(F.when(F.col("r_") <= k, F.struct("r_", F.col(value).cast("string").alias("v"))))
    return ranked.groupBy(*keys).agg(F.array_join(_ordered(firsts, "v"), ",").alias("firsts"), F.count("*").alias("n"))


def explained(df: DataFrame, why: str, by: str, id_: str, examples: int) -> DataFrame:
    """(why, n, countries, examples): rows by reason, their counts by another column, and a few ids."""
    counts = df.groupBy(why, by).agg(F.count("*").alias("c_"))
    told = counts.groupBy(why).agg(F.sum("c_").alias("n"), F.collect_list(F.struct((-F.col("c_")).alias("m"), F.col(by).alias("b"))).alias("l_"))
    told = told.select(why, "n", F.array_join(F.transform(F.array_sort("l_"), lambda s: F.concat(s["b"], F.lit(":"), (-s["m"]).cast("string"))), ",").alias("countries"))
    some = df.select(why, id_).withColumn("r_", F.row_number().over(W.partitionBy(why).orderBy(id_))).filter(F.col("r_") <= examples)
    shown = some.groupBy(why).agg(F.array_join(_ordered(F.collect_list(F.struct("r_", F.col(id_).cast("string").alias("v"))), "v"), ",").alias("examples"))
    return told.join(shown, why)


def shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(part, value, n, percent) of several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("value")) for c in columns]))
    counted = df.select(pairs.alias("p")).groupBy("p.part", "p.value").agg(F.count("*").alias("n"))
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("part")), 2))


def merged_lists(df: DataFrame, key: str, order: Column, lists: str) -> DataFrame:
    """Lists of a key in one, in order, each element once."""
    told = df.groupBy(key).agg(F.collect_list(F.struct(order.alias("o"), F.col(lists).alias("l"))).alias("l_"))
    return told.select(key, F.array_distinct(F.flatten(_ordered(F.col("l_"), "l"))).alias(lists))


def awards(parts: DataFrame, key: str, supplier: str, order: list[str], amount: str, currency: str, day: str) -> DataFrame:
    """One row an award: suppliers once each, by their first spelling and in order; the last day; the sum where the currency
    is one. Blank suppliers are no names."""
    folded = F.nullif(F.lower(F.trim(supplier)), F.lit(""))
    firsts = parts.withColumn("k_", folded).filter("k_ is not null").groupBy(key, "k_").agg(F.min(F.struct(*order, F.col(supplier).alias("name_"))).alias("f_"))
    names = firsts.groupBy(key).agg(_ordered(F.collect_list("f_"), "name_").alias("suppliers"))
    sums = parts.groupBy(key).agg(F.max(day).alias("awarded"), F.countDistinct(currency).alias("c_"), F.sum(F.col(amount).cast("decimal(20,2)")).cast("double").alias("s_"))
    return sums.join(names, key, "left").select(key, "suppliers", "awarded", F.when(F.col("c_") <= 1, F.col("s_")).alias("amount"))


def available(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """The values that occur, with their place in a fixed order; values outside it are left out."""
    places = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(order)], f"{column} string, pos int")
    return F.broadcast(places).join(df.select(column).distinct(), column)


def acquisition(rows: DataFrame, session: list[str], own: Column, source: Column, stages: dict[str, Column], accounts: DataFrame, account_source: str, linked: str) -> DataFrame:
    """Sessions that reached each stage by source, without sessions that an own account ever had; signups and unlinked ones
    count accounts."""
    per = rows.groupBy(*session).agg(F.bool_or(own).alias("own_"), source.alias("source"), *[c.alias(n) for n, c in stages.items()]).filter("not own_")
    zero = F.lit(0)
    a = per.select("source", F.lit(1).alias("visitors"), *[F.col(n).cast("int").alias(n) for n in stages], zero.alias("signups"), zero.alias("unlinked"))
    b = accounts.select(F.col(account_source).alias("source"), zero.alias("visitors"), *[zero.alias(n) for n in stages], F.lit(1).alias("signups"), (~F.col(linked)).cast("int").alias("unlinked"))
    names = ["visitors", *stages, "signups", "unlinked"]
    return a.unionByName(b).groupBy("source").agg(*[F.sum(n).alias(n) for n in names])


def award_filled(stored: DataFrame, found: DataFrame, key: str, today: Column) -> DataFrame:
    """Rows that lack a day, supplier or amount, with what results tell: only up to today, only empty fields, never locked
    rows, an amount only in the row's own currency; mismatch tells where it was another."""
    a, b = stored.alias("a"), found.alias("b")
    lacks = F.col("a.amount").isNull() | F.col("a.supplier").isNull() | F.col("a.day").isNull()
    joined = a.filter(lacks).join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left")
    ok = F.coalesce(~F.col("a.locked") & (F.col("b.day") <= today), F.lit(False))
    agrees = F.coalesce(F.col("a.currency") == F.col("b.currency"), F.lit(False))
    taken = F.col("a.amount").isNull() & ok & F.col("b.amount").isNotNull()
    return joined.select(
        F.col(f"a.{key}").alias(key), F.coalesce("a.day", F.when(ok, F.col("b.day"))).alias("day"), F.coalesce("a.supplier", F.when(ok, F.col("b.supplier"))).alias("supplier"),
        F.coalesce("a.amount", F.when(ok & agrees, F.col("b.amount"))).alias("amount"), (taken & ~agrees).alias("mismatch"),
    )


def single_procurements(df: DataFrame, key: Column, stored: Column, dead: Column, order: list[Column]) -> DataFrame:
    """All stored rows; of new ones of a key the first, where no stored row has that key. Stored rows of a dead state are no
    twins; a null key has none. This is what going through new rows one by one, in order, keeps."""
    rows = df.withColumns({"key_": key, "stored_": F.coalesce(stored, F.lit(False)), "dead_": F.coalesce(dead, F.lit(False))})
    twins = rows.filter("stored_ and not dead_ and key_ is not null").select("key_").distinct()
    new = rows.filter("not stored_ and key_ is not null").join(twins, "key_", "left_anti")
    first = new.withColumn("r_", F.row_number().over(W.partitionBy("key_").orderBy(*order))).filter("r_ = 1").drop("r_")
    return rows.filter("stored_ or key_ is null").unionByName(first).drop("key_", "stored_", "dead_")
