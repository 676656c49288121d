"""Snapshots in buckets with a digest each: two of them are compared bucket by bucket, and only unequal ones are read.

A bucket's digest is its number of rows and two xors of row hashes, which do not depend on the order of rows. Digests lie in a
small table beside the rows, so a comparison reads as many of these as there are buckets, and then the buckets that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def _hash(columns: list[str], seed: int) -> Column:
    told = [c for name in columns for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`").cast("string"))]
    return F.xxhash64(F.lit(seed), *told)


def take(df: DataFrame, keys: list[str], folder: str, buckets: int = BUCKETS) -> None:
    """Write df as a snapshot: its rows by bucket of the keys, then the digests, which make it complete.

    Keys are unique and may be null. Two snapshots are comparable if they have the same columns, keys and buckets.
    """
    rows = df.withColumn("bucket_", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    rows.repartition("bucket_").write.mode("overwrite").partitionBy("bucket_").parquet(f"{folder}/rows")
    stored = df.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
    digests = stored.groupBy("bucket_").agg(F.count("*").alias("n_"), *[F.bit_xor(_hash(df.columns, s)).alias(f"x{s}_") for s in (1, 2)])
    digests.coalesce(1).write.mode("overwrite").parquet(f"{folder}/digests")


def unequal(spark: SparkSession, before: str, after: str) -> list[int]:
    """The buckets that differ; at most as many as a snapshot has."""
    a, b = (spark.read.parquet(f"{f}/digests") for f in (before, after))
    same = a.join(b, ["bucket_", "n_", "x1_", "x2_"], "left_semi").select("bucket_")
    every = a.select("bucket_").union(b.select("bucket_")).distinct()
    return sorted(r[0] for r in every.join(same, "bucket_", "left_anti").collect())


def changes(spark: SparkSession, before: str, after: str, schema: str, keys: list[str], field: str) -> DataFrame:
    """(keys, kind, old, new) for every key whose field differs: added, removed or changed; null and no value are told apart
    by kind. Only unequal buckets are read."""
    buckets = unequal(spark, before, after)

    def side(folder: str, name: str) -> DataFrame:
        rows = spark.read.schema(f"{schema}, bucket_ int").parquet(f"{folder}/rows").filter(F.col("bucket_").isin(buckets) if buckets else F.lit(False))
        return rows.select(*keys, F.col(field).alias(name), F.lit(True).alias(f"{name}_"))

    a, b = side(before, "old").alias("a"), side(after, "new").alias("b")
    met = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    kind = F.when(F.col("old_").isNull(), "added").when(F.col("new_").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    named = [F.when(F.col("old_").isNull(), F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys]
    return met.select(*named, kind.alias("kind"), "old", "new").filter("kind is not null")
