"""Amounts and terms written in Chinese, over the values of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import numerals
from kelpie.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN floor(o_totalprice) WHEN 2 THEN floor(o_totalprice) * 10000 ELSE floor(o_totalprice / 1000) * 100000000 + 30000000 END AS DOUBLE) AS amount,
CAST(CASE o_orderkey % 3 WHEN 0 THEN o_custkey % 40 + 1 WHEN 1 THEN (o_custkey % 9 + 1) * 12 + 6 ELSE (o_custkey % 9 + 1) * 12 + o_custkey % 11 + 1 END AS INTEGER) AS months FROM orders""")
def written_amounts(spark, d):
    """The value and the term of each order from a sentence in mixed numerals: with commas, in 万 and a rest, in 万 alone, in 亿 and
    千万; in months, in years and a half, in years and months of written digits."""
    o, k, c = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    v = F.floor("o_totalprice")
    rest = v % 10_000
    mixed = F.concat(F.floor(v / 10_000).cast("string"), F.lit("万"), F.when(rest > 0, rest.cast("string")).otherwise(""))
    price = F.when(k % 4 == 0, F.format_number(v, 0)).when(k % 4 == 1, mixed).when(k % 4 == 2, F.concat(v.cast("string"), F.lit("万"))).otherwise(F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("亿3千万")))
    digits, teens = F.array(*[F.lit(x) for x in "一二三四五六七八九"]), F.array(*[F.lit(x) for x in (*"一二三四五六七八九十", "十一")])
    years = F.get(digits, (c % 9).cast("int"))
    term = F.when(k % 3 == 0, F.concat((c % 40 + 1).cast("string"), F.lit("个月"))).when(k % 3 == 1, F.concat(years, F.lit("年半"))).otherwise(F.concat(years, F.lit("年零"), F.get(teens, (c % 11).cast("int")), F.lit("个月")))
    text = F.concat(F.lit("2026年招标，总价"), price, F.lit("元，工期"), term, F.lit("。"))
    read = o.select("o_orderkey", text.alias("text"))
    return read.select("o_orderkey", F.get(numerals.amounts(F.col("text")), F.lit(0)).cast("double").alias("amount"), numerals.months(F.col("text")).alias("months"))
