"""Chinese and mixed numerals against values known by construction."""

from __future__ import annotations

import random
from decimal import Decimal

from pyspark.sql import functions as F

from kelpie.functions import numerals

PLAIN = "零一二三四五六七八九"


def below_myriad(n, r):
    """n from 1 to 9999 as it is read; zeros in between are one 零."""
    out, zero = "", False
    for power, unit in ((1000, "千仟"), (100, "百佰"), (10, "十拾"), (1, "")):
        digit = n // power % 10
        if digit:
            name = r.choice("二两") if digit == 2 and power >= 100 else PLAIN[digit]
            out += ("零" if zero else "") + name + (r.choice(unit) if unit else "")
            zero = False
        elif out:
            zero = True
    return out


def written(n, r):
    out = ""
    high, mid, low = n // 10**8, n // 10**4 % 10**4, n % 10**4
    if high:
        out += written(high, r) + r.choice("亿億")
    if mid:
        out += ("零" if out and mid < 1000 else "") + below_myriad(mid, r) + r.choice("万萬")
    if low:
        out += ("零" if out and (low < 1000 or not mid) else "") + below_myriad(low, r)
    return out


def cases(n):
    r = random.Random(7)
    for _ in range(n):
        kind, size = r.randrange(6), 10 ** r.randint(1, 12)
        value = r.randint(1, size)
        if kind < 2:
            yield written(value, r), Decimal(value)
        elif kind == 2:
            yield f"{value:,}", Decimal(value)
        elif kind == 3:
            a = Decimal(r.randint(1, 10**6)) / 10 ** r.randint(0, 4)
            unit, times = r.choice([("万", 10**4), ("亿", 10**8), ("", 1), ("千万", 10**7), ("百万", 10**6)])
            yield f"{a.normalize():f}{unit}", a * times
        elif kind == 4:
            a, b = r.randint(1, 99), r.randint(1, 9999)
            yield f"{a}亿{b}万", Decimal(a * 10**8 + b * 10**4)
        else:
            digits = str(value)
            yield "".join(r.choice("零〇") if c == "0" else PLAIN[int(c)] for c in digits), Decimal(value)


def test_a_hundred_thousand_numerals(spark):
    rows = list(cases(100_000))
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string").repartition(4)
    wrong = [(rows[r.k][0], rows[r.k][1], r.v) for r in frame.select("k", numerals.numeral(F.col("t")).alias("v")).collect() if r.v != rows[r.k][1]]
    assert not wrong, wrong[:5]


def one(spark, column, values):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k").select(column).collect()]


def test_short_and_odd_forms(spark):
    raw = ["十五", "三万五", "三万零五", "一百五", "一百五十", "两千三", "一万亿", "半", "", None, "abc", "12a", "1.2.3", "二〇二六", "3千", "万"]
    assert [None if x is None else int(x) for x in one(spark, numerals.numeral(F.col("v")), raw)] == [15, 35000, 30005, 150, 150, 2300, 10**12, None, None, None, None, None, None, 2026, 3000, 0]


def test_amounts_and_terms(spark):
    texts = ["预算3,200万元，其中一百五十万元已付", "人民币 1.5亿", "共3个", None, ""]
    assert [[int(x) for x in a] for a in one(spark, numerals.amounts(F.col("v")), texts)] == [[32_000_000, 1_500_000], [150_000_000], [], [], []]
    terms = ["工期两年零三个月", "一年半", "合同期18个月", "2026年3月", "2026年度", "三年", "十二个月内", None, "10天", "自2025年起五年", "二〇二六年开工"]
    assert one(spark, numerals.months(F.col("v")), terms) == [27, 18, 18, None, None, 36, 12, None, None, 60, None]
