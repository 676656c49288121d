"""Chinese and mixed numerals, amounts of money and terms in them, read by one fold over the characters in the JVM.

A numeral is digits of either script with the units ten, hundred, thousand, ten thousand and hundred million, such as
`三千二百万`, `1.5亿`, `2亿3000万`, `两万零五十`, `二〇二六`, `1,200万`. The state of the fold is a handful of numbers, so its cost is
that of the characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits and units of the written language, in their plain and their banking forms.
DIGITS = {"零": 0, "〇": 0, "○": 0, "一": 1, "壹": 1, "二": 2, "两": 2, "贰": 2, "三": 3, "叁": 3, "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陆": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9}
UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
MYRIADS = {"万": 10**4, "萬": 10**4, "亿": 10**8, "億": 10**8}
CHARACTERS = "".join([*DIGITS, *UNITS, *MYRIADS])
NUMERAL = rf"(?:[0-9][0-9,]*+(?:\.[0-9]++)?+[{''.join([*UNITS, *MYRIADS])}]*+|[{CHARACTERS}])++"
_DECIMAL = "decimal(38,6)"


def _map(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def numeral(text: Column) -> Column:
    """The value of a numeral as decimal(38,6); null where the text is anything else, empty or null.

    `百`, `十` without a digit before count one. Digits in a row are places (`二〇二六` is 2026). A last digit of the written
    language right after hundred, thousand or ten thousand is of the next lower unit (`三万五` is 35,000), unless a zero stands
    between. `亿` multiplies all that stands before it, so `一万亿` is a million millions.
    """
    bare = F.regexp_replace(F.trim(text), "(?<=[0-9]),(?=[0-9]{3})", "")
    chars = F.split(bare, "")
    digit, unit, myriad = _map(DIGITS), _map(UNITS), _map(MYRIADS)

    def d(value) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).cast(_DECIMAL)

    # high: what stands before 亿; mid: 万 below it; low: below 万; run: digits not yet placed; scale: of the next decimal;
    # last: the lowest unit so far; own: digits in the run of the written language; zero: one stood since the last unit
    start = F.struct(*[d(0).alias(k) for k in ("high", "mid", "low", "run")], d(0).alias("scale"), d(1).alias("last"), F.lit(0).alias("own"), F.lit(False).alias("zero"))

    def step(s, c):
        arabic = c.rlike("^[0-9]$")
        is_digit, is_unit, is_myriad = arabic | F.map_contains_key(digit, c), F.map_contains_key(unit, c), F.map_contains_key(myriad, c)
        value = d(F.when(arabic, c.try_cast("int")).otherwise(F.element_at(digit, c)))
        placed = d(F.when(s["scale"] > 0, s["run"] + value * s["scale"]).otherwise(s["run"] * 10 + value))
        u, m = d(F.element_at(unit, c)), d(F.element_at(myriad, c))
        low = d(s["low"] + F.when(s["run"] == 0, u).otherwise(s["run"] * u))
        below = d(s["low"] + s["run"])
        top = m == 10**8
        return F.struct(
            d(F.when(is_myriad & top, s["high"] + (s["mid"] + below) * m).otherwise(s["high"])).alias("high"),
            d(F.when(is_myriad, F.when(top, 0).otherwise(s["mid"] + below * m)).otherwise(s["mid"])).alias("mid"),
            d(F.when(is_myriad, 0).when(is_unit, low).otherwise(s["low"])).alias("low"),
            d(F.when(is_digit, placed).when(is_unit | is_myriad, 0).otherwise(s["run"])).alias("run"),
            d(F.when(c == ".", F.lit(0.1)).when(is_digit & (s["scale"] > 0), s["scale"] / 10).when(is_digit, s["scale"]).otherwise(0)).alias("scale"),
            d(F.when(is_unit, u).when(is_myriad, m).otherwise(s["last"])).alias("last"),
            F.when(is_digit & ~arabic, s["own"] + 1).otherwise(0).alias("own"),
            F.when(is_unit | is_myriad, False).when(c.isin("零", "〇", "○"), True).otherwise(s["zero"]).alias("zero"),
        )

    def total(s):
        short = (s["own"] == 1) & (s["run"] > 0) & (s["last"] >= 100) & ~s["zero"]
        return d(s["high"] + s["mid"] + s["low"] + F.when(short, s["run"] * s["last"] / 10).otherwise(s["run"]))

    return F.when(bare.rlike(f"^{NUMERAL}$"), F.aggregate(chars, start, step, total))


def amounts(text: Column, currency: str = "元|圆|块|人民币") -> Column:
    """The amounts of a text: numerals before a currency, or after `人民币`, as an array in order. A numeral without either is
    no amount; null and empty texts have none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?:人民币\s*+({NUMERAL})|({NUMERAL})\s*+(?:{currency}))"), F.lit(0))
    return F.filter(F.transform(found, lambda m: numeral(F.regexp_extract(m, NUMERAL, 0))), lambda v: v.isNotNull())


def months(text: Column) -> Column:
    """The first term of a text in months: years, years and a half, months, or both (`两年零三个月`, `一年半`, `18个月`); null
    where there is none. Calendar years such as `2026年` and days are no terms."""
    pattern = rf"(?:(?<![0-9〇零一二])(?!(?:[12][0-9]{{3}}|[一二][零〇九八][零〇一二三四五六七八九]{{2}})\s*+年)({NUMERAL})\s*+年(?![度份初底末内])(半)?(?:[零又]?\s*+({NUMERAL})\s*+个月)?|({NUMERAL})\s*+个月)"
    part = [F.regexp_extract(text, pattern, k) for k in range(1, 5)]
    read = [F.coalesce(numeral(F.nullif(p, F.lit(""))), F.lit(0)) for p in (part[0], part[2], part[3])]
    value = F.when(part[3] != "", read[2]).when(part[0] != "", read[0] * 12 + F.when(part[1] != "", 6).otherwise(0) + read[1])
    return value.cast("int")
