"""Amounts, terms, lengths and names inside free text, by patterns in the JVM. The word lists are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpie.functions.text import folded, upper_each

#: Factors of the unit words, and the currencies of marks before or after a figure (fixed values).
UNITS = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "mil": 1e3, "millones": 1e6}
MARKS = {"us$": "USD", "usd": "USD", "dollars": "USD", "eur": "EUR", "euros": "EUR", "s/": "PEN", "soles": "PEN"}
NOT_BUDGET = r"(?:penalty|guarantee|deposit|bond)[^.;,]{0,12}$"
_FIGURE = r"[0-9](?:[0-9.,]*[0-9])?"
_UNIT = r"(?:thousand|million|billion|millones|mil)"
_MARK = r"(?:us\$|usd|dollars|eur|euros|s/|soles)"
AMOUNT = rf"[a-z ]{{0,20}}(?:{_MARK} ?{_FIGURE}(?: ?{_UNIT}\b)?|(?<![a-z0-9]){_FIGURE}(?: ?{_UNIT}\b)? ?{_MARK}(?![a-z]))"
#: Words for numbers and months that a contract's term is written with (fixed values).
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "ten": 10, "twelve": 12}


def figure(text: Column) -> Column:
    """A number with either role of dot and comma. Where both occur the later one is the decimal mark; commas alone group
    thousands where every group has three digits; so do several dots."""
    comma, dot = F.length(text) - F.locate(",", F.reverse(text)), F.length(text) - F.locate(".", F.reverse(text))
    has_comma, has_dot = F.contains(text, F.lit(",")), F.contains(text, F.lit("."))
    no_dots, no_commas = F.replace(text, F.lit("."), F.lit("")), F.replace(text, F.lit(","), F.lit(""))
    plain = (
        F.when(has_comma & has_dot, F.when(comma > dot, F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas))
        .when(has_comma, F.when(text.rlike(r"^[0-9]{1,3}(?:,[0-9]{3})+$"), no_commas).otherwise(F.replace(text, F.lit(","), F.lit("."))))
        .when(has_dot & text.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3}){2,}$"), no_dots)
        .otherwise(text)
    )
    value = plain.try_cast("double")
    return F.when(value > 0, value)


def _lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def amounts(text: Column) -> Column:
    """An array of (currency, value) of the sums of money in a text: a figure with a currency before or after it, in units.
    Figures that a word of NOT_BUDGET leads to, and figures without a currency, are left out; equal sums are one."""
    found = F.regexp_extract_all(F.lower(text), F.lit(AMOUNT), F.lit(0))

    def read(m: Column) -> Column:
        mark, number, unit = F.regexp_extract(m, _MARK, 0), F.regexp_extract(m, _FIGURE, 0), F.regexp_extract(m, rf"{_UNIT}\b", 0)
        return F.struct(_lookup(mark, MARKS).alias("currency"), F.round(figure(number) * F.coalesce(_lookup(unit, UNITS), F.lit(1.0)), 2).alias("value"))

    kept = F.filter(found, lambda m: ~F.regexp_extract(m, rf"^(.*?)(?:{_MARK}|[0-9])", 1).rlike(NOT_BUDGET))
    return F.array_distinct(F.filter(F.transform(kept, read), lambda s: s["value"].isNotNull()))


def one_amount(text: Column) -> Column:
    """(kind, currency, value): one, none or ambiguous."""
    found = amounts(text)
    n = F.size(found)
    only = F.element_at(found, 1)
    return F.struct(F.when(n == 1, "one").when(n > 1, "ambiguous").otherwise("none").alias("kind"), F.when(n == 1, only["currency"]).alias("currency"), F.when(n == 1, only["value"]).alias("value"))


def contract_months(text: Column) -> Column:
    """The longest term in months: a figure or number word before years or months that a word for a term leads to."""
    number = "|".join([r"[0-9]{1,2}", *NUMBER_WORDS])
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?:term|period|duration|contract) of (?:{number}) (?:years?|months?)"), F.lit(0))

    def months(m: Column) -> Column:
        n = F.regexp_extract(m, rf" of ({number}) ", 1)
        value = F.coalesce(n.try_cast("int"), _lookup(n, NUMBER_WORDS))
        return value * F.when(F.contains(m, F.lit("year")), 12).otherwise(1)

    return F.array_max(F.filter(F.transform(found, months), lambda x: x > 0))


def anchored_days(text: Column, anchor: str = "within") -> Column:
    """The first number of days after an anchor word."""
    return F.nullif(F.regexp_extract(F.lower(text), rf"\b{anchor} ([0-9]{{1,4}}) days?\b", 1), F.lit("")).cast("int")


def longest_km(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+(?:\.[0-9]+)?) ?km\b"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: x.cast("double")))


def title_key(title: Column, wordings: tuple[str, ...] = (r"second call", r"re-?issue of", r"\(repeated\)"), least: int = 25) -> Column:
    """What two rounds of one notice share: letters and digits without wordings of a repeat; null where it is short."""
    out = folded(title)
    for w in wordings:
        out = F.regexp_replace(out, w, " ")
    out = F.regexp_replace(out, "[^a-z0-9]+", "")
    return F.when(F.length(out) >= least, out)


def without_phase(title: Column) -> Column:
    """A title without a phase in its tail, as in `… - phase 2` or `… (stage II)`."""
    return F.trim(F.regexp_replace(title, r"(?i)[\s(-]+(?:phase|stage|lot) [0-9IVX]+\)?\s*$", ""))


def word_haystack(text: Column) -> Column:
    """Upper-cased words between single blanks, with one at either end, so that whole words are found as ` WORD `."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(upper_each(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def csv_field(text: Column) -> Column:
    """A field as RFC 4180 writes it: quoted where it holds a quote, a comma or a line break; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike("[\",\r\n]"), quoted).otherwise(text), F.lit(""))


def latin_runs(text: Column, least: int = 4) -> Column:
    """Runs of Latin letters of some length: what a text in another script should not hold."""
    return F.regexp_extract_all(text, F.lit(rf"[A-Za-z]{{{least},}}"), F.lit(0))


def leaks_identifier(text: Column) -> Column:
    """Does the text hold a procurement code: capitals and digits in three parts or more?"""
    return text.rlike(r"\b[A-Z]{2,}(?:-[A-Z0-9]+){2,}\b")


def named_region(text: Column, regions: dict[str, str]) -> Column:
    """The value of the longest region name in the text."""
    names = sorted(regions, key=lambda n: (-len(n), n))
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.contains(F.lower(text), F.lit(n.lower())), regions[n]).otherwise(out)
    return out


def page_score(text: Column, strong: list[str], weak: list[str], most: int = 4) -> Column:
    """Three points for each strong word and one for each weak one, each counted `most` times at most."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(0)
    for words, points in ((strong, 3), (weak, 1)):
        for w in words:
            out = out + points * F.least(F.lit(most), F.regexp_count(low, F.lit(rf"\b{w}\b")))
    return out


def document_type(name: Column, text: Column) -> Column:
    """scan where the text layer is thin, else by words of the name, else other."""
    low = F.lower(name)
    return F.when(F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")) < 50, "scan").when(low.rlike("annex|anexo"), "annex").when(low.rlike("terms|bases"), "terms").otherwise("other")


def repaired_json(text: Column) -> Column:
    """JSON as a model writes it, made readable: fences and words around the outer braces go, as do commas before a closing
    bracket. Null where no braces are left."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(body != "", F.regexp_replace(body, r",(\s*[}\]])", "$1"))
