"""Column functions on hand-made rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import access, dates, free_text, visits
from kelpie.functions.text import entities_decoded, search_match, upper_each
from kelpie.functions.unicode import search_folded, without_marks


def values(spark, column, rows: list):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v string").orderBy("k").select(column).collect()]


def test_folding(spark):
    assert values(spark, without_marks(F.col("v")), ["Bogotá", "SEÑAL", None, "ṩ한국", ""]) == ["Bogota", "SENAL", None, "s한국", ""]
    assert values(spark, search_folded(F.col("v")), ["ＩＴＳ配套１２", "Ｃafé", None]) == ["its配套12", "cafe", None]


def test_upper_case_of_one_character_each(spark):
    texts = ["maß ﬁn", "ᾼᾳ ŉ ΐß", "Straße éσς", "abc", "", None]
    assert values(spark, upper_each(F.col("v")), texts) == ["MAẞ ﬁN", "ᾼᾼ ŉ ΐẞ", "STRAẞE ÉΣΣ", "ABC", "", None]
    assert values(spark, free_text.word_haystack(F.col("v")), ["groß, maß"]) == [" GROẞ MAẞ "]


def test_search_words(spark):
    texts = ["send an E-mail now", "a,b", "Línea de Metro", "metropolis", None]
    assert values(spark, search_match(F.col("v"), "e-mail"), texts) == [True, False, False, False, False]
    assert values(spark, search_match(F.col("v"), "LINEA metro"), texts) == [False, False, True, False, False]
    assert values(spark, search_match(F.col("v"), "subway", {"subway": ["metro"]}), texts) == [False, False, True, False, False]
    assert values(spark, search_match(F.col("v"), "  "), texts) == [True] * 5


def test_figures(spark):
    raw = ["26.601.440,65", "26,601,440.65", "3,2", "1.04", "1,234", "1.234.567", "0", "x", None]
    assert values(spark, free_text.figure(F.col("v")), raw) == [26601440.65, 26601440.65, 3.2, 1.04, 1234.0, 1234567.0, None, None, None]


def test_calendar(spark):
    days = ["2024-03-29", "2024-12-25", "2024-12-24", "2027-01-01", "2024-05-01"]
    assert values(spark, dates.is_holiday(F.col("v").cast("date")), days) == [True, True, False, True, True]
    assert [str(x) for x in values(spark, dates.quiet_until(F.col("v").cast("date")), days)] == ["2024-03-31", "2024-12-25", "None", "2027-01-03", "2024-05-01"]
    assert [str(x) for x in values(spark, dates.week_of_slug(F.col("v")), ["2020-W53", "2021-W53", "2024-W01", "x"])] == ["2020-12-28", "None", "2024-01-01", "None"]
    assert [str(x) for x in values(spark, dates.source_date(F.col("v")), ["31/12/2024 10:00", "20240229", "30-02-2024", ""])] == ["2024-12-31", "2024-02-29", "None", "None"]


def test_visits_and_access(spark):
    agents = ["Mozilla/5.0 (Windows NT 10.0) Chrome/1 Safari/1 OPR/9", "curl", None, "x (Linux; Android 14; HarmonyOS)", "Mozilla (iPhone) FxiOS/3 Safari/1"]
    assert values(spark, visits.device(F.col("v")), agents) == ["Windows, Opera", "unknown", "unknown", "Android", "iOS, Firefox"]
    hosts = ["Blog.Example.com", "my.blog.example.com.", "notexample.com", "example.com", None, "ask.search.example.org", ""]
    assert values(spark, visits.channel_of_host(F.col("v")), hosts) == ["press", "press", None, "partner", None, "assistant", None]
    paths = ["/board/archive/3?x=/en", "/board", "/boards/1", None, "//", "/en/terms#a", "/" + "x" * 60]
    assert values(spark, visits.landing_group(F.col("v")), paths) == ["archive", "board", "/boards/1", "front", "front", "terms", "/" + "x" * 31]
    source = visits.traffic_source(F.lit(True), F.when(F.col("v") == "tag", " ALERT"), F.when(F.col("v") == "host", "else.org"), F.when(F.col("v") == "app", "app"))
    assert values(spark, source, ["tag", "host", "app", "none"]) == ["mailing", "referral", "app", "direct"]
    day = access.release_day(F.lit("suspended"), F.lit("2024-01-01").cast("date"), F.lit(None).cast("date"), F.lit(None).cast("date"))
    assert values(spark, day, ["x"]) == [None]


def test_entities(spark):
    raw = ["a &amp;lt; b", "&eacute;&Ntilde;&#233;&#xE9;&#x1F642;", "&nope; & &; &#0; &#xD800; &#x110000;", None, "", "R&D &ldquo;x&rdquo; &euro;5"]
    assert values(spark, entities_decoded(F.col("v")), raw) == ["a &lt; b", "éÑéé🙂", "&nope; & &; &#0; &#xD800; &#x110000;", None, "", "R&D “x” €5"]
