"""Queries of the text, calendar and money functions and of the source lists. Texts are written from columns, so that the SQL
can tell from those columns what a reader of the text must find."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import dates, free_text, money, sources
from kelpie.functions.text import fold_accents, html_text, locale_number
from kelpie.functions.unicode import without_marks
from kelpie.plans import notices as base
from kelpie.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _pick(by, values):
    out = F.when(by == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(by == k, v)
    return out


def _orders(spark, d):
    return table(spark, d, "orders"), F.col("o_orderkey")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN 'none' WHEN 3 THEN 'ambiguous' WHEN 4 THEN 'none' ELSE 'one' END AS kind, CASE o_orderkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'USD' WHEN 5 THEN 'PEN' END AS currency,
CASE o_orderkey % 6 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN (o_orderkey % 90 + 1.5) * 1000000 WHEN 5 THEN 12345678.0 + 1000000 * (o_orderkey % 7) END AS value FROM orders""")
def amounts_in_summary(spark, d):
    """Sums of money in sentences: marks before and after, units, dots and commas in either role, figures that are no budget."""
    o, k = _orders(spark, d)
    text = _pick(k % 6, [
        F.concat(F.lit("Budget USD "), F.format_number("o_totalprice", 2), F.lit(" for the works")), F.concat(F.lit("a total of "), (k % 90 + 1).cast("string"), F.lit(",5 million dollars in all")),
        F.lit("a guarantee of USD 5000 is asked for"), F.lit("between USD 100 and EUR 200"), F.lit("model BR381 with 22 poles"), F.concat(F.lit("value of "), (k % 7 + 12).cast("string"), F.lit(".345.678 soles")),
    ])
    return o.select("o_orderkey", free_text.one_amount(text).alias("a")).select("o_orderkey", "a.kind", "a.currency", "a.value")


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN o_orderkey % 60 + 1 WHEN 1 THEN 24 WHEN 2 THEN 36 ELSE NULL END AS INTEGER) AS months FROM orders""")
def contract_terms(spark, d):
    o, k = _orders(spark, d)
    text = _pick(k % 5, [F.concat(F.lit("for a term of "), (k % 60 + 1).cast("string"), F.lit(" months")), F.lit("a contract of two years and a period of 6 months"), F.lit("a period of one year, later a duration of 3 years"), F.lit("experience of ten years"), F.lit(None).cast("string")])
    return o.select("o_orderkey", free_text.contract_months(text).cast("int").alias("months"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 400 + 1 END AS INTEGER) AS days, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 50 + 10) + 0.5 END AS km FROM orders""")
def anchored_durations(spark, d):
    o, k = _orders(spark, d)
    days = F.when(k % 3 == 0, F.concat(F.lit("finish within "), (k % 400 + 1).cast("string"), F.lit(" days. "))).otherwise("90 days of warranty. ")
    text = F.concat(days, F.when(k % 2 == 0, F.concat(F.lit("roads of 3 km and "), (k % 50 + 10).cast("string"), F.lit(".5 km long"))).otherwise("no road"))
    return o.select("o_orderkey", free_text.anchored_days(text).alias("days"), free_text.longest_km(text).alias("km"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'constructionof' || regexp_replace(lower(p_name || p_type), '[^a-z0-9]+', '', 'g') || 'plant' END AS title_key, 'Line ' || p_name AS bare FROM part""")
def title_keys(spark, d):
    """Rounds of one notice have one key, short titles none; a phase in a title's tail goes."""
    k = F.col("p_partkey")
    title = F.when(k % 3 == 0, "Short (repeated)").when(k % 3 == 1, F.concat(F.lit("Construction of "), "p_name", F.lit(" "), "p_type", F.lit(" plant - second call"))).otherwise(F.concat(F.lit("Re-issue of Constrúction of "), "p_name", F.lit(", "), "p_type", F.lit(": plant")))
    tail = _pick(k % 3, [F.lit(" - phase 2"), F.lit(" (Stage II)"), F.lit("")])
    return table(spark, d, "part").select("p_partkey", free_text.title_key(title).alias("title_key"), free_text.without_phase(F.concat(F.lit("Line "), "p_name", tail)).alias("bare"))


@query(r"""SELECT doc_id, ' ' || trim(regexp_replace(upper(substr(text, 1, 60)), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS haystack FROM documents WHERE lang = 'en'""")
def word_haystacks(spark, d):
    """Heads of texts as words between blanks: a head is what titles are, so the limit is the feature."""
    return table(spark, d, "documents").filter("lang = 'en'").select("doc_id", free_text.word_haystack(F.substring("text", 1, 60)).alias("haystack"))


@query('''SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN '"a, ' || o_orderpriority || '"' WHEN 2 THEN '"say ""yes"""' ELSE '' END AS field FROM orders''')
def csv_fields(spark, d):
    o, k = _orders(spark, d)
    raw = _pick(k % 4, [F.col("o_orderpriority"), F.concat(F.lit("a, "), "o_orderpriority"), F.lit('say "yes"'), F.lit(None).cast("string")])
    return o.select("o_orderkey", free_text.csv_field(raw).alias("field"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Line,Metro' ELSE '' END AS runs, s_suppkey % 3 = 0 AS leaks, CASE s_suppkey % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'far north' WHEN 2 THEN 'coast' END AS region FROM supplier""")
def title_checks(spark, d):
    """Latin runs in another script, procurement codes, and the longest region name in a title."""
    k = F.col("s_suppkey")
    script = F.when(k % 2 == 0, "地铁 Line 3 与 Metro 站").otherwise("地铁三号线 abc")
    code = F.when(k % 3 == 0, "works CFE-0001-CAAAT-2026").otherwise("works A-1 and 2026-01")
    place = _pick(k % 4, [F.lit("Obras en Norte"), F.lit("Obras en Alto Norte"), F.lit("La Costa"), F.lit("elsewhere")])
    regions = {"Norte": "north", "Alto Norte": "far north", "Costa": "coast"}
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(free_text.latin_runs(script), ",").alias("runs"), free_text.leaks_identifier(code).alias("leaks"), free_text.named_region(place, regions).alias("region"))


@query(r"""SELECT conv_id, turn, CAST(3 * least(4, len(regexp_extract_all(lower(coalesce(text, '')), '\bthe\b'))) + 3 * least(4, len(regexp_extract_all(lower(coalesce(text, '')), '\bthat\b'))) + least(4, len(regexp_extract_all(lower(coalesce(text, '')), '\band\b'))) AS INTEGER) AS score,
CASE WHEN length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) < 50 THEN 'scan' WHEN role = 'user' THEN 'annex' ELSE 'other' END AS kind FROM conversations""")
def page_scores(spark, d):
    """Pages by the words that count, strong and weak, and the kind of the document by its name and text layer."""
    name = F.when(F.col("role") == "user", "Anexo 1.pdf").otherwise("file.pdf")
    return table(spark, d, "conversations").select("conv_id", "turn", free_text.page_score(F.col("text"), ["the", "that"], ["and"]).cast("int").alias("score"), free_text.document_type(name, F.col("text")).alias("kind"))


@query("""SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def repaired_json(spark, d):
    """Answers with fences, words around them and trailing commas are read all the same."""
    e = F.col("event_id")
    body = F.regexp_replace("props", r"\}$", ",}")
    said = _pick(e % 3, [F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```")), F.concat(body, F.lit(" hope it helps")), F.lit("no answer")])
    return table(spark, d, "events").select("event_id", F.get_json_object(free_text.repaired_json(said), "$.k").cast("long").alias("k"))


_EASTER = "MAKE_DATE(y, CAST((h + l - 7 * m + 114) // 31 AS INTEGER), CAST((h + l - 7 * m + 114) % 31 + 1 AS INTEGER))"


@query(f"""WITH y0 AS (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y FROM orders UNION SELECT max(CAST(year(o_orderdate) AS BIGINT)) + 1 FROM orders), y1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y0), y2 AS (SELECT *, b // 4 AS d, b % 4 AS e, (b + 8) // 25 AS f FROM y1), y3 AS (SELECT *, (b - f + 1) // 3 AS g FROM y2),
y4 AS (SELECT *, (19 * a + b - d - g + 15) % 30 AS h, c // 4 AS i, c % 4 AS k FROM y3), y5 AS (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l FROM y4), y6 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM y5), easter AS (SELECT y, {_EASTER} - 2 AS friday FROM y6),
days AS (SELECT CAST(unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders) + INTERVAL 20 DAY, INTERVAL 1 DAY)) AS DATE) AS day), q AS (SELECT day, (isodow(day) > 5 OR strftime(day, '%m-%d') IN ('01-01', '05-01', '12-25') OR day IN (SELECT friday FROM easter)) AS quiet FROM days),
w AS (SELECT day, quiet, min(CASE WHEN NOT quiet THEN day END) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS work FROM q), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT strftime(o.day, '%Y-%m-%d') AS day, strftime(CASE WHEN quiet THEN work - 1 END, '%Y-%m-%d') AS quiet_until FROM o JOIN w USING (day)""")
def quiet_days(spark, d):
    """Weekends and holidays, Good Friday among them, and how long a run of them lasts."""
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format(dates.quiet_until(F.col("day")), "yyyy-MM-dd").alias("quiet_until"))


@query("""SELECT o_orderkey, strftime(CAST(date_trunc('week', o_orderdate) AS DATE), '%Y-%m-%d') AS monday, strftime(date_trunc('week', o_orderdate) - INTERVAL 21 DAY, '%G-W%V') AS earlier, CASE WHEN o_orderkey % 5 = 0 THEN '__no_date__' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS bucket FROM orders""")
def week_slugs(spark, d):
    o, k = _orders(spark, d)
    slug = dates.iso_week(F.col("o_orderdate").cast("date"))
    raw = F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).otherwise("")
    return o.select("o_orderkey", F.date_format(dates.week_of_slug(slug), "yyyy-MM-dd").alias("monday"), dates.shifted_week(slug, -3).alias("earlier"), dates.day_bucket(raw).alias("bucket"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') END AS swapped,
strftime(CASE WHEN day(o_orderdate) >= 4 THEN date_trunc('month', o_orderdate) + INTERVAL 3 DAY ELSE date_trunc('month', o_orderdate - INTERVAL 1 MONTH) + INTERVAL 3 DAY END, '%Y-%m-%d') AS cycle FROM orders""")
def source_dates(spark, d):
    """Days as sources write them; day and month exchanged where that is a date; the start of the billing cycle."""
    o, k = _orders(spark, d)
    day = F.col("o_orderdate").cast("date")
    raw = _pick(k % 6, [F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "dd-MM-yyyy"), F.date_format(day, "yyyyMMdd"), F.concat(F.date_format(day, "dd/MM/yyyy"), F.lit(" 10:30:00")), F.lit("soon")])
    out = (("day", dates.source_date(raw)), ("swapped", dates.swapped_day_month(day)), ("cycle", dates.billing_cycle_start(day)))
    return o.select("o_orderkey", *[F.date_format(c, "yyyy-MM-dd").alias(n) for n, c in out])


@query("""WITH w AS (SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Mexico_City' AS TIMESTAMP) AS wall, CASE user_id % 3 WHEN 0 THEN 'weekly' WHEN 1 THEN 'daily' ELSE 'each' END AS cadence FROM events), s AS (SELECT *, CASE hour(wall) WHEN 8 THEN 'morning' WHEN 17 THEN 'evening' END AS slot FROM w)
SELECT event_id, strftime(wall, '%Y-%m-%d') AS day, slot, CAST(CASE WHEN cadence = 'weekly' AND slot = 'morning' AND isodow(wall) = 1 THEN 168 WHEN cadence = 'daily' AND slot = 'morning' THEN 24 WHEN cadence = 'each' AND slot = 'morning' THEN 15 WHEN cadence = 'each' AND slot = 'evening' THEN 9 END AS INTEGER) AS hours FROM s""")
def digest_windows(spark, d):
    """The local day, the slot of the hour, and how far back each recipient's mail reaches."""
    cadence = F.when(F.col("user_id") % 3 == 0, "weekly").when(F.col("user_id") % 3 == 1, "daily").otherwise("each")
    slot, wall = dates.digest_slot(F.col("ts")), dates.local_time(F.col("ts"))
    iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, d, "events").select("event_id", F.date_format(dates.day_of_text(iso), "yyyy-MM-dd").alias("day"), slot.alias("slot"), dates.digest_hours(slot, cadence, F.dayofweek(wall) == 2).cast("int").alias("hours"))


_RATE = 66.0


@query(f"""SELECT o_orderkey, CASE o_orderpriority WHEN '2-HIGH' THEN 100 * {_RATE} WHEN '3-MEDIUM' THEN 1000 * {_RATE} END AS low, CASE o_orderpriority WHEN '1-URGENT' THEN 100 * {_RATE} WHEN '2-HIGH' THEN 1000 * {_RATE} END AS high,
CASE o_orderstatus WHEN 'O' THEN round(o_totalprice * 0.5, 4) WHEN 'F' THEN round(o_totalprice * 0.02, 4) END AS base FROM orders""")
def bands_and_rates(spark, d):
    """Bands in units of account for notices without an amount; amounts at fixed rates, null in an unknown currency."""
    o, _ = _orders(spark, d)
    band = money.unit_band(F.col("o_orderpriority"), {"1-URGENT": (None, 100), "2-HIGH": (100, 1000), "3-MEDIUM": (1000, None)}, _RATE)
    return o.select("o_orderkey", band["low"].alias("low"), band["high"].alias("high"), F.round(money.exchanged(F.col("o_totalprice"), F.col("o_orderstatus"), {"O": 0.5, "F": 0.02}), 4).alias("base"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN CAST(floor(o_totalprice) AS DECIMAL(20, 2)) ELSE CAST(o_totalprice AS DECIMAL(20, 2)) END::DOUBLE AS value FROM orders""")
def locale_numbers(spark, d):
    """One number as four countries write it."""
    o, k = _orders(spark, d)
    us = F.format_number("o_totalprice", 2)
    raw = _pick(k % 4, [us, F.translate(us, ",.", ".,"), F.concat(F.lit("$ "), F.translate(us, ",", " ")), F.format_number(F.floor("o_totalprice"), 0)])
    return o.select("o_orderkey", locale_number(raw).cast("double").alias("value"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text,
regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages""")
def page_texts(spark, d):
    return table(spark, d, "pages").select("page_id", html_text(F.col("html")).alias("text"), F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"))


@query("""SELECT page_id, CAST(position AS INTEGER) AS position, item FROM (SELECT page_id, unnest(l) AS item, generate_subscripts(l, 1) - 1 AS position FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li>(.*?)</li>', 1) AS l FROM pages))""")
def page_items(spark, d):
    """The items of a page's lists as rows."""
    return table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<li>(.*?)</li>"), F.lit(1))).alias("position", "item"))


@query("SELECT page_id, strip_accents(url) AS folded FROM pages")
def folded_urls(spark, d):
    return table(spark, d, "pages").select("page_id", fold_accents(F.col("url")).alias("folded"))


@query("SELECT conv_id, turn, strip_accents(text) AS bare FROM conversations")
def marks_removed(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", without_marks("text").alias("bare"))


def _m(name: str) -> str:
    return f"regexp_matches(lower(p_name || ' ' || p_type), '{sources.WORDS[name]}')"


_AMOUNT = "CASE WHEN v < 20000 THEN 'excluded' WHEN v >= 400000 THEN 'flagship' WHEN v >= 200000 THEN 'significant' ELSE 'standard' END"
_RULES = {
    "auction": "'significant'",
    "grid_utility": f"CASE WHEN {_m('routine')} THEN 'excluded' WHEN {_m('service')} AND NOT {_m('build')} THEN 'excluded' WHEN NOT {_m('target')} THEN 'excluded' WHEN {_m('major')} THEN 'significant' ELSE 'standard' END",
    "state_utility": f"CASE kind WHEN 'service' THEN 'excluded' WHEN 'works' THEN CASE WHEN {_m('major')} AND abroad THEN 'significant' WHEN {_m('major')} OR abroad THEN 'standard' ELSE 'excluded' END WHEN 'goods' THEN CASE WHEN CASE WHEN abroad THEN {_m('equipment')} ELSE {_m('major')} END THEN 'standard' ELSE 'excluded' END ELSE 'excluded' END",
    "concession": f"CASE WHEN NOT {_m('build')} THEN 'excluded' WHEN v IS NULL THEN 'significant' ELSE {_AMOUNT} END",
    "mining_company": f"CASE WHEN NOT {_m('target')} THEN 'excluded' WHEN {_m('service')} AND NOT {_m('build')} THEN 'excluded' WHEN abroad AND NOT {_m('service')} THEN 'significant' ELSE 'standard' END",
    "equipment_auction": f"CASE WHEN NOT {_m('equipment')} OR v IS NULL THEN 'excluded' ELSE {_AMOUNT} END",
    "small_state": f"CASE WHEN NOT {_m('target')} OR {_m('service')} THEN 'excluded' WHEN abroad AND {_m('major')} THEN 'flagship' WHEN abroad OR v >= 400000 THEN 'significant' ELSE 'excluded' END",
    "metro": f"CASE WHEN NOT coalesce(v >= 200000, false) THEN 'excluded' WHEN {_m('build')} THEN 'flagship' ELSE 'significant' END",
    "oil_company": f"CASE kind WHEN 'lease' THEN CASE WHEN {_m('major')} THEN 'significant' ELSE 'excluded' END WHEN 'works' THEN CASE WHEN {_m('major')} THEN 'flagship' WHEN {_m('routine')} THEN 'excluded' WHEN abroad THEN 'significant' ELSE 'excluded' END WHEN 'service' THEN CASE WHEN {_m('build')} THEN 'standard' ELSE 'excluded' END WHEN 'goods' THEN CASE WHEN {_m('equipment')} OR abroad THEN 'standard' ELSE 'excluded' END ELSE 'excluded' END",
    "oil_portal": f"CASE WHEN {_m('routine')} OR kind = 'other' OR (kind = 'service' AND NOT {_m('target')}) THEN 'excluded' WHEN kind = 'works' AND {_m('major')} THEN 'flagship' WHEN abroad THEN 'significant' ELSE 'standard' END",
    "refinery": f"CASE WHEN NOT {_m('target')} OR ({_m('service')} AND NOT {_m('build')}) THEN 'excluded' ELSE 'significant' END",
    "goods_auction": f"CASE WHEN NOT {_m('equipment')} THEN 'excluded' WHEN v IS NULL THEN CASE WHEN renewable THEN 'standard' ELSE 'excluded' END WHEN v < CASE WHEN renewable THEN 20000 ELSE 50000 END THEN 'excluded' WHEN v >= 400000 THEN 'flagship' WHEN v >= 200000 THEN 'significant' ELSE 'standard' END",
    "loan_notice": f"CASE WHEN ({_m('routine')} AND NOT {_m('build')}) OR {_m('service')} THEN 'excluded' WHEN abroad AND {_m('major')} THEN 'flagship' WHEN abroad THEN 'significant' ELSE 'excluded' END",
}
_SOURCES = " UNION ALL ".join(f"SELECT '{n}' AS source, {r} AS tier FROM r" for n, r in _RULES.items())


@query(f"""WITH r AS (SELECT *, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice * (p_partkey % 500) END AS v, CASE p_partkey % 5 WHEN 0 THEN 'works' WHEN 1 THEN 'goods' WHEN 2 THEN 'service' WHEN 3 THEN 'lease' ELSE 'other' END AS kind, p_size % 2 = 0 AS abroad, p_size % 3 = 0 AS renewable FROM part)
SELECT source, tier, count(*) AS n FROM ({_SOURCES}) GROUP BY 1, 2""")
def source_tiers(spark, d):
    """The list of every source over the same rows, in one pass."""
    k, text = F.col("p_partkey"), F.concat("p_name", F.lit(" "), "p_type")
    v, kind, abroad, renewable = F.when(k % 7 != 0, F.col("p_retailprice") * (k % 500)), _pick(k % 5, [F.lit(x) for x in ("works", "goods", "service", "lease", "other")]), F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0
    tiers = {
        "auction": sources.auction(text), "grid_utility": sources.grid_utility(text), "state_utility": sources.state_utility(text, kind, abroad), "concession": sources.concession(text, v), "mining_company": sources.mining_company(text, abroad),
        "equipment_auction": sources.equipment_auction(text, v), "small_state": sources.small_state(text, abroad, v), "metro": sources.metro(text, v), "oil_company": sources.oil_company(text, kind, abroad), "oil_portal": sources.oil_portal(text, kind, abroad),
        "refinery": sources.refinery(text), "goods_auction": sources.goods_auction(text, v, renewable), "loan_notice": sources.loan_notice(text, abroad),
    }
    each = table(spark, d, "part").select(F.explode(F.array(*[F.struct(F.lit(n).alias("source"), t.alias("tier")) for n, t in tiers.items()])).alias("x"))
    return each.groupBy("x.source", "x.tier").agg(F.count("*").alias("n"))


@query(f"""SELECT o_orderkey, strftime(CAST((o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/Mexico_City' AS DATE), '%Y-%m-%d') AS day FROM orders WHERE o_orderdate < DATE '{base.TODAY}'""")
def platform_days(spark, d):
    """Instants become local days, bare days stay as they are."""
    o, _ = _orders(spark, d)
    return o.filter(F.col("o_orderdate") < F.lit(base.TODAY).cast("timestamp_ntz")).select("o_orderkey", F.date_format(dates.local_day(F.col("o_orderdate")), "yyyy-MM-dd").alias("day"))
