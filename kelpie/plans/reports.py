"""Reports and order-dependent summaries over the board and the event log."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.functions.rules import first_match
from kelpie.operators import reports as ops
from kelpie.operators.events import top_values
from kelpie.plans import board
from kelpie.plans.board import _B, _board, _live, _today
from kelpie.session import table

QUERIES, ORACLE = {}, {}
_T = board._T


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query("""WITH f AS (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 9 AS v, min(event_id) AS e FROM events GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY e) AS r FROM f)
SELECT user_id, event_type, string_agg(CAST(v AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r <= 4) AS firsts, count(*) AS n FROM r GROUP BY 1, 2""")
def first_values(spark, d):
    """The first four distinct values of each user and kind, in order of appearance, and how many there are."""
    value = F.get_json_object("props", "$.k").cast("long") % 9
    return ops.first_distinct(table(spark, d, "events").withColumn("v", value), ["user_id", "event_type"], "v", "event_id", 4)


@query(f"""WITH {_B}, c AS (SELECT x.industry, strftime(pub, '%Y-%m') AS month, count(*) AS n FROM b, LATERAL (SELECT unnest(industries) AS industry) x WHERE tier <> 'excluded' GROUP BY 1, 2) SELECT industry, month, n FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY month DESC) AS r FROM c) WHERE r <= 12""")
def industry_months(spark, d):
    """The latest twelve months of each industry."""
    rows = _board(spark, d).filter("tier <> 'excluded'").select(F.explode("industries").alias("industry"), F.date_format("pub", "yyyy-MM").alias("month"))
    counted = rows.groupBy("industry", "month").agg(F.count("*").alias("n"))
    return counted.withColumn("r", F.row_number().over(W.partitionBy("industry").orderBy(F.desc("month")))).filter("r <= 12").drop("r")


@query(f"WITH {_B} SELECT x.industry, country, count(*) AS n FROM b, LATERAL (SELECT unnest(industries) AS industry) x WHERE status IN ('open', 'clarification') AND tier <> 'excluded' GROUP BY 1, 2")
def industry_countries_live(spark, d):
    return _live(_board(spark, d)).select(F.explode("industries").alias("industry"), "country").groupBy("industry", "country").agg(F.count("*").alias("n"))


_WHY = "CASE WHEN value IS NULL THEN 'no amount' WHEN value >= 400000 THEN 'amount' WHEN list_contains(industries, 'power') THEN 'energy' WHEN deadline IS NULL THEN 'open end' ELSE 'default' END"


def _why():
    return first_match([("no amount", F.col("value").isNull()), ("amount", F.col("value") >= 400_000), ("energy", F.array_contains("industries", "power")), ("open end", F.col("deadline").isNull())], "default")


@query(f"""WITH {_B}, w AS (SELECT *, {_WHY} AS why FROM b WHERE tier <> 'excluded'), c AS (SELECT why, country, count(*) AS n FROM w GROUP BY 1, 2), k AS (SELECT why, CAST(sum(n) AS BIGINT) AS n, string_agg(country || ':' || n, ',' ORDER BY n DESC, country) AS countries FROM c GROUP BY 1), e AS (SELECT why, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) AS examples FROM (SELECT why, id, row_number() OVER (PARTITION BY why ORDER BY id) AS r FROM w) WHERE r <= 3 GROUP BY 1)
SELECT why, n, countries, examples FROM k JOIN e USING (why)""")
def explain_kept(spark, d):
    """Kept rows by the first rule that holds: how many, of which countries, and three examples."""
    return ops.explained(_board(spark, d).filter("tier <> 'excluded'").withColumn("why", _why()), "why", "country", "id", 3)


@query("""SELECT l_orderkey, CAST(sum(CASE WHEN l_discount > 0 THEN CAST(l_extendedprice AS DECIMAL(20, 2)) END) AS DOUBLE) AS total, count(*) FILTER (WHERE l_discount = 0) AS sealed, count(*) AS items FROM lineitem GROUP BY 1""")
def item_sums(spark, d):
    """Item values added up; sealed items have none and are counted."""
    shown = F.when(F.col("l_discount") > 0, F.col("l_extendedprice").cast("decimal(20,2)"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(shown).cast("double").alias("total"), F.count_if(F.col("l_discount") == 0).alias("sealed"), F.count("*").alias("items"))


@query(f"""WITH {_B}, p AS (SELECT tier, scope, {_WHY} AS why FROM b), l AS (SELECT 'tier' AS part, tier AS value FROM p UNION ALL SELECT 'scope', scope FROM p UNION ALL SELECT 'why', why FROM p) SELECT part, value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM p), 2) AS percent FROM l GROUP BY 1, 2""")
def classification_preview(spark, d):
    """Shares of tiers, scopes and reasons, in one pass."""
    rows = _board(spark, d).withColumn("why", _why())
    return ops.shares(rows, ["tier", "scope", "why"])


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag || '|' || l_linestatus AS item, l_suppkey, l_partkey, l_extendedprice FROM lineitem), u AS (SELECT l_orderkey, item, min(struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := l_extendedprice)) AS f FROM r GROUP BY 1, 2) SELECT l_orderkey, string_agg(item, ',' ORDER BY f) AS items FROM u GROUP BY 1""")
def merged_extractions(spark, d):
    """Items of several extractions in one list; those alike in title and description count once, the first one's place."""
    lines = table(spark, d, "lineitem")
    parts = lines.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("text"))).alias("found"))
    merged = ops.merged_lists(parts, "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "found")
    return merged.select("l_orderkey", F.array_join(F.transform("found", lambda x: F.concat_ws("|", x["title"], x["text"])), ",").alias("items"))


@query(f"""WITH {_B}, w AS (SELECT strftime(pub, '%G-W%V') AS week, industries FROM b WHERE tier <> 'excluded'), wk AS (SELECT week, count(*) AS n FROM w GROUP BY 1), ind AS (SELECT week, x.industry, count(*) AS c FROM w, LATERAL (SELECT unnest(industries) AS industry) x GROUP BY 1, 2), t AS (SELECT week, string_agg(industry, ',' ORDER BY r) AS top_values FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY c DESC, industry) AS r FROM ind) WHERE r <= 3 GROUP BY 1)
SELECT week, n, top_values FROM wk JOIN t USING (week) ORDER BY week DESC LIMIT 26""")
def weekly_archive(spark, d):
    """The last 26 weeks with their three main industries: half a year is the feature."""
    from kelpie.functions.dates import iso_week

    rows = _board(spark, d).filter("tier <> 'excluded'").select(iso_week(F.col("pub")).alias("week"), "industries")
    tops = top_values(rows.select("week", F.explode("industries").alias("industry")), ["week"], "industry", 3)
    return rows.groupBy("week").agg(F.count("*").alias("n")).join(tops, "week").orderBy(F.desc("week")).limit(26)


@query("""WITH p AS (SELECT l_orderkey, lower(trim(spelt)) AS k, spelt AS s_name, l_linenumber, l_partkey, l_shipdate, l_returnflag, l_extendedprice FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN upper(s.s_name) ELSE s.s_name END AS spelt FROM lineitem JOIN (SELECT s_suppkey, s_name FROM supplier) s ON s.s_suppkey = l_suppkey)),
f AS (SELECT l_orderkey, k, min(struct_pack(a := l_linenumber, b := l_partkey, n := s_name)) AS first FROM p GROUP BY 1, 2), n AS (SELECT l_orderkey, string_agg(first.n, ',' ORDER BY first) AS suppliers FROM f GROUP BY 1),
g AS (SELECT l_orderkey, strftime(max(l_shipdate), '%Y-%m-%d') AS awarded, CASE WHEN count(DISTINCT l_returnflag) <= 1 THEN CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 2))) AS DOUBLE) END AS amount FROM p GROUP BY 1) SELECT l_orderkey, suppliers, awarded, amount FROM n JOIN g USING (l_orderkey)""")
def award_suppliers(spark, d):
    """The suppliers of an award by first spelling and place, the last day, the amount of one currency."""
    names = table(spark, d, "supplier").select("s_suppkey", "s_name")
    parts = table(spark, d, "lineitem").join(names, F.col("l_suppkey") == F.col("s_suppkey"))
    parts = parts.withColumn("s_name", F.when(F.col("l_linenumber") % 2 == 0, F.upper("s_name")).otherwise(F.col("s_name")))
    return ops.awards(parts, "l_orderkey", "s_name", ["l_linenumber", "l_partkey"], "l_extendedprice", "l_returnflag", "l_shipdate").select("l_orderkey", F.array_join("suppliers", ",").alias("suppliers"), F.date_format("awarded", "yyyy-MM-dd").alias("awarded"), "amount")


@query(f"""WITH {_B}, v AS (SELECT DISTINCT x.industry FROM b, LATERAL (SELECT unnest(industries) AS industry) x WHERE status = 'open' AND tier <> 'excluded') SELECT v.industry, CAST(pos AS INTEGER) AS pos FROM v JOIN (SELECT unnest(['roads', 'power', 'water', 'general']) AS industry, generate_subscripts(['roads', 'power', 'water', 'general'], 1) - 1 AS pos) USING (industry)""")
def facet_availability(spark, d):
    """The values that a visible row has, in the order in which they are always shown."""
    return ops.available(_live(_board(spark, d)).select(F.explode("industries").alias("industry")), "industry", board.INDUSTRIES)


_SESSIONS = """m AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE, false) AS fresh FROM events), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m)"""


def _sessions(spark, d):
    from kelpie.operators.events import sessionize

    return sessionize(table(spark, d, "events"), "user_id", "ts", 30)


@query(f"""WITH {_SESSIONS} SELECT user_id, CAST(session AS BIGINT) AS session, arg_min(event_id, (ts, event_id)) AS first_event, arg_min(event_id, (ts, event_id)) FILTER (WHERE event_type = 'signup') AS entry_event FROM s GROUP BY 1, 2""")
def session_entries(spark, d):
    """The first row of each session, and its first entry row if there is one."""
    order = F.struct("ts", "event_id")
    entry = F.col("event_type") == "signup"
    return _sessions(spark, d).groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.min_by("event_id", order).alias("first_event"), F.min_by(F.when(entry, F.col("event_id")), F.when(entry, order)).alias("entry_event"))


@query(f"""WITH {_SESSIONS}, o AS (SELECT DISTINCT user_id, session FROM s WHERE user_id % 25 = 0), f AS (SELECT user_id, session, arg_min(CAST(json_extract(props, '$.k') AS BIGINT) % 4, (ts, event_id)) AS source, count(*) FILTER (WHERE event_type = 'view') AS views, bool_or(event_type = 'click') AS detail, bool_or(event_type = 'purchase') AS pricing FROM s ANTI JOIN o USING (user_id, session) GROUP BY 1, 2),
a AS (SELECT c_custkey, c_custkey % 4 AS source, c_custkey % 3 = 0 AS linked FROM customer WHERE c_custkey % 2 = 0) SELECT source, CAST(sum(v) AS BIGINT) AS visitors, CAST(sum(m) AS BIGINT) AS more, CAST(sum(dt) AS BIGINT) AS detail, CAST(sum(p) AS BIGINT) AS pricing, CAST(sum(su) AS BIGINT) AS signups, CAST(sum(ul) AS BIGINT) AS unlinked
FROM (SELECT source, 1 AS v, (views > 1)::INT AS m, detail::INT AS dt, pricing::INT AS p, 0 AS su, 0 AS ul FROM f UNION ALL SELECT source, 0, 0, 0, 0, 1, (NOT linked)::INT FROM a) GROUP BY 1""")
def acquisition_funnel(spark, d):
    """Sessions by source through the stages, own accounts' sessions left out; signups count accounts, linked or not."""
    rows = _sessions(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("long") % 4)
    stages = {"more": F.count_if(F.col("event_type") == "view") > 1, "detail": F.bool_or(F.col("event_type") == "click"), "pricing": F.bool_or(F.col("event_type") == "purchase")}
    accounts = table(spark, d, "customer").filter("c_custkey % 2 = 0").select((F.col("c_custkey") % 4).alias("source"), (F.col("c_custkey") % 3 == 0).alias("linked"))
    return ops.acquisition(rows, ["user_id", "session"], F.col("user_id") % 25 == 0, F.min_by("k", F.struct("ts", "event_id")), stages, accounts, "source", "linked")


@query("""WITH k AS (SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'O') AS n, count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag <> 'R') AS usable, min(CAST(l_shipdate AS DATE)) FILTER (WHERE l_linestatus = 'O' AND l_returnflag <> 'R') AS day FROM lineitem GROUP BY 1) SELECT l_orderkey, strftime(day, '%Y-%m-%d') AS day, CASE WHEN n = 0 THEN 'no_opening' WHEN usable = 0 THEN 'economic_only' END AS reason FROM k""")
def earliest_openings(spark, d):
    """The first opening that counts, or why there is none."""
    opening, usable = F.col("l_linestatus") == "O", F.col("l_returnflag") != "R"
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(opening).alias("n"), F.min(F.when(opening & usable, F.col("l_shipdate").cast("date"))).alias("day"))
    return rows.select("l_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), F.when(F.col("n") == 0, "no_opening").when(F.col("day").isNull(), "economic_only").alias("reason"))


@query(f"""WITH f AS (SELECT l_orderkey AS k, max(CAST(l_shipdate AS DATE)) AS day, min(l_suppkey) AS supplier, CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 2))) AS DOUBLE) AS amount, min(l_returnflag) AS currency FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS amount, CASE o_orderkey % 2 WHEN 0 THEN 'A' ELSE 'N' END AS currency, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS supplier, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS DATE) END AS day, o_orderkey % 8 = 0 AS locked FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) >= {_T} - 365 AND CAST(o_orderdate AS DATE) < {_T}),
j AS (SELECT s.*, f.k IS NOT NULL AND NOT locked AND f.day <= {_T} AS ok, f.amount AS fa, f.currency AS fc, f.supplier AS fs, f.day AS fd FROM s LEFT JOIN f ON k = o_orderkey WHERE s.amount IS NULL OR s.supplier IS NULL OR s.day IS NULL)
SELECT o_orderkey, strftime(CASE WHEN day IS NULL AND ok THEN fd ELSE day END, '%Y-%m-%d') AS day, CASE WHEN supplier IS NULL AND ok THEN CAST(fs AS VARCHAR) ELSE supplier END AS supplier, CASE WHEN amount IS NULL AND ok AND fc = currency THEN fa ELSE amount END AS amount, coalesce(amount IS NULL AND ok AND fc <> currency, false) AS mismatch FROM j""")
def award_fill_guarded(spark, d):
    """Awarded notices of the last year that lack a fact take it from results up to today; locked rows and other currencies do not."""
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_shipdate").cast("date")).alias("day"), F.min("l_suppkey").cast("string").alias("supplier"), F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).cast("double").alias("amount"), F.min("l_returnflag").alias("currency"))
    k, pub = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    stored = table(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & (pub >= F.date_sub(_today(), 365)) & (pub < _today())).select(
        "o_orderkey", F.when(k % 3 == 0, F.col("o_totalprice")).alias("amount"), F.when(k % 2 == 0, "A").otherwise("N").alias("currency"), F.when(k % 5 == 0, k.cast("string")).alias("supplier"), F.when(k % 7 == 0, pub).alias("day"), (k % 8 == 0).alias("locked")
    )
    return ops.award_filled(stored, found, "o_orderkey", _today()).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"""WITH {_B}, k AS (SELECT id, pub, id % 5 = 0 AS stored, id % 20 = 0 AS dead, country, concat_ws('|', country, o_custkey, CASE WHEN country IN ('NATION_1', 'NATION_2') THEN NULL ELSE platform END, CAST(CAST(floor(value / 50000) AS BIGINT) AS VARCHAR), strftime(date_trunc('year', pub), '%Y-%m-%d')) AS k FROM b WHERE value IS NOT NULL),
r AS (SELECT *, coalesce(bool_or(stored) OVER (PARTITION BY k), false) AS twin, row_number() OVER (PARTITION BY k, stored ORDER BY pub, id) AS r FROM k WHERE NOT (stored AND dead)) SELECT id FROM r WHERE stored OR (NOT twin AND r = 1) UNION ALL SELECT id FROM k WHERE stored AND dead UNION ALL SELECT id FROM b WHERE value IS NULL""")
def duplicate_procurement(spark, d):
    """One row of each procurement: a loose key in two countries, a strict one elsewhere; stored rows of a dead state are no twins."""
    year = F.date_format(F.trunc("pub", "year"), "yyyy-MM-dd")
    strict = F.when(~F.col("country").isin("NATION_1", "NATION_2"), F.col("platform"))
    key = F.when(F.col("value").isNotNull(), F.concat_ws("|", "country", "o_custkey", strict, F.floor(F.col("value") / 50_000).cast("string"), year))
    return ops.single_procurements(_board(spark, d), key, F.col("id") % 5 == 0, F.col("id") % 20 == 0, [F.asc("pub"), F.asc("id")]).select("id")
