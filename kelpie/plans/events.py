"""Queries over the event log: views are page views, clicks open items, purchases save and errors unsave them."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions.dates import local_day, local_time
from kelpie.operators import events as ops
from kelpie.session import table

NOW = "2024-06-30 00:00:00"
_DAY = "CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Mexico_City' AS DATE)"
_HOUR = "date_trunc('hour', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Mexico_City')"
_ITEM = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _events(spark, d):
    e = table(spark, d, "events")
    return e.withColumns({"day": local_day(F.col("ts")), "item": F.get_json_object("props", "$.k").cast("int"), "internal": F.col("user_id") % 2 == 0})


def _bounds(e):
    """The log's last instant, as a column of one row: a stand-in for the current time."""
    return e.agg(F.max("ts").alias("now"))


@query(f"""SELECT day, event_type, CASE WHEN level > 0 THEN 'all' ELSE CAST(internal AS VARCHAR) END AS scope, events, visitors FROM (
SELECT {_DAY} AS day, event_type, user_id % 2 = 0 AS internal, grouping(user_id % 2 = 0) AS level, count(*) AS events, count(DISTINCT user_id) AS visitors FROM events
GROUP BY GROUPING SETS (({_DAY}, event_type, user_id % 2 = 0), ({_DAY}, event_type)))""")
def events_daily_grouping_sets(spark, d):
    return ops.with_subtotals(_events(spark, d), ["day", "event_type"], "internal", [F.count("*").alias("events"), F.countDistinct("user_id").alias("visitors")])


@query("""SELECT count(*) FILTER (WHERE event_type = 'view') AS views, count(DISTINCT user_id) FILTER (WHERE event_type = 'view') AS viewers,
count(DISTINCT user_id) FILTER (WHERE event_type = 'signup' AND user_id % 2 = 1) AS signups, count(*) FILTER (WHERE event_type = 'purchase' AND value > 50) AS large,
sum(value) FILTER (WHERE event_type = 'purchase') AS revenue
FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY""")
def events_period_filter_agg(spark, d):
    e = _events(spark, d)
    recent = e.join(F.broadcast(_bounds(e)), F.col("ts") > F.col("now") - F.expr("interval 30 days"))
    kind = F.col("event_type")
    return recent.agg(
        F.count_if(kind == "view").alias("views"),
        F.countDistinct(F.when(kind == "view", F.col("user_id"))).alias("viewers"),
        F.countDistinct(F.when((kind == "signup") & ~F.col("internal"), F.col("user_id"))).alias("signups"),
        F.count_if((kind == "purchase") & (F.col("value") > 50)).alias("large"),
        F.sum(F.when(kind == "purchase", F.col("value"))).alias("revenue"),
    )


@query("""SELECT n_name, CASE WHEN user_id % 2 = 0 THEN 'internal' ELSE 'external' END AS scope, count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'click') AS opens
FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def events_geo_scoped(spark, d):
    people = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    joined = _events(spark, d).join(people, F.col("user_id") == F.col("c_custkey"))
    return joined.groupBy("n_name", F.when(F.col("internal"), "internal").otherwise("external").alias("scope")).agg(
        F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "click").alias("opens")
    )


@query("""SELECT k.key, CAST(json_extract_string(props, '$.' || k.key) AS INTEGER) AS value, count(*) AS uses, count(DISTINCT user_id) AS users
FROM events, LATERAL (SELECT unnest(json_keys(props)) AS key) k WHERE event_type = 'view' GROUP BY 1, 2""")
def filter_uses_lateral(spark, d):
    e = table(spark, d, "events").filter("event_type = 'view'")
    used = e.select("user_id", F.explode(F.from_json("props", "map<string,int>")).alias("key", "value"))
    return used.groupBy("key", "value").agg(F.count("*").alias("uses"), F.countDistinct("user_id").alias("users"))


@query(f"""SELECT p_brand, count(*) AS opens, count(DISTINCT user_id) AS actors, max(ts) AS last_open FROM events JOIN part ON p_partkey = {_ITEM} WHERE event_type = 'click' GROUP BY 1""")
def opens_join_agg(spark, d):
    opened = _events(spark, d).filter("event_type = 'click'").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("item") == F.col("p_partkey"))
    return opened.groupBy("p_brand").agg(F.count("*").alias("opens"), F.countDistinct("user_id").alias("actors"), F.max("ts").alias("last_open"))


@query(f"""SELECT item, count(*) AS saves FROM (SELECT user_id, {_ITEM} AS item, event_type, row_number() OVER (PARTITION BY user_id, {_ITEM} ORDER BY ts DESC, event_id DESC) AS r
FROM events WHERE event_type IN ('purchase', 'error')) WHERE r = 1 AND event_type = 'purchase' GROUP BY 1""")
def favorites_latest_state(spark, d):
    marks = _events(spark, d).filter(F.col("event_type").isin("purchase", "error"))
    last = ops.latest_state(marks, ["user_id", "item"], [F.desc("ts"), F.desc("event_id")])
    return last.filter("event_type = 'purchase'").groupBy("item").agg(F.count("*").alias("saves"))


@query(f"""WITH c AS (SELECT {_DAY} AS day, count(*) AS events FROM events WHERE event_type = 'error' AND value > 60 GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM c) SELECT s.day, coalesce(c.events, 0) AS events FROM s LEFT JOIN c USING (day)""")
def trend_dense(spark, d):
    counts = _events(spark, d).filter("event_type = 'error' and value > 60").groupBy("day").agg(F.count("*").alias("events"))
    return ops.dense_series(counts, "day", "events")


@query(f"""SELECT event_type, CAST(sum(events) AS BIGINT) AS events, CAST(sum(visitors) AS BIGINT) AS daily_visitors, count(*) AS days FROM (
SELECT {_DAY} AS day, event_type, count(*) AS events, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1, 2) GROUP BY 1""")
def dashboard_rollup(spark, d):
    """Daily distinct visitors are added over days, not counted anew: the rollup reads the daily aggregate alone."""
    daily = _events(spark, d).groupBy("day", "event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("visitors"))
    return daily.groupBy("event_type").agg(F.sum("events").alias("events"), F.sum("visitors").alias("daily_visitors"), F.count("*").alias("days"))


_STAGES = {"viewed": "event_type = 'view'", "opened": "event_type = 'click'", "saved": "event_type = 'purchase'", "signed_up": "event_type = 'signup'"}


@query(f"""SELECT count(*) AS sessions, CAST(sum(viewed) AS BIGINT) AS viewed, CAST(sum(opened) AS BIGINT) AS opened, CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(signed_up) AS BIGINT) AS signed_up FROM (
SELECT user_id, {_DAY} AS day, {', '.join(f'max(CAST({c} AS INTEGER)) AS {n}' for n, c in _STAGES.items())} FROM events WHERE user_id % 10 <> 0 GROUP BY 1, 2)""")
def funnel_stages(spark, d):
    """Sessions are a user's local days; those of own accounts are left out."""
    return ops.funnel(_events(spark, d).filter("user_id % 10 <> 0"), ["user_id", "day"], {n: F.expr(c) for n, c in _STAGES.items()})


@query(f"""WITH n AS (SELECT event_type, {_ITEM} AS item, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, item) AS r FROM n)
SELECT event_type, string_agg(CAST(item AS VARCHAR), ',' ORDER BY r) AS top_values FROM r WHERE r <= 3 GROUP BY 1""")
def funnel_sources_topk(spark, d):
    return ops.top_values(_events(spark, d), ["event_type"], "item", 3)


@query(f"""WITH l AS (SELECT user_id, {_ITEM} AS item, event_type, row_number() OVER (PARTITION BY user_id, {_ITEM} ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('purchase', 'error')),
s AS (SELECT user_id, count(*) AS saved FROM l WHERE r = 1 AND event_type = 'purchase' GROUP BY 1)
SELECT e.user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS opens, max(ts) AS last_seen, coalesce(any_value(s.saved), 0) AS net_saved
FROM events e LEFT JOIN s ON s.user_id = e.user_id GROUP BY 1""")
def user_activity(spark, d):
    e = _events(spark, d)
    last = ops.latest_state(e.filter(F.col("event_type").isin("purchase", "error")), ["user_id", "item"], [F.desc("ts"), F.desc("event_id")])
    saved = last.filter("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("net_saved"))
    seen = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "click").alias("opens"), F.max("ts").alias("last_seen"))
    return seen.join(saved, "user_id", "left").withColumn("net_saved", F.coalesce("net_saved", F.lit(0)))


@query(f"""SELECT user_id, max(n) AS most_at_once FROM (SELECT user_id, {_HOUR} AS hour, count(DISTINCT {_ITEM}) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def account_concurrency(spark, d):
    hourly = _events(spark, d).groupBy("user_id", F.date_trunc("hour", local_time(F.col("ts"))).alias("hour")).agg(F.countDistinct("item").alias("n"))
    return hourly.groupBy("user_id").agg(F.max("n").alias("most_at_once"))


@query("""SELECT event_id, user_id, hits FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW) AS hits FROM events) WHERE hits > 3""")
def rate_limit_hits(spark, d):
    return ops.sliding_hits(table(spark, d, "events"), "user_id", "ts", 86_400).filter("hits > 3").select("event_id", "user_id", "hits")


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS device_rank, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 3 AS kept FROM events WHERE event_type = 'signup'""")
def device_eviction(spark, d):
    e = table(spark, d, "events").filter("event_type = 'signup'")
    return ops.keep_recent(e, "user_id", [F.desc("ts"), F.asc("event_id")], 3).select("event_id", "user_id", F.col("rank_").alias("device_rank"), "kept")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type IN ('purchase', 'signup') THEN 0 ELSE 1 END, ts DESC, event_id DESC) AS r FROM events WHERE value > 20) WHERE r = 1""")
def preferred_subscription(spark, d):
    active = F.when(F.col("event_type").isin("purchase", "signup"), 0).otherwise(1)
    return ops.latest_state(table(spark, d, "events").filter("value > 20"), ["user_id"], [active, F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT j.user_id, last_run, coalesce(last_run < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR, true) AS stale FROM (SELECT DISTINCT user_id FROM events) j
LEFT JOIN (SELECT user_id, max(ts) AS last_run FROM events WHERE event_type = 'view' GROUP BY 1) r ON r.user_id = j.user_id""")
def heartbeat_staleness(spark, d):
    e = table(spark, d, "events")
    runs = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("last_run"))
    known = e.select("user_id").distinct().join(runs, "user_id", "left").join(F.broadcast(_bounds(e)))
    return known.select("user_id", "last_run", F.coalesce(F.col("last_run") < F.col("now") - F.expr("interval 12 hours"), F.lit(True)).alias("stale"))


@query("""SELECT event_type, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1""")
def retention_purge(spark, d):
    e = table(spark, d, "events")
    return e.join(F.broadcast(_bounds(e)), F.col("ts") >= F.col("now") - F.expr("interval 7 days")).groupBy("event_type").agg(F.count("*").alias("kept"))


@query("""SELECT user_id, session, count(*) AS events, min(ts) AS began, max(ts) AS ended FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY 1, 2""")
def session_gaps(spark, d):
    s = ops.sessionize(table(spark, d, "events"), "user_id", "ts", 30)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


@query(f"""WITH h AS (SELECT {_DAY} AS day, CAST(sum(value) AS DOUBLE) AS bytes, count(*) AS requests FROM events WHERE event_id % 2 = 0 GROUP BY 1),
n AS (SELECT {_DAY} AS day, CAST(sum(value) AS DOUBLE) AS bytes, count(*) AS requests FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT day, round(sum(bytes), 3) AS bytes, CAST(sum(requests) AS BIGINT) AS requests FROM (SELECT * FROM h UNION ALL SELECT * FROM n) GROUP BY 1""")
def accumulating_upsert(spark, d):
    """Daily counters of two batches added on conflict."""
    e = _events(spark, d)
    batch = [e.filter(F.col("event_id") % 2 == k).groupBy("day").agg(F.sum("value").alias("bytes"), F.count("*").alias("requests")) for k in (0, 1)]
    return batch[0].unionByName(batch[1]).groupBy("day").agg(F.round(F.sum("bytes"), 3).alias("bytes"), F.sum("requests").alias("requests"))
