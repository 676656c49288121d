"""Distinct users of periods and facets, from one stored table of daily bitmaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.operators import distinct as ops
from kelpie.session import stored, table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


def _daily(spark, d):
    return stored(ops.daily(table(spark, d, "events"), [F.to_date("ts").alias("day"), F.col("event_type")], F.col("user_id")), "daily-users")


@query("""SELECT strftime(ts, '%Y-%m') AS month, event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT strftime(ts, '%Y-%m'), 'all', count(DISTINCT user_id) FROM events GROUP BY 1 UNION ALL SELECT 'all', 'all', count(DISTINCT user_id) FROM events""")
def period_distinct_users(spark, d):
    """Users of each month and event type, of each month, and of the whole log; daily rows alone are read."""
    days = _daily(spark, d)
    month = F.date_format("day", "yyyy-MM").alias("month")
    by_type = ops.merged(days, [month, F.col("event_type")])
    by_month = ops.merged(by_type, [F.col("month"), F.lit("all").alias("event_type")])
    whole = ops.merged(by_month, [F.lit("all").alias("month"), F.col("event_type")])
    return ops.counted(by_type.unionByName(by_month).unionByName(whole), ["month", "event_type"])


@query("""SELECT month, count(*) AS n FROM (SELECT strftime(ts, '%Y-%m') AS month, user_id FROM events WHERE event_type IN ('view', 'purchase') AND user_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 2) GROUP BY 1""")
def viewers_who_bought(spark, d):
    """Users of a month who viewed and purchased in it."""
    by_type = ops.merged(_daily(spark, d), [F.date_format("day", "yyyy-MM").alias("month"), F.col("event_type")])
    return ops.both(by_type, ["month"], "event_type", "view", "purchase").filter("n > 0")
