"""Queries over notices and their buyers: orders are notices, customers buyers, nations countries, lines their items."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.operators import listing as ops
from kelpie.operators.events import latest_state, top_values
from kelpie.session import table

PAGE_ROWS = 50
QUERIES, ORACLE = {}, {}
_LISTED = "orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


def _listed(spark, d):
    buyers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))


@query(f"""SELECT o_orderkey, n_name, o_totalprice, turn FROM (SELECT o_orderkey, n_name, o_totalprice, row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) AS turn
FROM {_LISTED} WHERE o_orderstatus IN ('O', 'P') AND o_totalprice >= 1000) ORDER BY turn, n_name LIMIT {PAGE_ROWS}""")
def list_page(spark, d):
    """The first page of open notices, countries in rotation; a page is the feature, so the limit stays."""
    chosen = _listed(spark, d).filter(ops.facets({"o_orderstatus": ["O", "P"], "o_orderpriority": []}) & (F.col("o_totalprice") >= 1000))
    # no more than a page of any country can be shown, and Spark keeps no more of each before it is ranked
    turns = ops.interleaved(chosen, "n_name", [F.desc("o_totalprice"), F.asc("o_orderkey")]).filter(F.col("turn") <= PAGE_ROWS)
    return turns.orderBy("turn", "n_name").limit(PAGE_ROWS).select("o_orderkey", "n_name", "o_totalprice", "turn")


@query(f"""SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM {_LISTED} GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM {_LISTED} GROUP BY 2
UNION ALL SELECT 'n_name', n_name, count(*) FROM {_LISTED} GROUP BY 2 UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM {_LISTED} GROUP BY 2""")
def facet_counts(spark, d):
    return ops.facet_counts(_listed(spark, d), ["o_orderstatus", "o_orderpriority", "n_name", "c_mktsegment"])


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS earlier, date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) AS days FROM orders
WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)""")
def reissue_as_of(spark, d):
    """The latest earlier round of the same buyer and kind, if any."""
    rounds = ops.previous_of(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], [F.asc("o_orderdate"), F.asc("o_orderkey")], {"earlier": "o_orderkey", "earlier_date": "o_orderdate"})
    return rounds.select("o_orderkey", "earlier", F.datediff("o_orderdate", "earlier_date").cast("long").alias("days"))


@query("""SELECT o_custkey, o_orderkey, old_status, o_orderstatus AS new_status FROM (SELECT *, lag(o_orderstatus) OVER w AS old_status, row_number() OVER w AS place FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE place > 1 AND old_status IS DISTINCT FROM o_orderstatus""")
def status_history(spark, d):
    changed = ops.changes(table(spark, d, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], "o_orderstatus")
    return changed.select("o_custkey", "o_orderkey", F.col("old_").alias("old_status"), F.col("o_orderstatus").alias("new_status"))


@query("""WITH s AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice + 1 END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(s.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderpriority = '1-URGENT' THEN s.o_totalprice ELSE coalesce(n.o_totalprice, s.o_totalprice) END AS o_totalprice,
CASE WHEN s.o_orderpriority = '1-URGENT' THEN s.o_orderstatus ELSE coalesce(n.o_orderstatus, s.o_orderstatus) END AS o_orderstatus,
CASE WHEN s.o_orderkey IS NULL THEN 'added' WHEN s.o_orderpriority = '1-URGENT' THEN 'locked' WHEN n.o_orderkey IS NULL THEN 'kept' ELSE 'merged' END AS outcome
FROM s FULL JOIN n ON s.o_orderkey = n.o_orderkey""")
def protected_upsert(spark, d):
    o = table(spark, d, "orders")
    new = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") + 1).alias("o_totalprice"), "o_orderstatus")
    return ops.merged(o.filter("o_orderkey % 3 <> 0"), new, "o_orderkey", ["o_totalprice", "o_orderstatus"], F.col("o_orderpriority") == "1-URGENT")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')""")
def buyers_without_open(spark, d):
    opened = table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_custkey")
    return table(spark, d, "customer").join(opened, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45 AND l_returnflag = 'R')""")
def visible_with_children(spark, d):
    """Notices that have at least one child of the wanted kind."""
    children = table(spark, d, "lineitem").filter("l_quantity >= 45 and l_returnflag = 'R'").select("l_orderkey")
    return table(spark, d, "orders").join(children, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderstatus")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_notice(spark, d):
    return latest_state(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT o_orderkey, count(l_orderkey) AS n_dates, string_agg(DISTINCT strftime(l_shipdate, '%Y-%m-%d'), ',' ORDER BY strftime(l_shipdate, '%Y-%m-%d')) AS dates FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def key_dates_nested(spark, d):
    """Children folded into their parent; parents without children stay, with a null list."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.date_format("l_shipdate", "yyyy-MM-dd"))), ",").alias("dates"))
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_dates"), "dates")


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(*) AS notices, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed, round(sum(o_totalprice), 2) AS value, round(max(o_totalprice), 2) AS largest FROM orders GROUP BY 1, 2""")
def monthly_report(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority").agg(
        F.count("*").alias("notices"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"), F.round(F.sum("o_totalprice"), 2).alias("value"), F.round(F.max("o_totalprice"), 2).alias("largest")
    )


@query("""WITH n AS (SELECT o_orderpriority, n_name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, n_name) AS r FROM n)
SELECT o_orderpriority, string_agg(n_name, ',' ORDER BY r) AS top_values FROM r WHERE r <= 5 GROUP BY 1""")
def top_countries(spark, d):
    return top_values(_listed(spark, d), ["o_orderpriority"], "n_name", 5)


@query("""SELECT o_custkey, count(*) AS soon FROM orders o JOIN (SELECT o_custkey AS k, min(o_orderdate) AS began FROM orders GROUP BY 1) w ON w.k = o.o_custkey AND o_orderdate > began AND o_orderdate <= began + INTERVAL 90 DAY GROUP BY 1""")
def window_interval_join(spark, d):
    """Notices inside each recipient's own window."""
    o = table(spark, d, "orders")
    began = o.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("began"))
    inside = (F.col("k") == F.col("o_custkey")) & (F.col("o_orderdate") > F.col("began")) & (F.col("o_orderdate") <= F.col("began") + F.expr("interval 90 days"))
    return o.join(began, inside).groupBy("o_custkey").agg(F.count("*").alias("soon"))
