"""Gates, duplicates, schedules, reports and pages over orders as notices. TODAY stands for the current day."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.functions import dates, money
from kelpie.functions.rules import deadline_class, derived_status, first_match
from kelpie.operators import notices as ops
from kelpie.operators.events import latest_state
from kelpie.session import table

TODAY = "1999-01-01"
DAYS = {"1-URGENT": 15, "2-HIGH": 30, "3-MEDIUM": 45, "5-LOW": 90}
FLOORS = [50_000.0, 100_000.0, 200_000.0, 350_000.0]
TIERS = ((400_000.0, "flagship"), (200_000.0, "significant"), (20_000.0, "standard"))
PAGE_ROWS = 50
QUERIES, ORACLE = {}, {}

_T = f"DATE '{TODAY}'"
_N = f"""n AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'awarded' WHEN 'P' THEN 'planned' ELSE 'open' END AS stored, CAST(o_orderdate AS DATE) AS pub,
CAST(o_orderdate AS DATE) + CASE o_orderpriority WHEN '1-URGENT' THEN 15 WHEN '2-HIGH' THEN 30 WHEN '3-MEDIUM' THEN 45 WHEN '5-LOW' THEN 90 END AS deadline FROM orders)"""
_S = f"""{_N}, s AS (SELECT *, CASE WHEN stored = 'awarded' AND NOT coalesce(deadline >= {_T}, false) THEN stored WHEN deadline < {_T} OR (deadline IS NULL AND pub < {_T} - 45) THEN 'submission_closed' ELSE 'open' END AS status FROM n)"""
_TIER = "CASE WHEN {0} >= 400000 THEN 'flagship' WHEN {0} >= 200000 THEN 'significant' WHEN {0} >= 20000 THEN 'standard' ELSE 'excluded' END"


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _today():
    return F.lit(TODAY).cast("date")


def _notices(spark, d):
    days = F.create_map(*[F.lit(x) for pair in DAYS.items() for x in pair])
    stored = F.when(F.col("o_orderstatus") == "F", "awarded").when(F.col("o_orderstatus") == "P", "planned").otherwise("open")
    pub = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").withColumns({"stored": stored, "pub": pub, "deadline": F.date_add(pub, F.element_at(days, F.col("o_orderpriority")))})


def _status():
    return derived_status(F.col("stored"), F.col("deadline"), F.col("pub"), _today())


@query(f"WITH {_S} SELECT stored, status, count(*) AS n FROM s GROUP BY 1, 2")
def status_derived(spark, d):
    return _notices(spark, d).groupBy("stored", _status().alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {_S} SELECT o_orderkey, status FROM s WHERE status <> stored AND NOT (stored = 'awarded' AND status = 'open') AND o_orderkey % 7 <> 0")
def status_refresh(spark, d):
    """Stored states that must change: locked rows and finished ones that would reopen are left alone."""
    change = (F.col("status") != F.col("stored")) & ~((F.col("stored") == "awarded") & (F.col("status") == "open")) & (F.col("o_orderkey") % 7 != 0)
    return _notices(spark, d).withColumn("status", _status()).filter(change).select("o_orderkey", "status")


@query(f"""WITH {_S}, k AS (SELECT *, CASE WHEN deadline >= {_T} AND status = 'open' THEN 0 WHEN status = 'planned' THEN 1 WHEN status = 'awarded' THEN 3 WHEN deadline >= {_T} THEN 4 ELSE 5 END AS class FROM s)
SELECT o_orderkey, CAST(class AS INTEGER) AS class FROM k ORDER BY class, coalesce(deadline >= {_T}, false) DESC, CASE WHEN deadline >= {_T} THEN deadline END NULLS LAST, pub DESC, o_orderkey LIMIT {PAGE_ROWS}""")
def sort_deadline_priority(spark, d):
    """The first page by deadline; a page is the feature. Inside a class, coming deadlines stand first, so the order is total."""
    coming = F.coalesce(F.col("deadline") >= _today(), F.lit(False))
    n = _notices(spark, d).withColumn("class", deadline_class(_status(), F.col("deadline"), _today()))
    order = [F.asc("class"), coming.desc(), F.when(coming, F.col("deadline")).asc_nulls_last(), F.desc("pub"), F.asc("o_orderkey")]
    return ops.page(n, order, 1, PAGE_ROWS).select("o_orderkey", "class")


@query(f"""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS c FROM orders) WHERE r > (ceil(c / {PAGE_ROWS}) - 1) * {PAGE_ROWS}""")
def paginate_clamped(spark, d):
    """A page number beyond the end gives the last page."""
    return ops.page(table(spark, d, "orders").select("o_orderkey"), [F.asc("o_orderkey")], 10**9, PAGE_ROWS)


@query(f"""WITH {_S} SELECT CASE WHEN deadline < {_T} AND stored <> 'awarded' THEN 'closed' WHEN o_totalprice < 200000 AND date_diff('day', pub, deadline) < 20 THEN 'short_window' WHEN o_totalprice < 20000 THEN 'excluded'
WHEN pub < DATE '1998-01-01' THEN 'old' WHEN o_orderkey % 11 = 0 THEN 'deleted' ELSE 'kept' END AS reason, count(*) AS n FROM s GROUP BY 1""")
def import_gates(spark, d):
    """Rows by the first gate that turns them away; deleted keys come from a table of tombstones."""
    gone = table(spark, d, "orders").filter("o_orderkey % 11 = 0").select("o_orderkey", F.lit(True).alias("deleted"))
    value, window = F.col("o_totalprice"), dates.days_between(F.col("deadline"), F.col("pub"))
    rules = [
        ("closed", (F.col("deadline") < _today()) & (F.col("stored") != "awarded")),
        ("short_window", (value < 200_000) & (window < 20)),
        ("excluded", value < 20_000),
        ("old", F.col("pub") < F.add_months(_today(), -12)),
        ("deleted", F.col("deleted")),
    ]
    gated = ops.gated(_notices(spark, d).join(gone, "o_orderkey", "left"), rules)
    return gated.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 5 = 0 AS stored, concat(o_custkey, '|', o_orderpriority, '|', floor(o_totalprice / 50000)::BIGINT) AS k, o_orderdate FROM orders)
SELECT o_orderkey FROM (SELECT *, max(stored::INT) OVER (PARTITION BY k) AS a, row_number() OVER (PARTITION BY k ORDER BY stored DESC, o_orderdate, o_orderkey) AS r FROM k) WHERE stored OR (a = 0 AND r = 1)""")
def dup_procurement_keep(spark, d):
    key = F.concat_ws("|", "o_custkey", "o_orderpriority", F.floor(F.col("o_totalprice") / 50_000).cast("long"))
    return ops.without_duplicates(table(spark, d, "orders"), key, F.col("o_orderkey") % 5 == 0, [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_orderkey")


@query("""WITH k AS (SELECT *, o_orderkey % 5 = 0 AS stored FROM orders)
SELECT o_orderkey FROM (SELECT *, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY stored DESC, o_orderdate, o_orderkey) AS owner FROM k) WHERE stored OR owner = o_orderpriority""")
def owner_dedupe(spark, d):
    stored = F.col("o_orderkey") % 5 == 0
    return ops.owned(table(spark, d, "orders"), ["o_custkey"], [stored.desc(), F.asc("o_orderdate"), F.asc("o_orderkey")], "o_orderpriority", stored).select("o_orderkey")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 7 = 0 DESC, o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def keep_best(spark, d):
    """Locked first, then the oldest, then the key."""
    return latest_state(table(spark, d, "orders"), ["o_custkey"], [(F.col("o_orderkey") % 7 == 0).desc(), F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""SELECT l_orderkey, count(DISTINCT lower(trim(s_name))) AS suppliers, strftime(max(l_shipdate), '%Y-%m-%d') AS awarded, CASE WHEN count(DISTINCT l_returnflag) <= 1 THEN CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 2))) AS DOUBLE) END AS amount
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def award_combine(spark, d):
    """The parts of an award; the return flag stands for the currency."""
    parts = table(spark, d, "lineitem").join(table(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return ops.combined_awards(parts, "l_orderkey", "s_name", "l_extendedprice", "l_returnflag", "l_shipdate").withColumn("awarded", F.date_format("awarded", "yyyy-MM-dd"))


@query(f"""WITH f AS (SELECT l_orderkey AS k, max(CAST(l_shipdate AS DATE)) AS day, CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 2))) AS DOUBLE) AS amount FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS amount, CAST(NULL AS DATE) AS day FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, coalesce(s.amount, CASE WHEN f.day <= {_T} THEN f.amount END) AS amount, strftime(CASE WHEN f.day <= {_T} THEN f.day END, '%Y-%m-%d') AS day FROM s LEFT JOIN f ON k = o_orderkey""")
def award_fill(spark, d):
    """Awarded notices take the day and amount of results that are not in the future."""
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_shipdate").cast("date")).alias("day"), F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).cast("double").alias("amount"))
    stored = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("amount"), F.lit(None).cast("date").alias("day"))
    return ops.filled(stored, found, "o_orderkey", ["amount", "day"], F.col("b.day") <= _today()).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS e, max(l_shipdate) AS l FROM lineitem GROUP BY 1, 2), v AS (SELECT *, lag(l) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM g)
SELECT l_orderkey, l_linenumber, strftime(e, '%Y-%m-%d') AS earliest, strftime(b, '%Y-%m-%d') AS before FROM v WHERE e < b""")
def key_date_violations(spark, d):
    bad = ops.order_violations(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_shipdate")
    return bad.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("earliest", "before")})


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, max(CAST(l_shipdate AS DATE)) AS day FROM lineitem GROUP BY 1, 2), s AS (SELECT * FROM l WHERE l_orderkey % 3 <> 0), n AS (SELECT l_orderkey, l_linenumber, day + CAST(l_orderkey % 2 AS INTEGER) AS day FROM l)
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN s.l_orderkey IS NULL THEN 'insert' WHEN s.day = n.day THEN 'duplicate' ELSE 'conflict' END AS kind FROM n LEFT JOIN s USING (l_orderkey, l_linenumber)) GROUP BY 1""")
def schedule_diff(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_shipdate").cast("date")).alias("day"))
    new = lines.withColumn("day", F.date_add("day", (F.col("l_orderkey") % 2).cast("int")))
    return ops.schedule_diff(lines.filter("l_orderkey % 3 <> 0"), new, ["l_orderkey", "l_linenumber"], "day").groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 50000)""")
def tombstone_anti(spark, d):
    o = table(spark, d, "orders")
    return o.join(o.filter("o_orderstatus = 'F' and o_totalprice < 50000").select("o_orderkey"), "o_orderkey", "left_anti").select("o_orderkey")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS v FROM orders)
SELECT o_orderkey, coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS v FROM o""")
def sibling_fill(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice")).alias("v"))
    return ops.sibling_filled(o, "o_custkey", [F.asc("o_orderkey")], ["v"]).select("o_orderkey", "v")


@query("""WITH b AS (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS p, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, q, v AS o_totalprice FROM b JOIN (SELECT unnest([0.0, 0.5, 0.75, 1.0])::DOUBLE AS q) ON p = least(floor(n * q), n - 1)""")
def quantiles_floor(spark, d):
    return ops.floor_quantiles(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", [0.0, 0.5, 0.75, 1.0], 1_000.0)


@query("SELECT f AS floor, count(*) AS n FROM orders JOIN (SELECT unnest([50000.0, 100000.0, 200000.0, 350000.0])::DOUBLE AS f) ON o_totalprice >= f GROUP BY 1")
def threshold_sweep(spark, d):
    """All floors in one pass; each row meets only the floors it reaches."""
    reached = F.filter(F.array(*[F.lit(f) for f in FLOORS]), lambda f: f <= F.col("o_totalprice"))
    return table(spark, d, "orders").select(F.explode(reached).alias("floor")).groupBy("floor").agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT {_TIER.format('o_totalprice')} AS old, {_TIER.format('(o_totalprice * 0.8)')} AS new FROM orders)
SELECT old, count(*) FILTER (WHERE new = 'flagship') AS flagship, count(*) FILTER (WHERE new = 'significant') AS significant, count(*) FILTER (WHERE new = 'standard') AS standard, count(*) FILTER (WHERE new = 'excluded') AS excluded FROM t GROUP BY 1""")
def tier_transition_pivot(spark, d):
    v = F.col("o_totalprice")
    t = table(spark, d, "orders").select(money.tier(v, TIERS, "excluded").alias("old"), money.tier(v * 0.8, TIERS, "excluded").alias("new"))
    return t.groupBy("old").pivot("new", ["flagship", "significant", "standard", "excluded"]).count().fillna(0)


@query("SELECT CAST(CASE WHEN o_totalprice < 1000 THEN 0 WHEN o_totalprice < 5000 THEN 1 WHEN o_totalprice < 25000 THEN 2 WHEN o_totalprice < 100000 THEN 3 WHEN o_totalprice < 200000 THEN 4 WHEN o_totalprice < 350000 THEN 5 ELSE 6 END AS INTEGER) AS band, count(*) AS n FROM orders GROUP BY 1")
def band_histogram(spark, d):
    return table(spark, d, "orders").groupBy(money.band(F.col("o_totalprice")).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT strftime(o_orderdate, '%G-W%V') AS week, count(*) AS n, strftime(min(date_trunc('week', o_orderdate)), '%Y-%m-%d') AS starts FROM orders GROUP BY 1")
def weekly_counts(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").groupBy(dates.iso_week(day).alias("week")).agg(F.count("*").alias("n"), F.date_format(F.min(dates.week_start(day)), "yyyy-MM-dd").alias("starts"))


@query("""SELECT s_suppkey, s_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 2))) AS DOUBLE) AS total, count(*) AS n, bool_or(l_returnflag = 'R') AS any_returned, max(struct_pack(d := l_shipdate, k := l_orderkey)).k AS latest FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""")
def supplier_leaderboard(spark, d):
    """Lines are added up per supplier before names are joined."""
    sums = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).cast("double").alias("total"), F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.max(F.struct("l_shipdate", "l_orderkey"))["l_orderkey"].alias("latest")
    )
    return sums.join(table(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_name", "total", "n", "any_returned", "latest")


@query(f"WITH {_S} SELECT count(*) FILTER (WHERE status = 'open') AS live, count(*) FILTER (WHERE pub = {_T} - 1) AS fresh, count(*) FILTER (WHERE deadline BETWEEN {_T} AND {_T} + 5) AS due FROM s")
def list_counters(spark, d):
    due = F.col("deadline").between(_today(), F.date_add(_today(), 5))
    return _notices(spark, d).withColumn("status", _status()).agg(F.count_if(F.col("status") == "open").alias("live"), F.count_if(F.col("pub") == F.date_sub(_today(), 1)).alias("fresh"), F.count_if(due).alias("due"))


@query("""SELECT c_custkey, count(*) AS matches FROM customer JOIN orders ON o_orderpriority = CASE c_mktsegment WHEN 'BUILDING' THEN '1-URGENT' WHEN 'MACHINERY' THEN '2-HIGH' ELSE '5-LOW' END
AND o_totalprice >= greatest(c_acctbal, 0) * 40 AND o_custkey = c_custkey GROUP BY 1""")
def digest_plan(spark, d):
    """Each recipient's notices by preference; an equality key carries the join, the open range is checked on top."""
    wanted = F.when(F.col("c_mktsegment") == "BUILDING", "1-URGENT").when(F.col("c_mktsegment") == "MACHINERY", "2-HIGH").otherwise("5-LOW")
    people = table(spark, d, "customer").select("c_custkey", wanted.alias("wanted"), (F.greatest("c_acctbal", F.lit(0.0)) * 40).alias("least"))
    hit = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderpriority") == F.col("wanted")) & (F.col("o_totalprice") >= F.col("least"))
    return people.join(table(spark, d, "orders"), hit).groupBy("c_custkey").agg(F.count("*").alias("matches"))


@query(f"""WITH {_N} SELECT CASE WHEN o_totalprice < 20000 THEN 'excluded' WHEN o_orderpriority = '5-LOW' AND o_totalprice < 100000 THEN 'excluded' WHEN o_totalprice >= 400000 THEN 'flagship' WHEN date_diff('day', pub, deadline) < 20 THEN 'standard'
WHEN o_totalprice >= 200000 THEN 'significant' ELSE 'standard' END AS tier, stored, count(*) AS n FROM n GROUP BY 1, 2""")
def relevance_tiers(spark, d):
    """A decision list over value, kind and duration."""
    v = F.col("o_totalprice")
    rules = [
        ("excluded", v < 20_000),
        ("excluded", (F.col("o_orderpriority") == "5-LOW") & (v < 100_000)),
        ("flagship", v >= 400_000),
        ("standard", dates.days_between(F.col("deadline"), F.col("pub")) < 20),
        ("significant", v >= 200_000),
    ]
    return _notices(spark, d).groupBy(first_match(rules, "standard").alias("tier"), "stored").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT o_orderpriority, o_orderkey, r AS turn FROM t WHERE r <= 2 AND o_orderstatus IN ('O', 'P')""")
def featured_links(spark, d):
    """Two of each kind and state: a quota is the feature."""
    w = W.partitionBy("o_orderpriority", "o_orderstatus").orderBy(F.desc("o_totalprice"), F.asc("o_orderkey"))
    return table(spark, d, "orders").filter(F.col("o_orderstatus").isin("O", "P")).withColumn("turn", F.row_number().over(w)).filter("turn <= 2").select("o_orderpriority", "o_orderkey", "turn")
