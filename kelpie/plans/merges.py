"""Merges, child tables, scans with bounds, and matching of names and numbers, over orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import money
from kelpie.functions.text import key_fold
from kelpie.operators import matching, merge
from kelpie.plans import notices as base
from kelpie.session import table

QUERIES, ORACLE = {}, {}
_T = f"DATE '{base.TODAY}'"
_TIER = "CASE WHEN {0} IS NULL THEN 'standard' WHEN {0} >= 400000 THEN 'flagship' WHEN {0} >= 200000 THEN 'significant' WHEN {0} >= 20000 THEN 'standard' ELSE 'excluded' END"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _tier(value):
    return F.when(value.isNull(), "standard").otherwise(money.tier(value, base.TIERS, "excluded"))


@query(f"""WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS amount, CAST(o_orderdate AS DATE) AS pub, o_orderkey % 4 = 0 AS guessed, o_orderpriority AS original, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'the ' || o_orderpriority END AS translated,
CASE o_orderkey % 7 WHEN 0 THEN ['tier'] WHEN 1 THEN ['pub', 'amount'] ELSE [] END AS locks FROM orders WHERE o_orderkey % 6 <> 0), st AS (SELECT *, {_TIER.format('amount')} AS tier FROM s),
m AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 >= 3 THEN o_totalprice * 2 END AS amount, CAST(o_orderdate AS DATE) + 9 AS pub, o_orderkey % 8 < 4 AS guessed, CASE WHEN o_orderkey % 9 = 0 THEN 'new' ELSE o_orderpriority END AS original, CASE WHEN o_orderkey % 9 = 0 THEN 'new' ELSE o_orderpriority END AS translated FROM orders WHERE o_orderkey % 11 <> 0), n AS (SELECT *, {_TIER.format('amount')} AS tier FROM m),
j AS (SELECT st.k IS NOT NULL AS known, n.k IS NOT NULL AS had, coalesce(st.k, n.k) AS k, st.*, n.amount AS n_amount, n.pub AS n_pub, n.guessed AS n_guessed, n.original AS n_original, n.translated AS n_translated, n.tier AS n_tier FROM st FULL JOIN n ON st.k = n.k),
g AS (SELECT k, known, had, locks, tier, n_tier, n_amount, CASE WHEN NOT known THEN n_amount WHEN NOT had OR list_contains(locks, 'amount') THEN amount ELSE coalesce(n_amount, amount) END AS amount,
CASE WHEN NOT known THEN n_pub WHEN NOT had OR list_contains(locks, 'pub') OR (n_guessed AND pub IS NOT NULL) THEN pub ELSE n_pub END AS pub, CASE WHEN NOT known THEN n_guessed WHEN NOT had OR (n_guessed AND pub IS NOT NULL) THEN guessed ELSE n_guessed END AS guessed,
CASE WHEN NOT had THEN original ELSE n_original END AS original, CASE WHEN NOT known THEN n_translated WHEN NOT had OR (original = n_original AND translated <> original) THEN translated ELSE n_translated END AS translated FROM (SELECT coalesce(k, k_1) AS k, * EXCLUDE (k, k_1) FROM j))
SELECT k, amount, strftime(pub, '%Y-%m-%d') AS pub, guessed, original, translated, CASE WHEN NOT known THEN n_tier WHEN NOT had OR list_contains(locks, 'tier') THEN tier WHEN amount IS DISTINCT FROM n_amount AND NOT ({_TIER.format('amount')} = 'excluded' AND n_tier <> 'excluded') THEN {_TIER.format('amount')} ELSE n_tier END AS tier FROM g""")
def protected_merge(spark, d):
    """Every rule of the merge at once: kept amounts, guessed days, translations, locks by column, tiers over kept amounts."""
    o, k, price, day, kind = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderdate").cast("date"), F.col("o_orderpriority")
    locks = F.when(k % 7 == 0, F.array(F.lit("tier"))).when(k % 7 == 1, F.array(F.lit("pub"), F.lit("amount"))).otherwise(F.array().cast("array<string>"))
    old = o.filter(k % 6 != 0).select(k.alias("k"), F.when(k % 5 != 0, price).alias("amount"), day.alias("pub"), (k % 4 == 0).alias("guessed"), kind.alias("original"), F.when(k % 3 == 0, kind).otherwise(F.concat(F.lit("the "), kind)).alias("translated"), locks.alias("locks"))
    told = F.when(k % 9 == 0, "new").otherwise(kind)
    new = o.filter(k % 11 != 0).select(k.alias("k"), F.when(k % 10 >= 3, price * 2).alias("amount"), F.date_add(day, 9).alias("pub"), (k % 8 < 4).alias("guessed"), told.alias("original"), told.alias("translated"))
    old, new = (x.withColumn("tier", _tier(F.col("amount"))) for x in (old, new))
    out = merge.protected_merge(old, new, "k", never_null=["amount"], locks="locks", day="pub", estimated="guessed", translated={"translated": "original"}, tier="tier", amount="amount", classify=_tier)
    return out.withColumn("pub", F.date_format("pub", "yyyy-MM-dd"))


@query("""WITH n AS (SELECT DISTINCT l_orderkey, l_linenumber + 100 AS l_linenumber, 'new' AS origin FROM lineitem WHERE l_orderkey % 3 = 0) SELECT l_orderkey, l_linenumber, origin FROM (SELECT l_orderkey, l_linenumber, 'stored' AS origin, l_returnflag = 'R' AS locked FROM lineitem) WHERE locked OR l_orderkey NOT IN (SELECT l_orderkey FROM n) UNION ALL SELECT * FROM n""")
def child_refresh(spark, d):
    lines = table(spark, d, "lineitem")
    old = lines.select("l_orderkey", "l_linenumber", F.lit("stored").alias("origin"), (F.col("l_returnflag") == "R").alias("locked"))
    new = lines.filter("l_orderkey % 3 = 0").select("l_orderkey", (F.col("l_linenumber") + 100).alias("l_linenumber"), F.lit("new").alias("origin"), F.lit(False).alias("locked")).distinct()
    return merge.refreshed_children(old, new, "l_orderkey", F.col("locked")).drop("locked")


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, max(CAST(l_shipdate AS DATE)) + 1 AS day FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber <= 2 GROUP BY 1, 2), s AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT l_orderkey, l_linenumber, strftime(day, '%Y-%m-%d') AS day FROM (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.l_orderkey = s.l_orderkey AND n.l_linenumber = s.l_linenumber) UNION ALL SELECT * FROM n)""")
def supersede_children(spark, d):
    """Children of the superseded kinds alone are replaced."""
    day = F.col("l_shipdate").cast("date")
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", day.alias("day"))
    new = old.filter("l_orderkey % 4 = 0 and l_linenumber <= 2").groupBy("l_orderkey", "l_linenumber").agg(F.date_add(F.max("day"), 1).alias("day"))
    return merge.superseded(old, new, ["l_orderkey", "l_linenumber"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""SELECT DISTINCT o_custkey, o_orderpriority, 'stored' AS origin FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, o_orderpriority, 'new' FROM orders o WHERE o_orderkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey % 2 = 0 AND p.o_custkey = o.o_custkey AND p.o_orderpriority = o.o_orderpriority)""")
def insert_ignore(spark, d):
    edges = table(spark, d, "orders").select("o_custkey", "o_orderpriority", (F.col("o_orderkey") % 2).alias("p"))
    old, new = (edges.filter(F.col("p") == k).select("o_custkey", "o_orderpriority", F.lit(n).alias("origin")).distinct() for k, n in ((0, "stored"), (1, "new")))
    return merge.added(old, new, ["o_custkey", "o_orderpriority"])


@query(f"""SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 5 = 1 OR (c_custkey % 5 = 2 AND {_T} - INTERVAL (c_custkey % 30) MINUTE < {_T} - INTERVAL 15 MINUTE)""")
def claims_open(spark, d):
    """Never claimed, failed, or stuck for a quarter of an hour."""
    k, now = F.col("c_custkey"), F.lit(base.TODAY).cast("timestamp_ntz")
    people = table(spark, d, "customer").select("c_custkey")
    claims = people.filter(k % 5 != 0).select("c_custkey", F.when(k % 5 == 1, "failed").when(k % 5 == 2, "sending").otherwise("sent").alias("state"), (now - F.make_dt_interval(F.lit(0), F.lit(0), (k % 30).cast("int"))).alias("at"))
    return merge.claimed(claims, people, "c_custkey", now, 15)


@query("""SELECT 'kept' AS part, count(*) AS n, sum(o_orderkey) AS keys FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 50000) UNION ALL SELECT 'stones', count(*), sum(o_orderkey) FROM (SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice < 50000) OR o_orderkey % 100 = 0)""")
def purge_with_tombstones(spark, d):
    o = table(spark, d, "orders")
    stay, stones = merge.purged(o, "o_orderkey", (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 50_000), o.filter("o_orderkey % 100 = 0").select("o_orderkey"))
    kept, gone = (x.agg(F.count("*").alias("n"), F.sum("o_orderkey").cast("decimal(38,0)").cast("double").alias("keys")).select(F.lit(name).alias("part"), "n", "keys") for name, x in (("kept", stay), ("stones", stones)))
    return kept.union(gone)


@query("""SELECT o_orderkey, o_orderstatus AS old, CASE WHEN o_orderkey % 6 = 0 THEN 'F' WHEN o_orderkey % 6 = 1 THEN NULL ELSE o_orderstatus END AS new FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderstatus IS DISTINCT FROM CASE WHEN o_orderkey % 6 = 0 THEN 'F' WHEN o_orderkey % 6 = 1 THEN NULL ELSE o_orderstatus END""")
def snapshot_history(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    after = o.withColumn("o_orderstatus", F.when(k % 6 == 0, "F").when(k % 6 == 1, F.lit(None)).otherwise(F.col("o_orderstatus")))
    return merge.snapshot_changes(o.filter(k % 5 != 0), after, "o_orderkey", "o_orderstatus")


@query("""SELECT o_orderkey, strftime(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END, first), '%Y-%m-%d') AS listed FROM orders LEFT JOIN (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS first FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def first_child_stamp(spark, d):
    parents = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate").cast("date")).alias("listed"))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("day"))
    return merge.stamped_by_first_child(parents, "o_orderkey", "listed", lines, "l_orderkey", "day").select("o_orderkey", F.date_format("listed", "yyyy-MM-dd").alias("listed"))


@query("SELECT o_orderkey, (SELECT count(*) > 100 FROM orders) AS truncated FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def bounded_scan(spark, d):
    """A hundred rows at most, and whether that was all: the bound is the feature."""
    return merge.bounded(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 100).select("o_orderkey", "truncated")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'")
def guarded_window_scan(spark, d):
    """A window of the log, read whole or not at all."""
    rows = table(spark, d, "events").filter("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-09'").select("event_id")
    return merge.guarded(rows, 1_000_000_000)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    return table(spark, d, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0)")
def multi_key_lookup(spark, d):
    keys = table(spark, d, "lineitem").filter("l_quantity = 50 and l_discount = 0").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("""WITH m AS (SELECT unnest(generate_series(date_trunc('month', (SELECT min(o_orderdate) FROM orders)), date_trunc('month', (SELECT max(o_orderdate) FROM orders)), INTERVAL 1 MONTH)) AS m), c AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1) SELECT strftime(m.m, '%Y-%m') AS segment, coalesce(n, 0) AS n FROM m LEFT JOIN c ON c.m = m.m""")
def month_segments(spark, d):
    """Every month between the first and the last, with its rows; one without rows is there too."""
    o = table(spark, d, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("m"))
    counts = o.groupBy("m").agg(F.count("*").alias("n"))
    months = counts.agg(F.min("m").alias("a"), F.max("m").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    return months.join(counts, "m", "left").select(F.date_format("m", "yyyy-MM").alias("segment"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT max(CAST(o_orderdate AS DATE))::VARCHAR AS latest, o_orderpriority FROM orders WHERE o_orderstatus = 'O' GROUP BY 2")
def latest_publication(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").groupBy("o_orderpriority").agg(F.max(F.col("o_orderdate").cast("date")).cast("string").alias("latest"))


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O' AND l_quantity > 30)""")
def embed_two_flags(spark, d):
    """Both kinds of children must exist; they are looked for in one pass."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 30)).alias("b")).filter("a and b")
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("""WITH s AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS old FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1, 2) SELECT o_orderkey, coalesce(old, o_orderkey) AS adopted FROM orders LEFT JOIN s USING (o_custkey, o_orderpriority) WHERE o_orderkey % 4 <> 0""")
def identity_adoption(spark, d):
    """A new row takes the identity that its number is stored under."""
    o = table(spark, d, "orders")
    old = o.filter("o_orderkey % 4 = 0").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("old"))
    return o.filter("o_orderkey % 4 <> 0").join(old, ["o_custkey", "o_orderpriority"], "left").select("o_orderkey", F.coalesce("old", "o_orderkey").alias("adopted"))


_NUMBERS = "n AS (SELECT p_partkey, 'n' || p_partkey AS number FROM part UNION ALL SELECT p_partkey, 'n' || p_partkey || 'x' || p_size FROM part WHERE p_partkey % 3 = 0)"


@query(f"""WITH {_NUMBERS}, f AS (SELECT l_orderkey, l_linenumber, min(CASE WHEN l_partkey % 2 = 0 THEN 'file_N-' || l_partkey || '_final' ELSE 'doc n' || l_partkey || ' x.' || (SELECT any_value(p_size) FROM part WHERE p_partkey = l_partkey) END) AS name FROM lineitem GROUP BY 1, 2), h AS (SELECT f.*, number FROM f JOIN n ON length(number) >= 4 AND contains(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), number)),
b AS (SELECT l_orderkey, l_linenumber, number FROM h a WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.l_orderkey = a.l_orderkey AND c.l_linenumber = a.l_linenumber AND length(c.number) > length(a.number) AND contains(c.number, a.number))) SELECT l_orderkey, l_linenumber, CASE WHEN count(DISTINCT number) = 1 THEN min(number) END AS number, count(DISTINCT number) AS found FROM b GROUP BY 1, 2""")
def numbers_in_names(spark, d):
    """Known numbers inside file names whose separators are lost: the longest wins, several are ambiguous."""
    part = table(spark, d, "part")
    known = part.select(F.concat(F.lit("n"), "p_partkey").alias("number")).union(part.filter("p_partkey % 3 = 0").select(F.concat(F.lit("n"), "p_partkey", F.lit("x"), "p_size")))
    sizes = part.select(F.col("p_partkey").alias("l_partkey"), "p_size")
    name = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("file_N-"), "l_partkey", F.lit("_final"))).otherwise(F.concat(F.lit("doc n"), "l_partkey", F.lit(" x."), "p_size"))
    files = table(spark, d, "lineitem").join(sizes, "l_partkey", "left").groupBy("l_orderkey", "l_linenumber").agg(F.min(name).alias("name"))
    return matching.numbers_inside(files, ["l_orderkey", "l_linenumber"], "name", known, "number", 4)


@query("""WITH c AS (SELECT o_custkey AS g, o_orderkey AS k, lower('office of ' || o_orderpriority || ' town' || (o_orderkey % 13)) AS buyer FROM orders WHERE o_custkey % 3 = 0), t AS (SELECT g, k, unnest(list_distinct(list_filter(string_split(regexp_replace(buyer, '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 4))) AS t FROM c),
own AS (SELECT g, t, min(k) AS k FROM t GROUP BY 1, 2 HAVING count(*) = 1), x AS (SELECT DISTINCT c_custkey AS g, unnest(['town' || (c_custkey % 13), 'urgent', 'office']) AS w FROM customer), e AS (SELECT own.g, own.k FROM own JOIN x ON x.g = own.g AND x.w = own.t), r AS (SELECT g, count(DISTINCT k) AS n, min(k) AS k FROM e GROUP BY 1)
SELECT g.g, CASE WHEN g.n = 1 THEN g.k WHEN r.n = 1 THEN r.k END AS chosen FROM (SELECT g, count(*) AS n, min(k) AS k FROM c GROUP BY 1) g LEFT JOIN r ON r.g = g.g""")
def distinguishing_tokens(spark, d):
    """Candidates that share a number are told apart by words that no other of them has; one supported one alone is chosen."""
    o = table(spark, d, "orders").filter("o_custkey % 3 = 0").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k"), F.concat(F.lit("Office of "), "o_orderpriority", F.lit(" Town"), (F.col("o_orderkey") % 13).cast("string")).alias("buyer"))
    text = table(spark, d, "customer").select(F.col("c_custkey").alias("g"), F.concat(F.lit("the Town"), (F.col("c_custkey") % 13).cast("string"), F.lit(" URGENT office")).alias("text"))
    return matching.chosen_by_tokens(o, "g", "k", "buyer", text, "text", 4)


@query("""WITH a AS (SELECT o_orderkey AS k, o_custkey, o_orderpriority || ' ' || (o_orderkey % 5) || 'kv line' AS title, CAST(o_orderdate AS DATE) AS due FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS k, o_custkey, o_orderpriority || ' ' || (o_orderkey % 5) || 'kv line' AS title, CAST(o_orderdate AS DATE) AS due FROM orders WHERE o_orderkey % 2 = 1),
w AS (SELECT k, o_custkey, due, list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3)) AS t FROM a), v AS (SELECT k, o_custkey, due, list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3)) AS t FROM b),
p AS (SELECT w.k, v.k AS other, len(list_intersect(w.t, v.t)) / least(len(w.t), len(v.t)) AS o, abs(date_diff('day', w.due, v.due)) AS gap FROM w JOIN v USING (o_custkey)), q AS (SELECT *, CASE WHEN gap <= 1 AND o >= 0.5 THEN 2 WHEN o >= 0.6 AND gap <= 7 THEN 1 END AS kind FROM p)
SELECT k, other, CASE kind WHEN 2 THEN 'strong' ELSE 'weak' END AS kind, o AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY kind DESC, o DESC, other) AS r FROM q WHERE kind IS NOT NULL) WHERE r = 1""")
def best_cross_source_match(spark, d):
    """The best partner of the same buyer with a deadline within a week: names overlap, near deadlines count more."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select(k.alias("k"), "o_custkey", F.concat("o_orderpriority", F.lit(" "), (k % 5).cast("string"), F.lit("kv line")).alias("title"), F.col("o_orderdate").cast("date").alias("due"))
    return matching.best_match(rows.filter("k % 2 = 0"), rows.filter("k % 2 = 1"), ["o_custkey"], "k", "title", "due")


@query("SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS k, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier")
def folded_keys(spark, d):
    from kelpie.functions.text import slugify

    return table(spark, d, "supplier").select("s_suppkey", key_fold(F.col("s_name")).alias("k"), slugify(F.col("s_name")).alias("slug"))
