"""Queries of a notice board: filters, redacted projections, access rules, orders and links. TODAY stands for the day."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.functions import access, arrays, dates, money, visits
from kelpie.functions.rules import derived_status, first_match
from kelpie.functions.text import search_match
from kelpie.operators import board as ops
from kelpie.plans import notices as base
from kelpie.session import table

QUERIES, ORACLE = {}, {}
TIER_WEIGHT = {"flagship": 3, "significant": 2, "standard": 1, "excluded": 0}
COUNTRIES = ["NATION_1", "NATION_2", "NATION_3", "NATION_7", "NATION_11", "NATION_20"]
INDUSTRIES = ["roads", "power", "water", "general"]
LIVE = ["open", "clarification"]
_T = f"DATE '{base.TODAY}'"
_WEIGHT = "CASE tier WHEN 'flagship' THEN 3 WHEN 'significant' THEN 2 WHEN 'standard' THEN 1 ELSE 0 END"
_B = f"""{base._S}, i AS (SELECT *, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS value, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'roads' END, CASE WHEN o_orderkey % 3 = 0 THEN 'power' END, CASE WHEN o_orderkey % 5 = 0 THEN 'water' END], lambda x: x IS NOT NULL) AS l
FROM s JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey), b AS (SELECT o_orderkey AS id, n_name AS country, c_name AS buyer, c_mktsegment AS platform, o_custkey, o_orderpriority AS scope, value, pub, deadline, stored, status,
CASE WHEN value IS NULL THEN 'standard' ELSE {base._TIER.format('value')} END AS tier, CASE WHEN len(l) = 0 THEN ['general'] ELSE l END AS industries FROM i)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _today():
    return F.lit(base.TODAY).cast("date")


def _board(spark, d):
    """One row a notice, with its buyer's country, industries, tier and status."""
    buyers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment").join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    value = F.when(k % 9 != 0, F.col("o_totalprice"))
    known = F.filter(F.array(F.when(k % 2 == 0, "roads"), F.when(k % 3 == 0, "power"), F.when(k % 5 == 0, "water")), lambda x: x.isNotNull())
    industries = F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("general")))
    tier = F.when(value.isNull(), "standard").otherwise(money.tier(value, base.TIERS, "excluded"))
    rows = base._notices(spark, d).withColumn("status", base._status()).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(k.alias("id"), F.col("n_name").alias("country"), F.col("c_name").alias("buyer"), F.col("c_mktsegment").alias("platform"), "o_custkey", F.col("o_orderpriority").alias("scope"), value.alias("value"), "pub", "deadline", "stored", "status", tier.alias("tier"), industries.alias("industries"))


def _weight():
    return F.when(F.col("tier") == "flagship", 3).when(F.col("tier") == "significant", 2).when(F.col("tier") == "standard", 1).otherwise(0)


def _live(df):
    return df.filter(F.col("status").isin(*LIVE) & (F.col("tier") != "excluded"))


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query(f"WITH {_B} SELECT id FROM b WHERE tier <> 'excluded' AND list_has_any(industries, ['roads', 'water']) AND status IN ('open', 'submission_closed') AND country IN ({_in(COUNTRIES)}) AND contains(lower(buyer), '00') AND contains(lower(buyer), 'customer')")
def list_facet_filter(spark, d):
    """All facets at once: any of some industries, states, countries, every word of a query; the excluded tier stays out."""
    chosen = {"status": ["open", "submission_closed"], "country": COUNTRIES, "scope": []}
    return ops.faceted(_board(spark, d), chosen, any_of={"industries": ["roads", "water"]}, hide={"tier": "excluded"}, text=F.col("buyer"), words="Customer 00").select("id")


@query(f"WITH {_B} SELECT id, tier FROM b WHERE tier IN ('standard', 'excluded') AND list_has_all(industries, ['roads', 'power'])")
def list_facet_all_industries(spark, d):
    """Every one of some industries, and the excluded tier too, since it is asked for."""
    return ops.faceted(_board(spark, d), {"tier": ["standard", "excluded"]}, all_of={"industries": ["roads", "power"]}).select("id", "tier")


@query(f"WITH {_B} SELECT id FROM b WHERE CASE WHEN country IN ('NATION_1', 'NATION_2') THEN contains(lower(concat_ws(' ', buyer, platform, scope)), 'customer#') ELSE contains(lower(concat_ws(' ', platform, scope)), 'customer#') END")
def search_scope(spark, d):
    """The buyer's name is searched only in the viewer's own countries."""
    full, public = access.searchable(F.col("buyer"), F.col("platform"), F.col("scope")), access.searchable(F.col("platform"), F.col("scope"))
    return _board(spark, d).filter(F.contains(access.scoped(F.col("country"), ["NATION_1", "NATION_2"], full, public), F.lit("customer#"))).select("id")


@query("SELECT p_partkey, lower(concat_ws(' ', nullif(trim(p_name), ''), CASE WHEN nullif(trim(p_type), '') IS DISTINCT FROM nullif(trim(p_name), '') THEN nullif(trim(p_type), '') END, CASE WHEN nullif(trim(split_part(p_type, ' ', 1)), '') IS DISTINCT FROM nullif(trim(p_type), '') THEN nullif(trim(split_part(p_type, ' ', 1)), '') END)) AS text FROM part")
def searchable_text(spark, d):
    first = F.split_part("p_type", F.lit(" "), F.lit(1))
    return table(spark, d, "part").select("p_partkey", access.searchable(F.col("p_name"), F.col("p_type"), first).alias("text"))


@query(f"""WITH {_B} SELECT id, o_custkey % 4 = 0 AS member, CASE WHEN o_custkey % 4 = 0 THEN buyer END AS buyer, CASE WHEN o_custkey % 4 = 0 THEN value END AS value, CASE WHEN o_custkey % 4 <> 0 THEN CAST(CASE WHEN value < 1000 THEN 0 WHEN value < 5000 THEN 1 WHEN value < 25000 THEN 2 WHEN value < 100000 THEN 3 WHEN value < 200000 THEN 4 WHEN value < 350000 THEN 5 WHEN value IS NOT NULL THEN 6 END AS INTEGER) END AS value_band,
CASE WHEN o_custkey % 4 = 0 THEN strftime(deadline, '%Y-%m-%d') ELSE strftime(deadline, '%Y-%m') END AS deadline FROM b""")
def list_projection(spark, d):
    """Members read the buyer, the amount and the day; everyone else a band and the month."""
    member = F.col("o_custkey") % 4 == 0
    return _board(spark, d).select(
        "id", member.alias("member"), F.when(member, F.col("buyer")).alias("buyer"), F.when(member, F.col("value")).alias("value"), F.when(~member, money.band(F.col("value"))).alias("value_band"),
        access.redacted(member, F.date_format("deadline", "yyyy-MM-dd"), dates.month_precision(F.col("deadline"))).alias("deadline"),
    )


@query(f"WITH {_B} SELECT id, country, tier, array_to_string(industries, ',') AS industries, strftime(pub, '%Y-%m-%d') AS created FROM b WHERE tier <> 'excluded' AND status = 'open'")
def notification_projection(spark, d):
    return _live(_board(spark, d)).select("id", "country", "tier", F.array_join("industries", ",").alias("industries"), F.date_format("pub", "yyyy-MM-dd").alias("created"))


@query(f"""WITH {_B} SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN platform END, 'notice of ' || country) AS title, CASE WHEN id % 3 = 0 THEN scope END AS summary, strftime(pub, '%Y-%m') AS published, strftime(deadline, '%Y-%m') AS due,
CAST(CASE WHEN value < 1000 THEN 0 WHEN value < 5000 THEN 1 WHEN value < 25000 THEN 2 WHEN value < 100000 THEN 3 WHEN value < 200000 THEN 4 WHEN value < 350000 THEN 5 WHEN value IS NOT NULL THEN 6 END AS INTEGER) AS band FROM b""")
def public_detail(spark, d):
    """The title falls back to another, the summary never does; days become months and amounts bands."""
    reviewed = F.col("id") % 3 == 0
    title = F.coalesce(F.when(reviewed, F.col("platform")), F.concat(F.lit("notice of "), F.col("country")))
    return _board(spark, d).select("id", title.alias("title"), F.when(reviewed, F.col("scope")).alias("summary"), dates.month_precision(F.col("pub")).alias("published"), dates.month_precision(F.col("deadline")).alias("due"), money.band(F.col("value")).alias("band"))


@query(f"""WITH {base._N}, k AS (SELECT l_orderkey, first(CAST(l_shipdate AS DATE) ORDER BY l_linenumber, l_partkey, l_shipdate) FILTER (WHERE l_returnflag = 'A') AS valid, bool_or(l_returnflag = 'R' AND CAST(l_shipdate AS DATE) = {_T}) AS talk FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN stored = 'planned' AND o_orderkey % 2 = 0 THEN 'planned' WHEN stored = 'awarded' AND NOT coalesce(deadline >= {_T}, false) THEN stored WHEN deadline < {_T} OR valid < {_T} THEN 'submission_closed' WHEN talk THEN 'clarification'
WHEN deadline IS NULL AND valid IS NULL AND o_orderkey % 7 <> 0 AND pub < {_T} - 45 THEN 'submission_closed' ELSE 'open' END AS status FROM n LEFT JOIN k ON l_orderkey = o_orderkey""")
def status_with_key_dates(spark, d):
    """The whole rule: preview sources, the first end of validity, a clarification meeting today, sources that close their own."""
    day = F.col("l_shipdate").cast("date")
    order = F.struct("l_linenumber", "l_partkey", "l_shipdate")
    found = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by(F.when(F.col("l_returnflag") == "A", day), F.when(F.col("l_returnflag") == "A", order)).alias("valid"), F.bool_or((F.col("l_returnflag") == "R") & (day == _today())).alias("talk"))
    rows = base._notices(spark, d).join(found, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    status = derived_status(F.col("stored"), F.col("deadline"), F.col("pub"), _today(), preview=F.col("o_orderkey") % 2 == 0, valid_until=F.col("valid"), clarifies_today=F.col("talk"), closed_by_import=F.col("o_orderkey") % 7 == 0)
    return rows.select("o_orderkey", status.alias("status"))


_SUBS = f"""u AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'active' WHEN 'MACHINERY' THEN 'trialing' WHEN 'FURNITURE' THEN 'past_due' ELSE 'canceled' END AS status, CASE WHEN c_custkey % 11 <> 0 THEN {_T} - CAST(c_custkey % 8 AS INTEGER) END AS began,
CASE WHEN c_custkey % 3 <> 0 THEN {_T} + CAST(c_custkey % 5 - 2 AS INTEGER) END AS ends, CASE c_nationkey % 3 WHEN 0 THEN 'basic' WHEN 1 THEN 'pro' ELSE 'team' END AS plan, CASE WHEN c_custkey % 2 = 0 THEN 'monthly' ELSE 'annual' END AS billed FROM customer)"""


def _subscriptions(spark, d):
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", F.when(segment == "BUILDING", "active").when(segment == "MACHINERY", "trialing").when(segment == "FURNITURE", "past_due").otherwise("canceled").alias("status"),
        F.when(k % 11 != 0, F.date_sub(_today(), (k % 8).cast("int"))).alias("began"), F.when(k % 3 != 0, F.date_add(_today(), (k % 5 - 2).cast("int"))).alias("ends"),
        F.when(F.col("c_nationkey") % 3 == 0, "basic").when(F.col("c_nationkey") % 3 == 1, "pro").otherwise("team").alias("plan"), F.when(k % 2 == 0, "monthly").otherwise("annual").alias("billed"),
    )


@query(f"WITH {_SUBS} SELECT c_custkey FROM u WHERE (status IN ('active', 'trialing') AND (ends IS NULL OR ends >= {_T})) OR (status = 'past_due' AND {_T} < began + 3)")
def entitled_accounts(spark, d):
    return _subscriptions(spark, d).filter(access.entitled(F.col("status"), F.col("began"), F.col("ends"), _today())).select("c_custkey")


@query(f"""WITH {_SUBS}, a AS (SELECT *, status = 'active' AS paid, CASE plan WHEN 'basic' THEN 10.0 WHEN 'pro' THEN 30.0 ELSE 90.0 END * CASE billed WHEN 'annual' THEN 10.0 / 12 ELSE 1 END AS price FROM u WHERE status IN ('active', 'trialing') AND (ends IS NULL OR ends > {_T}))
SELECT plan, count(DISTINCT c_custkey) AS users, count(DISTINCT c_custkey) FILTER (WHERE paid) AS paying, round(coalesce(sum(price) FILTER (WHERE paid), 0), 4) AS mrr FROM a GROUP BY plan""")
def plans_and_revenue(spark, d):
    """Distinct users of each plan; a year's price counts by the month."""
    live = _subscriptions(spark, d).filter(F.col("status").isin("active", "trialing") & (F.col("ends").isNull() | (F.col("ends") > _today())))
    price = F.when(F.col("plan") == "basic", 10.0).when(F.col("plan") == "pro", 30.0).otherwise(90.0) * F.when(F.col("billed") == "annual", 10.0 / 12).otherwise(1.0)
    paid = F.col("status") == "active"
    return live.groupBy("plan").agg(F.countDistinct("c_custkey").alias("users"), F.countDistinct(F.when(paid, F.col("c_custkey"))).alias("paying"), F.round(F.coalesce(F.sum(F.when(paid, price)), F.lit(0.0)), 4).alias("mrr"))


@query(f"""WITH {base._S}, r AS (SELECT *, CASE WHEN o_orderkey % 6 <> 0 THEN deadline END AS due, CASE WHEN o_orderkey % 4 = 0 THEN pub + 60 END AS won FROM s)
SELECT o_orderkey, strftime(CASE WHEN due IS NOT NULL THEN due + 3 WHEN stored = 'awarded' THEN coalesce(won, pub + 90) + 3 END, '%Y-%m-%d') AS opens, coalesce(CASE WHEN due IS NOT NULL THEN due + 3 WHEN stored = 'awarded' THEN coalesce(won, pub + 90) + 3 END <= {_T}, false) AS released FROM r""")
def released_after_deadline(spark, d):
    k = F.col("o_orderkey")
    day = access.release_day(F.col("stored"), F.when(k % 6 != 0, F.col("deadline")), F.when(k % 4 == 0, F.date_add("pub", 60)), F.date_add("pub", 90))
    return base._notices(spark, d).select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("opens"), F.coalesce(day <= _today(), F.lit(False)).alias("released"))


@query(f"WITH {_B} SELECT country, count(*) AS n FROM b WHERE country NOT IN ('NATION_5', 'NATION_6') GROUP BY 1")
def staged_countries(spark, d):
    """Countries that are not shown yet stay out."""
    return _board(spark, d).filter(~F.col("country").isin("NATION_5", "NATION_6")).groupBy("country").agg(F.count("*").alias("n"))


@query(f"""WITH {_B}, w AS (SELECT *, CASE WHEN id % 8 = 0 THEN 'excluded' ELSE tier END AS t, CASE WHEN id % 16 = 0 THEN 'short window' ELSE 'small' END AS why, coalesce(CASE WHEN id % 10 <> 0 THEN date_diff('day', pub, deadline) END < 20, false) AS short FROM b)
SELECT id, CASE WHEN id % 13 = 0 THEN NULL WHEN short AND t = 'standard' AND value IS NULL THEN 'exclude' WHEN NOT short AND t = 'excluded' AND why = 'short window' THEN 'restore' END AS action FROM w""")
def bid_window_decision(spark, d):
    k = F.col("id")
    action = access.bid_window_action(F.when(k % 8 == 0, "excluded").otherwise(F.col("tier")), F.col("value"), F.col("pub"), k % 10 == 0, F.col("deadline"), F.when(k % 16 == 0, "short window").otherwise("small"), k % 13 == 0, "short window", 20)
    return _board(spark, d).select("id", action.alias("action"))


@query(f"WITH {_B} SELECT id FROM b WHERE deadline >= DATE '1998-06-01' AND value IS NULL AND pub >= {_T} - 400 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_returnflag = 'R')")
def admin_filter(spark, d):
    """An open-ended day range, a missing amount, a recent notice, and no finished analysis."""
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    rows = ops.in_range(_board(spark, d), "deadline", "1998-06-01", None).filter(F.col("value").isNull() & (F.col("pub") >= F.date_sub(_today(), 400)))
    return rows.join(done, F.col("l_orderkey") == F.col("id"), "left_anti").select("id")


@query(f"WITH {_B} SELECT id FROM b WHERE tier <> 'excluded' AND status NOT IN ('awarded', 'submission_closed') AND id % 2 = 1 AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def documents_needed(spark, d):
    """Live notices with a flag whose documents nobody has read yet."""
    read = table(spark, d, "lineitem").filter("l_linestatus = 'F'").select("l_orderkey")
    rows = _board(spark, d).filter((F.col("tier") != "excluded") & ~F.col("status").isin("awarded", "submission_closed") & (F.col("id") % 2 == 1))
    return rows.join(read, F.col("l_orderkey") == F.col("id"), "left_anti").select("id")


@query(f"""WITH {_B} SELECT platform, count(*) AS n FROM b WHERE CASE platform WHEN 'BUILDING' THEN scope IN ('1-URGENT', '2-HIGH') WHEN 'MACHINERY' THEN value >= 100000 WHEN 'FURNITURE' THEN deadline IS NOT NULL AND NOT starts_with(buyer, 'Customer#00000000') WHEN 'HOUSEHOLD' THEN status <> 'awarded' ELSE false END GROUP BY 1""")
def source_gates(spark, d):
    """Each source admits by a rule of its own; a source without a rule admits nothing."""
    gates = {
        "BUILDING": F.col("scope").isin("1-URGENT", "2-HIGH"),
        "MACHINERY": F.col("value") >= 100_000,
        "FURNITURE": F.col("deadline").isNotNull() & ~F.startswith("buyer", F.lit("Customer#00000000")),
        "HOUSEHOLD": F.col("status") != "awarded",
    }
    return ops.admitted(_board(spark, d), "platform", gates).groupBy("platform").agg(F.count("*").alias("n"))


@query(r"""SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN p_brand IN ('Brand#11', 'Brand#55') THEN 'organ' WHEN p_size > 40 THEN 'stage' WHEN starts_with(p_type, 'PROMO') THEN 'form' WHEN NOT regexp_matches(lower(p_name), '\b(bolt|nut|ring|gear|screw|pipe|valve)') THEN 'keyword' WHEN p_retailprice < 950 THEN 'content' END AS reason FROM part) GROUP BY 1""")
def notice_verdict(spark, d):
    """Organ, stage, form, keyword, content: the first that fails names the reason."""
    rules = [("organ", F.col("p_brand").isin("Brand#11", "Brand#55")), ("stage", F.col("p_size") > 40), ("form", F.startswith("p_type", F.lit("PROMO"))), ("keyword", ~F.lower("p_name").rlike(r"\b(bolt|nut|ring|gear|screw|pipe|valve)")), ("content", F.col("p_retailprice") < 950)]
    return table(spark, d, "part").groupBy(first_match(rules, "kept").alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {_B}, o AS (SELECT *, row_number() OVER (PARTITION BY pub ORDER BY id) AS p, row_number() OVER (PARTITION BY pub, country ORDER BY id) AS turn FROM b), f AS (SELECT *, min(p) OVER (PARTITION BY pub, country) AS lead FROM o)
SELECT id, strftime(pub, '%Y-%m-%d') AS pub, row_number() OVER (PARTITION BY pub ORDER BY turn, lead) AS place FROM f""")
def sort_publication_interleave(spark, d):
    """Newest day first; inside a day countries take turns, in the order in which they first appear."""
    return ops.interleaved_runs(_board(spark, d), ["pub"], "country", [F.asc("id")]).select("id", F.date_format("pub", "yyyy-MM-dd").alias("pub"), "place")


@query(f"""WITH {_B}, l AS (SELECT * FROM b WHERE status IN ('open', 'clarification') AND tier <> 'excluded'), p AS (SELECT a.id, c.id AS other, len(list_intersect(list_filter(a.industries, lambda x: x <> 'general'), c.industries)) AS shared, {_WEIGHT.replace('tier', 'c.tier')} AS w, c.deadline AS due FROM l a JOIN l c ON a.country = c.country AND a.id <> c.id)
SELECT id, other, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, w DESC, due NULLS LAST, other) AS r FROM p) WHERE r <= 3""")
def related_items(spark, d):
    """Three live notices of the same country: shared industries, then tier, then deadline."""
    live = _live(_board(spark, d)).withColumn("weight", _weight())
    return ops.related(live, "id", "country", "industries", [F.desc("weight"), F.asc_nulls_last("deadline"), F.asc("id")], 3, ignore="general")


@query()
def showcase_quota(spark, d):
    """Two live notices of each industry, of different countries where one of the same tier exists, none twice."""
    live = _live(_board(spark, d)).withColumn("size", 3 - _weight())
    return ops.showcase(live, "id", "industries", "country", "size", ["deadline"], INDUSTRIES, 2)


@query(f"""WITH {_B}, f AS (SELECT id, row_number() OVER (ORDER BY id % 50 = 0 DESC, pub DESC, id) AS r FROM b), t AS (SELECT id, row_number() OVER (ORDER BY pub DESC, id) AS r FROM b WHERE id NOT IN (SELECT id FROM f WHERE r <= 6))
SELECT 'featured' AS part, id, CAST(r AS INTEGER) AS place FROM f WHERE r <= 6 UNION ALL SELECT 'ticker', id, CAST(r AS INTEGER) FROM t WHERE r <= 10""")
def homepage_featured_ticker(spark, d):
    """Six featured, flagged ones first; ten more by day for the ticker, none of the featured. The counts are the feature."""
    rows = _board(spark, d).select("id", "pub", (F.col("id") % 50 == 0).alias("flag"))
    featured = ops.first_rows(rows, [F.desc("flag"), F.desc("pub"), F.asc("id")], 6)
    ticker = ops.first_rows(rows.join(F.broadcast(featured.select("id")), "id", "left_anti"), [F.desc("pub"), F.asc("id")], 10)
    return featured.select(F.lit("featured").alias("part"), "id", "place").union(ticker.select(F.lit("ticker"), "id", "place"))


@query(f"""WITH {_B}, l AS (SELECT *, {_WEIGHT} AS w FROM b WHERE status IN ('open', 'clarification') AND tier <> 'excluded'), g AS (SELECT DISTINCT c_mktsegment AS platform, n_name AS country FROM customer JOIN nation ON n_nationkey = c_nationkey),
own AS (SELECT g.platform, g.country, l.id, row_number() OVER (PARTITION BY g.platform, g.country ORDER BY w DESC, deadline NULLS LAST, l.id) AS r FROM g JOIN l USING (platform, country)), any_ AS (SELECT g.platform, g.country, l.id, row_number() OVER (PARTITION BY g.platform, g.country ORDER BY w DESC, deadline NULLS LAST, l.id) AS r FROM g JOIN l ON l.country = g.country WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.platform = g.platform AND own.country = g.country))
SELECT platform, country, id, 'platform' AS scope, CAST(r AS INTEGER) AS place FROM own WHERE r <= 3 UNION ALL SELECT platform, country, id, 'country', CAST(r AS INTEGER) FROM any_ WHERE r <= 3""")
def guide_links(spark, d):
    """Three live notices of a guide's platform; without any, three of its country."""
    guides = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("platform"), F.col("n_name").alias("country")).distinct()
    live = _live(_board(spark, d)).withColumn("weight", _weight())
    return ops.links_with_fallback(guides, live, ["platform"], ["country"], [F.desc("weight"), F.asc_nulls_last("deadline"), F.asc("id")], "id", 3)


@query(f"WITH {_B} SELECT country, id, row_number() OVER (PARTITION BY country ORDER BY {_WEIGHT} DESC, deadline NULLS LAST, id) AS place FROM b WHERE tier <> 'excluded' AND pub BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'")
def published_range_links(spark, d):
    """What came out in a span of days, whatever became of it."""
    rows = ops.in_range(_board(spark, d), "pub", "1997-01-01", "1997-03-31").filter("tier <> 'excluded'")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("country").orderBy(_weight().desc(), F.asc_nulls_last("deadline"), F.asc("id")))).select("country", "id", "place")


@query(f"WITH {_B} SELECT id, CAST(row_number() OVER (ORDER BY pub DESC, id) AS INTEGER) AS place FROM b WHERE value IS NOT NULL ORDER BY place LIMIT 20")
def take_with_skip(spark, d):
    """Twenty rows that can be shown; those that cannot do not count. The number is the feature."""
    return ops.first_rows(_board(spark, d).filter("value is not null"), [F.desc("pub"), F.asc("id")], 20).select("id", "place")


@query("SELECT o_orderkey, CAST(pos AS INTEGER) AS pos FROM (SELECT unnest([7, 3, 5000, 1, 99999999, 42]) AS k, generate_subscripts([7, 3, 5000, 1, 99999999, 42], 1) - 1 AS pos) JOIN orders ON o_orderkey = k")
def ordered_lookup(spark, d):
    """Rows of some ids in the caller's order; unknown ids are skipped."""
    return ops.by_ids(table(spark, d, "orders"), "o_orderkey", [7, 3, 5000, 1, 99999999, 42]).select("o_orderkey", "pos")


@query(f"""WITH {_B} SELECT 'up' AS direction, id, CAST(r AS INTEGER) AS place FROM (SELECT id, row_number() OVER (ORDER BY value NULLS LAST, id) AS r FROM b) WHERE r <= 50 UNION ALL SELECT 'down', id, CAST(r AS INTEGER) FROM (SELECT id, row_number() OVER (ORDER BY value DESC NULLS LAST, id) AS r FROM b) WHERE r <= 50""")
def amount_sort(spark, d):
    """The first page either way; unknown amounts stand last in both."""
    rows = _board(spark, d).select("id", "value")
    up, down = (ops.first_rows(rows, [o, F.asc("id")], 50).select(F.lit(n).alias("direction"), "id", "place") for n, o in (("up", F.asc_nulls_last("value")), ("down", F.desc_nulls_last("value"))))
    return up.union(down)


_SEARCHES = [("s1", "NATION_1", None, 0, "1996-01-01"), ("s2", None, "water", 300_000, "1997-06-01"), ("s3", "NATION_2", "roads", 100_000, "1995-01-01"), ("s4", None, None, 440_000, "1992-01-01")]
_SEARCH_SQL = ", ".join(f"('{i}', {'NULL' if c is None else repr(c)}, {'NULL' if n is None else repr(n)}, {v}, DATE '{t}')" for i, c, n, v, t in _SEARCHES)


@query(f"""WITH {_B}, q(search, c, n, v, seen) AS (VALUES {_SEARCH_SQL}) SELECT search, id FROM b JOIN q ON (c IS NULL OR c = country) AND (n IS NULL OR list_contains(industries, n)) AND coalesce(value, 0) >= v AND pub > seen AND tier <> 'excluded' ORDER BY pub DESC, id, search LIMIT 50""")
def saved_search_alerts(spark, d):
    """All saved searches in one pass over the notices; the newest fifty alerts are the feature."""
    def condition(country, industry, least, seen):
        out = (F.coalesce("value", F.lit(0.0)) >= least) & (F.col("pub") > F.lit(seen).cast("date")) & (F.col("tier") != "excluded")
        out = out & (F.col("country") == country) if country else out
        return out & F.array_contains("industries", industry) if industry else out

    found = ops.matched_searches(_board(spark, d), {i: condition(*rest) for i, *rest in _SEARCHES}, "search")
    return found.orderBy(F.desc("pub"), "id", "search").limit(50).select("search", "id")


@query(f"""WITH {_B}, l AS (SELECT *, {_WEIGHT} AS w FROM b WHERE status IN ('open', 'clarification') AND tier <> 'excluded'), h AS (SELECT l.country, x.industry, l.id, l.w, l.deadline FROM l, LATERAL (SELECT unnest(l.industries) AS industry) x), m AS (SELECT c_custkey, h.id, row_number() OVER (PARTITION BY c_custkey ORDER BY w DESC, deadline NULLS LAST, h.id) AS r
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN h ON h.country = n_name AND h.industry = CASE c_mktsegment WHEN 'BUILDING' THEN 'roads' WHEN 'MACHINERY' THEN 'power' ELSE 'water' END) SELECT c_custkey, id, CAST(r AS INTEGER) AS place FROM m WHERE r <= 20""")
def digest_top(spark, d):
    """Each recipient's first twenty. Only the heads of each country and industry meet the recipients."""
    wanted = F.when(F.col("c_mktsegment") == "BUILDING", "roads").when(F.col("c_mktsegment") == "MACHINERY", "power").otherwise("water")
    people = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("country"), wanted.alias("industry"))
    order = [_weight().desc(), F.asc_nulls_last("deadline"), F.asc("id")]
    rows = _live(_board(spark, d)).withColumn("industry", F.explode("industries"))
    heads = rows.withColumn("place", F.row_number().over(W.partitionBy("country", "industry").orderBy(*order))).filter("place <= 20")
    return people.join(heads, ["country", "industry"]).select("c_custkey", "id", "place")


# A visit is a page's address: its host refers, its path is where the visit landed, and every third has a campaign word.
_VISITS = r"""v AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/.*)$', 1) AS path, CASE page_id % 6 WHEN 0 THEN 'Bulletin ' WHEN 3 THEN 'radio' END AS tag FROM pages)"""


def _visits(spark, d):
    k, url = F.col("page_id"), F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"), F.regexp_extract(url, "^https?://[^/]+(/.*)$", 1).alias("path"), F.when(k % 6 == 0, "Bulletin ").when(k % 6 == 3, "radio").alias("tag"))


@query(rf"""WITH {_VISITS} SELECT CASE WHEN page_id % 7 = 0 THEN 'not an entry' WHEN tag = 'Bulletin ' THEN 'mailing' WHEN tag IS NOT NULL THEN 'campaign' WHEN regexp_matches(host, '(^|\.)blog\.example\.(com|net)$') THEN 'press' WHEN regexp_matches(host, '(^|\.)m\.example\.com$') THEN 'mobile site'
WHEN regexp_matches(host, '(^|\.)example\.com$') THEN 'partner' WHEN regexp_matches(host, '(^|\.)example\.net$') THEN 'portal' WHEN regexp_matches(host, '(^|\.)example\.org$') THEN 'community' ELSE 'referral' END AS source, count(*) AS n FROM v GROUP BY 1""")
def traffic_sources(spark, d):
    source = visits.traffic_source(F.col("page_id") % 7 != 0, F.col("tag"), F.col("host"), F.lit(None).cast("string"))
    return _visits(spark, d).groupBy(source.alias("source")).agg(F.count("*").alias("n"))


@query(rf"""WITH {_VISITS}, c AS (SELECT regexp_replace(path, '[?#].*', '') AS p FROM v) SELECT CASE WHEN p IN ('', '/') THEN 'front' WHEN regexp_matches(p, '^/en(/|$)') THEN 'english' WHEN regexp_matches(p, '^/de(/|$)') THEN 'german' WHEN regexp_matches(p, '^/fr(/|$)') THEN 'french' WHEN regexp_matches(p, '^/es(/|$)') THEN 'spanish' ELSE substr(p, 1, {visits.SHOWN}) END AS landing, count(*) AS n FROM c GROUP BY 1""")
def landing_groups(spark, d):
    return _visits(spark, d).groupBy(visits.landing_group(F.col("path")).alias("landing")).agg(F.count("*").alias("n"))


_AGENTS = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Mozilla/5.0 (' WHEN 1 THEN 'Agent (' ELSE '(' END || event_type || '; ' || CASE user_id % 7 WHEN 0 THEN 'X11; CrOS x86_64' WHEN 1 THEN 'Linux; Android 14' WHEN 2 THEN 'iPad; CPU OS 17' WHEN 3 THEN 'Windows NT 10.0' WHEN 4 THEN 'Linux x86_64' ELSE '' END || ') ' ||
CASE user_id % 5 WHEN 0 THEN 'Chrome/120 Safari/537' WHEN 1 THEN 'Chrome/120 Safari/537 Edg/120' WHEN 2 THEN 'Firefox/121' WHEN 3 THEN 'safari-like' ELSE 'Version/17 Safari/604' END AS agent FROM events"""


@query(rf"""WITH v AS ({_AGENTS}), s AS (SELECT CASE WHEN regexp_matches(agent, 'CrOS') THEN 'ChromeOS' WHEN regexp_matches(agent, 'Android') THEN 'Android' WHEN regexp_matches(agent, 'iPad') THEN 'iPadOS' WHEN regexp_matches(agent, 'Windows') THEN 'Windows' WHEN regexp_matches(agent, 'Linux') THEN 'Linux' END AS system,
CASE WHEN regexp_matches(agent, 'Edg/') THEN 'Edge' WHEN regexp_matches(agent, 'Firefox/') THEN 'Firefox' WHEN regexp_matches(agent, 'Chrome/') THEN 'Chrome' WHEN regexp_matches(agent, 'Safari/') THEN 'Safari' END AS browser FROM v)
SELECT coalesce(nullif(concat_ws(', ', system, browser), ''), 'unknown') AS device, count(*) AS n FROM s GROUP BY 1""")
def devices(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    system = F.when(u % 7 == 0, "X11; CrOS x86_64").when(u % 7 == 1, "Linux; Android 14").when(u % 7 == 2, "iPad; CPU OS 17").when(u % 7 == 3, "Windows NT 10.0").when(u % 7 == 4, "Linux x86_64").otherwise("")
    product = F.when(u % 5 == 0, "Chrome/120 Safari/537").when(u % 5 == 1, "Chrome/120 Safari/537 Edg/120").when(u % 5 == 2, "Firefox/121").when(u % 5 == 3, "safari-like").otherwise("Version/17 Safari/604")
    head = F.when(e % 3 == 0, "Mozilla/5.0 (").when(e % 3 == 1, "Agent (").otherwise("(")
    agent = F.concat(head, "event_type", F.lit("; "), system, F.lit(") "), product)
    return table(spark, d, "events").groupBy(visits.device(agent).alias("device")).agg(F.count("*").alias("n"))


@query(f"WITH {_B}, p AS (SELECT *, CASE WHEN id % 3 = 0 THEN ['water', 'general'] ELSE ['roads'] END AS other FROM b) SELECT id, list_sort(industries) = list_sort(other) AS same, array_to_string(CASE WHEN len(m) > 0 THEN m ELSE ['general'] END, ',') AS merged FROM (SELECT *, list_filter(industries, lambda x: x <> 'general') || list_filter(other, lambda x: x <> 'general' AND NOT list_contains(industries, x)) AS m FROM p)")
def industry_arrays(spark, d):
    """Equal sets, and both arrays merged without the fallback."""
    other = F.when(F.col("id") % 3 == 0, F.array(F.lit("water"), F.lit("general"))).otherwise(F.array(F.lit("roads")))
    return _board(spark, d).select("id", arrays.same_set(F.col("industries"), other).alias("same"), F.array_join(arrays.merged_without(F.col("industries"), other, "general"), ",").alias("merged"))


@query(f"WITH {_B} SELECT country, chunk, count(*) AS n, min(id) AS first FROM (SELECT country, id, CAST((row_number() OVER (PARTITION BY country ORDER BY id) - 1) // 100 AS BIGINT) AS chunk FROM b) GROUP BY 1, 2")
def chunks_by_size(spark, d):
    """Batches of a hundred rows inside each country."""
    rows = _board(spark, d).select("country", "id").withColumn("chunk", arrays.chunk_of(["country"], [F.asc("id")], 100))
    return rows.groupBy("country", "chunk").agg(F.count("*").alias("n"), F.min("id").alias("first"))


_PAGE = f"""{_B}, f AS (SELECT * FROM b WHERE tier <> 'excluded' AND list_has_any(industries, ['roads', 'water', 'power']) AND status IN ('open', 'planned', 'clarification')), h AS (SELECT * FROM (SELECT *, dense_rank() OVER (ORDER BY pub DESC) AS run FROM f)), o AS (SELECT *, row_number() OVER (PARTITION BY pub ORDER BY id) AS p, row_number() OVER (PARTITION BY pub, country ORDER BY id) AS turn FROM h), l AS (SELECT *, min(p) OVER (PARTITION BY pub, country) AS lead FROM o)"""


@query(f"""WITH {_PAGE} SELECT id, country, tier, status, array_to_string(industries, ',') AS industries, CASE WHEN o_custkey % 4 = 0 THEN value END AS value, CASE WHEN o_custkey % 4 <> 0 THEN CAST(CASE WHEN value < 1000 THEN 0 WHEN value < 5000 THEN 1 WHEN value < 25000 THEN 2 WHEN value < 100000 THEN 3 WHEN value < 200000 THEN 4 WHEN value < 350000 THEN 5 WHEN value IS NOT NULL THEN 6 END AS INTEGER) END AS value_band,
CASE WHEN o_custkey % 4 = 0 THEN strftime(deadline, '%Y-%m-%d') ELSE strftime(deadline, '%Y-%m') END AS deadline, CAST(row_number() OVER (ORDER BY pub DESC, turn, lead) AS INTEGER) AS place, (SELECT count(*) FROM f WHERE status = 'open') AS live, (SELECT count(*) FROM f WHERE deadline BETWEEN {_T} AND {_T} + 5) AS due FROM l ORDER BY pub DESC, turn, lead LIMIT {base.PAGE_ROWS}""")
def board_page(spark, d):
    """The first page as a visitor reads it: facets, derived status, redacted values, countries in turns inside a day, and the
    counters above the list. A page is the feature; only the newest days that fill it are put in turns."""
    rows = ops.faceted(_board(spark, d), {"status": ["open", "planned", "clarification"]}, any_of={"industries": ["roads", "water", "power"]}, hide={"tier": "excluded"})
    counters = rows.agg(F.count_if(F.col("status") == "open").alias("live"), F.count_if(F.col("deadline").between(_today(), F.date_add(_today(), 5))).alias("due"))
    days = rows.groupBy("pub").agg(F.count("*").alias("n")).orderBy(F.desc("pub")).limit(base.PAGE_ROWS).select("pub")  # each day has a row
    near = rows.join(F.broadcast(days), "pub", "left_semi")
    turns = ops.interleaved_runs(near, ["pub"], "country", [F.asc("id")]).withColumnRenamed("place", "turn")
    page = ops.first_rows(turns, [F.desc("pub"), F.asc("turn")], base.PAGE_ROWS)
    member = F.col("o_custkey") % 4 == 0
    return page.join(F.broadcast(counters)).select(
        "id", "country", "tier", "status", F.array_join("industries", ",").alias("industries"), F.when(member, F.col("value")).alias("value"), F.when(~member, money.band(F.col("value"))).alias("value_band"),
        access.redacted(member, F.date_format("deadline", "yyyy-MM-dd"), dates.month_precision(F.col("deadline"))).alias("deadline"), "place", "live", "due",
    )


def _deadline_sql(sign: str) -> str:
    return f"""WITH {_B}, k AS (SELECT id, country, CASE WHEN deadline >= {_T} AND status IN ('open', 'clarification') THEN 0 WHEN status = 'planned' THEN 1 WHEN status = 'suspended' THEN 2 WHEN status = 'awarded' THEN 3 WHEN deadline >= {_T} THEN 4 ELSE 5 END AS class,
coalesce(deadline >= {_T}, false) AS coming, CASE WHEN deadline >= {_T} THEN deadline ELSE pub END AS day FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY class, coming, day ORDER BY id) AS p, row_number() OVER (PARTITION BY class, coming, day, country ORDER BY id) AS turn FROM k),
l AS (SELECT *, min(p) OVER (PARTITION BY class, coming, day, country) AS lead, CASE WHEN coming THEN {sign} ELSE -1 END * date_diff('day', DATE '1970-01-01', day) AS far FROM p)
SELECT id, CAST(class AS INTEGER) AS class, row_number() OVER (ORDER BY class, coming DESC, far NULLS LAST, turn, lead) AS place FROM l ORDER BY place LIMIT {base.PAGE_ROWS}"""


def _by_deadline(spark, d, descending):
    out = ops.deadline_page(_board(spark, d), "id", "status", "deadline", "pub", "country", _today(), base.PAGE_ROWS, descending=descending)
    return out.select("id", "class", F.col("place").cast("long").alias("place"))


@query(_deadline_sql("1"))
def board_by_deadline(spark, d):
    """The first page by deadline on the derived status, near days first, countries in turns inside a day."""
    return _by_deadline(spark, d, False)


@query(_deadline_sql("-1"))
def board_by_far_deadline(spark, d):
    """The same with far days first; classes keep their order."""
    return _by_deadline(spark, d, True)


@query()
def sort_recommended(spark, d):
    """Live notices with a coming deadline: the showcase first, then by size and deadline with countries in turns; the rest
    by deadline classes and days, with countries in turns inside a day."""
    rows = _board(spark, d).filter("tier <> 'excluded'").withColumn("size", 3 - _weight())
    rows, _, runs = ops.deadline_runs(rows, "status", "deadline", "pub", _today())
    live = rows.filter("class = 0")
    picks = ops.showcase(live, "id", "industries", "country", "size", ["deadline"], INDUSTRIES, 2).select("id", F.lit(0).alias("section"))
    marked = rows.join(F.broadcast(picks), "id", "left").withColumn("section", F.coalesce("section", F.when(F.col("class") == 0, 1).otherwise(2)))
    order = [F.asc_nulls_last("deadline"), F.asc("id")]
    head = marked.filter("section < 2").withColumn("run", F.when(F.col("section") == 1, F.col("deadline")))
    head = ops.interleaved_runs(head, ["section", "size", "run"], "country", order)
    tail = ops.interleaved_runs(marked.filter("section = 2").withColumn("run", F.col("run_")), ["section", *runs], "country", [F.asc("id")])
    return head.unionByName(tail).select("id", "section", "class", "size", F.date_format("run", "yyyy-MM-dd").alias("run"), "place", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"))


_R = """r AS (SELECT p_partkey, lower(p_name) AS t, p_type AS kind, p_size AS size, CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice * (p_partkey % 400) END AS v, p_partkey % 6 = 0 AS major, p_partkey % 300 AS days, p_partkey % 4 = 0 AS local, p_brand FROM part)"""


@query(f"""WITH {_R} SELECT reason, tier, count(*) AS n FROM (SELECT CASE WHEN kind = 'PROMO' AND size < 5 THEN 'price only' WHEN p_brand = 'Brand#11' THEN 'direct award' WHEN kind = 'SMALL' AND size < 10 THEN 'price comparison' WHEN regexp_matches(t, '^old ') AND NOT major THEN 'maintenance' WHEN local AND v < 5000 THEN 'small local band' WHEN regexp_matches(t, '\\bplate\\b') AND size > 45 THEN 'no procurement'
WHEN regexp_matches(t, 'gizmo') AND days < 20 THEN 'rental' WHEN p_brand IN ('Brand#55', 'Brand#44') AND major THEN 'included' WHEN t = '' THEN 'no content' WHEN p_brand = 'Brand#12' THEN 'excluded buyer' WHEN regexp_matches(t, '^small (ring|nut)') THEN 'excluded words' WHEN kind = 'STANDARD' AND size = 1 THEN 'insurance' WHEN regexp_matches(t, 'bolt') AND v < 20000 THEN 'bare materials' WHEN local AND regexp_matches(t, 'cold') THEN 'municipal'
WHEN kind = 'ECONOMY' AND days BETWEEN 1 AND 30 THEN 'short term' WHEN v < 20000 THEN 'value floor' WHEN v < 40000 AND size < 10 THEN 'small works' WHEN major AND v < 60000 THEN 'demoted' WHEN v >= 300000 OR (major AND v >= 200000) THEN 'flagship' WHEN v >= 150000 THEN 'significant' WHEN v IS NULL AND local THEN 'undisclosed local' WHEN v IS NULL AND major THEN 'undisclosed major' WHEN NOT regexp_matches(t, 'widget|gear|bolt|ring|plate|valve|gizmo|screw|nut') THEN 'no industry' ELSE 'standard' END AS reason FROM r) z
JOIN (VALUES ('price only', 'excluded'), ('direct award', 'excluded'), ('price comparison', 'excluded'), ('maintenance', 'excluded'), ('small local band', 'excluded'), ('no procurement', 'excluded'), ('rental', 'excluded'), ('included', 'significant'), ('no content', 'excluded'), ('excluded buyer', 'excluded'), ('excluded words', 'excluded'), ('insurance', 'excluded'), ('bare materials', 'excluded'), ('municipal', 'excluded'), ('short term', 'excluded'), ('value floor', 'excluded'), ('small works', 'excluded'), ('demoted', 'standard'), ('flagship', 'flagship'), ('significant', 'significant'), ('undisclosed local', 'excluded'), ('undisclosed major', 'significant'), ('no industry', 'excluded'), ('standard', 'standard')) m(reason, tier) USING (reason) GROUP BY 1, 2""")
def relevance_reasons(spark, d):
    """A long decision list with its reasons: what is no procurement, what is too small, what is raised and why."""
    k, t, v = F.col("p_partkey"), F.lower("p_name"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice") * (F.col("p_partkey") % 400))
    kind, size, brand, major, days, local = F.col("p_type"), F.col("p_size"), F.col("p_brand"), k % 6 == 0, k % 300, k % 4 == 0
    rules = [
        ("price only", "excluded", (kind == "PROMO") & (size < 5)), ("direct award", "excluded", brand == "Brand#11"), ("price comparison", "excluded", (kind == "SMALL") & (size < 10)),
        ("maintenance", "excluded", t.rlike("^old ") & ~major), ("small local band", "excluded", local & (v < 5000)), ("no procurement", "excluded", t.rlike(r"\bplate\b") & (size > 45)),
        ("rental", "excluded", t.rlike("gizmo") & (days < 20)), ("included", "significant", brand.isin("Brand#55", "Brand#44") & major), ("no content", "excluded", t == ""), ("excluded buyer", "excluded", brand == "Brand#12"),
        ("excluded words", "excluded", t.rlike("^small (ring|nut)")), ("insurance", "excluded", (kind == "STANDARD") & (size == 1)), ("bare materials", "excluded", t.rlike("bolt") & (v < 20_000)), ("municipal", "excluded", local & t.rlike("cold")),
        ("short term", "excluded", (kind == "ECONOMY") & days.between(1, 30)), ("value floor", "excluded", v < 20_000), ("small works", "excluded", (v < 40_000) & (size < 10)), ("demoted", "standard", major & (v < 60_000)),
        ("flagship", "flagship", (v >= 300_000) | (major & (v >= 200_000))), ("significant", "significant", v >= 150_000), ("undisclosed local", "excluded", v.isNull() & local), ("undisclosed major", "significant", v.isNull() & major),
        ("no industry", "excluded", ~t.rlike("widget|gear|bolt|ring|plate|valve|gizmo|screw|nut")),
    ]
    reason = first_match([(n, c) for n, _, c in rules], "standard")
    tiers = F.create_map(*[F.lit(x) for n, tier, _ in [*rules, ("standard", "standard", None)] for x in (n, tier)])
    return table(spark, d, "part").select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).select("reason", F.element_at(tiers, F.col("reason")).alias("tier"), "n")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'excluded' WHEN 1 THEN 'roads' WHEN 2 THEN 'water' WHEN 3 THEN 'small works' ELSE 'none' END AS rule, p_partkey % 3 = 0 AS renewable, CASE p_partkey % 4 WHEN 0 THEN 'awarded' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'open' ELSE 'unknown' END AS status, CASE p_partkey % 2 WHEN 0 THEN 'works' ELSE 'goods' END AS scope FROM part""")
def source_wordings(spark, d):
    """Rules over accented Portuguese wording, renewable energy, and what sources call their states and scopes."""
    from kelpie.functions.wordings import PORTUGUESE, SCOPES, STATES, renewable, worded

    k = F.col("p_partkey")

    def pick(by, values):
        out = F.lit(None).cast("string")
        for i, v in enumerate(values):
            out = F.when(by == i, v).otherwise(out)
        return out

    text = pick(k % 5, ["Locação de veículos", "Pavimentação da RODOVIA", "Estação de tratamento de água", "Reforma da praça", "Aquisição de outros"])
    energy = F.when(k % 3 == 0, "Planta FOTOVOLTAICA de 20 MW").otherwise("Planta de gas")
    return table(spark, d, "part").select(
        "p_partkey", worded(text, PORTUGUESE, "none").alias("rule"), renewable(energy).alias("renewable"),
        worded(pick(k % 4, ["ADJUDICADO ", "Cancelada", "Em andamento / ABERTO", "?"]), STATES, "unknown").alias("status"), worded(F.when(k % 2 == 0, "Ejecución de obra").otherwise("Adquisición de bienes"), SCOPES, "other").alias("scope"),
    )
