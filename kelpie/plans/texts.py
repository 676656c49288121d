"""Queries over texts: search, tags, phrases, scores of parts, links in pages, amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions.rules import tags
from kelpie.functions.text import bounded_count, search_match
from kelpie.operators import texts as ops
from kelpie.session import table

QUERIES, ORACLE = {}, {}
INDUSTRIES = {"fasteners": r"\b(bolt|screw|nut)\b", "rings": r"\b(ring|washer)\b", "small": r"^small\b"}
BUDGET = 400
_FOLD = "translate({0}, 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ', 'aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY')"
_SPACED = "trim(regexp_replace(lower(" + _FOLD + r"), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_TURNS = "t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS size, least(4, (length(text) - length(replace(text, 'the', ''))) // 3) AS score FROM conversations)"


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _turns(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", F.char_length(text).cast("long").alias("size"), bounded_count(F.col("text"), "the").alias("score"))


@query(f"WITH s AS (SELECT doc_id, {_SPACED.format('text')} AS t FROM documents) SELECT doc_id FROM s WHERE (contains(t, 'that') OR contains(replace(t, ' ', ''), 'that')) AND (contains(t, 'hand') OR contains(replace(t, ' ', ''), 'hand'))")
def text_search_all_words(spark, d):
    return table(spark, d, "documents").filter(search_match(F.col("text"), "That hand")).select("doc_id")


@query(r"""SELECT p_partkey, CASE WHEN tags = '' THEN 'general' ELSE tags END AS tags FROM (SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(p_name, '\b(bolt|screw|nut)\b') THEN 'fasteners' END,
CASE WHEN regexp_matches(p_name, '\b(ring|washer)\b') THEN 'rings' END, CASE WHEN regexp_matches(p_name, '^small\b') THEN 'small' END) AS tags FROM part)""")
def industry_tags(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(tags(F.col("p_name"), INDUSTRIES, "general"), ",").alias("tags"))


@query(f"""WITH d AS (SELECT doc_id, ' ' || {_SPACED.format('text')} || ' ' AS t FROM documents), b AS (SELECT item_id, {_SPACED.format("split_part(text, '.', 1)")} AS p FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON p <> '' AND contains(t, ' ' || p || ' ')""")
def contained_phrases(spark, d):
    """Documents that hold the first sentence of a known item, word for word."""
    known = table(spark, d, "benchmark").select("item_id", F.split_part("text", F.lit("."), F.lit(1)).alias("phrase"))
    return ops.contained_phrases(table(spark, d, "documents"), "doc_id", "text", known, "item_id", "phrase")


@query("""WITH p AS (SELECT DISTINCT p_brand, p_type, p_name, list_distinct(list_filter(string_split(p_name, ' '), lambda x: length(x) >= 3)) AS t FROM part), n AS (SELECT p_name || '|' || p_type AS k, p_brand, p_type, t FROM p)
SELECT a.k AS a, b.k AS b, len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) AS overlap FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_type = 'SMALL' AND b.p_type = 'ECONOMY' AND len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) >= 0.5
GROUP BY ALL""")
def token_overlap_join(spark, d):
    """Names of two types under one brand that share half the tokens of the shorter name; blocks are brands."""
    names = table(spark, d, "part").select("p_brand", "p_type", "p_name").distinct().withColumn("k", F.concat_ws("|", "p_name", "p_type"))
    a, b = (names.filter(F.col("p_type") == t).select("p_brand", F.col("k").alias(k), F.col("p_name").alias(f"{k}_name")) for t, k in (("SMALL", "a"), ("ECONOMY", "b")))
    return ops.similar_names(a, b, ["p_brand"], "a", "b", "a_name", "b_name", 0.5)


@query(f"WITH {_TURNS} SELECT conv_id, turn, round(score + 0.3 * (coalesce(lag(score) OVER w, 0) + coalesce(lead(score) OVER w, 0)), 6) AS smooth FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbour_smooth(spark, d):
    t = _turns(spark, d)
    return t.select("conv_id", "turn", F.round(ops.smoothed(t, ["conv_id"], "turn", "score").cast("double"), 6).alias("smooth"))


@query(f"WITH {_TURNS} SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY score DESC NULLS LAST, turn ROWS UNBOUNDED PRECEDING) AS used FROM t) WHERE used <= {BUDGET}")
def budget_trim(spark, d):
    return ops.within_budget(_turns(spark, d), ["conv_id"], [F.desc_nulls_last("score"), F.asc("turn")], "size", BUDGET).select("conv_id", "turn", "used")


@query(f"WITH {_TURNS}, r AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM t WHERE size > 60) SELECT conv_id, min(turn) AS first, max(turn) AS last FROM r GROUP BY conv_id, g")
def page_ranges(spark, d):
    """Runs of consecutive long turns."""
    return ops.ranges(_turns(spark, d).filter("size > 60").select("conv_id", "turn"), ["conv_id"], "turn")


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages""")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,9}')) AS m FROM documents) SELECT doc_id, count(*) AS n, max(CAST(m AS BIGINT)) AS largest FROM m GROUP BY 1""")
def amounts_in_text(spark, d):
    """Whole numbers of a text, read in pieces of up to nine digits."""
    found = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{1,9}"), F.lit(0))).alias("m"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("m").cast("long")).alias("largest"))
