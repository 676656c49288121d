"""Rows out of web pages by XML and by grids, and search in a stored index."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.operators.search_index import SearchIndex
from kelpie.plans.texts import ORACLE as TEXTS
from kelpie.session import shared_folder, table
from kelpie.sources import markup

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


_NAV = "SELECT page_id, regexp_extract(html, '(?s)<nav>.*?</nav>') AS nav FROM pages"


@query(rf"""WITH n AS ({_NAV}), g AS (SELECT page_id, regexp_extract_all(nav, '(?s)<li><a href="([^"]*)">(?:[^<]*)</a></li>', 1) AS h, regexp_extract_all(nav, '(?s)<li><a href="(?:[^"]*)">([^<]*)</a></li>', 1) AS l FROM n WHERE page_id % 10 <> 3 AND nav <> '')
SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS position, unnest(h) AS link, trim(unnest(l)) AS label FROM g UNION ALL SELECT page_id, -1, NULL, 'broken' FROM n WHERE page_id % 10 = 3 OR nav = ''""")
def page_navigation(spark, d):
    """The links of each page's navigation, read as XML; every tenth page's is broken and kept apart."""
    nav = F.regexp_replace(F.regexp_extract("html", "(?s)<nav>.*?</nav>", 0), "</nav>", F.when(F.col("page_id") % 10 == 3, "").otherwise("</nav>"))
    good, bad = markup.parsed_xml(table(spark, d, "pages").select("page_id", nav.alias("nav")), "nav", "ul struct<li: array<struct<a: struct<_href: string, _VALUE: string>>>>", "read")
    rows = good.select("page_id", F.posexplode("read.ul.li").alias("position", "item")).select("page_id", "position", F.col("item.a._href").alias("link"), F.trim("item.a._VALUE").alias("label"))
    return rows.unionByName(bad.select("page_id", F.lit(-1).alias("position"), F.lit(None).cast("string").alias("link"), F.lit("broken").alias("label")))


@query("SELECT o_orderkey, 0 AS grid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS VARCHAR) || '<' || l_returnflag || l_linestatus) AS INTEGER) AS row, CAST(l_quantity AS VARCHAR) AS quantity, l_returnflag || ' & ' || l_linestatus AS state FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def order_grids(spark, d):
    """Orders written as HTML tables with unclosed cells, and read back by their headers."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.concat(F.lit("<tr class=x><td>"), F.col("l_quantity").cast("string"), F.lit("<td><b>"), "l_returnflag", F.lit("</b> &amp; "), "l_linestatus", F.lit("</td></tr>\n")).alias("html"))
    pages = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["html"]), "").alias("rows"))
    pages = pages.select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("<TABLE border=0><tr><th>The  Quantity<th>Line state</tr>"), "rows", F.lit("</table>")).alias("html"))
    return markup.table_rows(pages, ["o_orderkey"], "html", {"quantity": "quantity$", "state": "^line"})


@query(TEXTS["text_search_all_words"])
def text_search_indexed(spark, d):
    """The same rows as text_search_all_words, from the postings of a stored index alone."""
    index = SearchIndex(spark, shared_folder(spark, "search-index"))
    index.add(table(spark, d, "documents"), "doc_id", "text")
    return index.search("That hand").select(F.col("id").alias("doc_id"))
