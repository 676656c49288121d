"""Queries on known strings inside texts and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.operators import containment as ops
from kelpie.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


@query("""WITH k AS (SELECT DISTINCT substr(text, 1, n) AS number FROM benchmark, (VALUES (12), (20), (28)) v(n)), h AS (SELECT doc_id, number FROM documents JOIN k ON number <> '' AND contains(text, number)),
b AS (SELECT doc_id, max(length(number)) AS longest FROM h GROUP BY 1), t AS (SELECT doc_id, list_sort(list(DISTINCT number)) AS found FROM h JOIN b USING (doc_id) WHERE length(number) = longest GROUP BY 1)
SELECT doc_id, CASE WHEN len(found) = 1 THEN found[1] END AS number, len(found) AS found FROM t""")
def containment_longest(spark, d):
    """The longest beginning of a known item that a document holds: 12, 20 or 28 characters; null where two are longest."""
    items = table(spark, d, "benchmark")
    known = items.select(F.explode(F.array(*[F.substring("text", 1, n) for n in (12, 20, 28)])).alias("number"))
    out = ops.longest_contained(table(spark, d, "documents"), ["doc_id"], F.col("text"), known, F.col("number"))
    return out.select("doc_id", "number", F.size("found").cast("long").alias("found"))


_FILES = """k AS (SELECT s_suppkey AS id, upper('Lp-' || CAST(1000 + s_suppkey AS VARCHAR) || '/' || CAST(s_nationkey AS VARCHAR) || ' of ' || s_name) AS number FROM supplier),
p AS (SELECT o_orderkey, a.number AS a, b.number AS b FROM orders JOIN (SELECT max(s_suppkey) AS n FROM supplier) ON true JOIN k a ON a.id = o_orderkey % n + 1 JOIN k b ON b.id = o_custkey % n + 1),
f AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Copy ' || lower(a) || '.pdf' WHEN 1 THEN replace(replace(a, '/', '_'), '#', '') || '.pdf' WHEN 2 THEN replace(a, '-', '') || ' ' || replace(b, '-', '') WHEN 3 THEN a || b ELSE 'scan.pdf' END AS name,
CASE WHEN o_orderkey % 6 = 4 THEN 'on ' || a || ' only' WHEN o_orderkey % 6 = 5 THEN NULL ELSE 'see ' || b END AS text FROM p)"""


@query(f"""WITH {_FILES}, n AS (SELECT DISTINCT number, regexp_replace(lower(number), '[^a-z0-9]+', '', 'g') AS folded FROM k),
h1 AS (SELECT o_orderkey, number FROM f JOIN n ON contains(upper(name), number)), b1 AS (SELECT o_orderkey, list_sort(list(DISTINCT number)) AS found FROM h1 WHERE length(number) = (SELECT max(length(x.number)) FROM h1 x WHERE x.o_orderkey = h1.o_orderkey) GROUP BY 1),
h2 AS (SELECT o_orderkey, number, folded FROM f JOIN n ON length(folded) >= 12 AND contains(regexp_replace(lower(name), '[^a-z0-9]+', '', 'g'), folded) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b1)),
b2 AS (SELECT o_orderkey, list_sort(list(DISTINCT number)) AS found FROM h2 WHERE NOT EXISTS (SELECT 1 FROM h2 y WHERE y.o_orderkey = h2.o_orderkey AND length(y.folded) > length(h2.folded) AND contains(y.folded, h2.folded)) GROUP BY 1),
h3 AS (SELECT o_orderkey, number FROM f JOIN n ON contains(upper(text), number) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b1) AND o_orderkey NOT IN (SELECT o_orderkey FROM b2 WHERE len(found) = 1)),
b3 AS (SELECT o_orderkey, list_sort(list(DISTINCT number)) AS found FROM h3 WHERE length(number) = (SELECT max(length(x.number)) FROM h3 x WHERE x.o_orderkey = h3.o_orderkey) GROUP BY 1),
a AS (SELECT o_orderkey, found, 'name' AS source FROM b1 UNION ALL SELECT o_orderkey, found, 'squashed name' FROM b2 WHERE len(found) = 1 UNION ALL SELECT o_orderkey, found, 'text' FROM b3 UNION ALL SELECT o_orderkey, found, 'squashed name' FROM b2 WHERE len(found) > 1 AND o_orderkey NOT IN (SELECT o_orderkey FROM b3))
SELECT o_orderkey, CASE WHEN len(found) = 1 THEN found[1] END AS number, array_to_string(found, '|') AS found, source FROM a""")
def identified_files(spark, d):
    """The notice number that a file is about, from its name, its name without separators, or its text."""
    s, o = table(spark, d, "supplier"), table(spark, d, "orders")
    number = F.upper(F.concat(F.lit("Lp-"), (F.col("s_suppkey") + 1000).cast("string"), F.lit("/"), F.col("s_nationkey").cast("string"), F.lit(" of "), F.col("s_name")))
    known = s.select(F.col("s_suppkey").alias("id"), number.alias("number"))
    n = s.agg(F.max("s_suppkey").alias("n"))
    a, b = (known.select(F.col("id").alias(f"{c}_id"), F.col("number").alias(c)) for c in "ab")
    keyed = o.join(F.broadcast(n)).select("o_orderkey", (F.col("o_orderkey") % F.col("n") + 1).alias("a_id"), (F.col("o_custkey") % F.col("n") + 1).alias("b_id"))
    pairs, kind = keyed.join(a, "a_id").join(b, "b_id"), F.col("o_orderkey") % 6
    name = F.when(kind == 0, F.concat(F.lit("Copy "), F.lower("a"), F.lit(".pdf"))).when(kind == 1, F.concat(F.replace(F.replace("a", F.lit("/"), F.lit("_")), F.lit("#"), F.lit("")), F.lit(".pdf")))
    name = name.when(kind == 2, F.concat(F.replace("a", F.lit("-"), F.lit("")), F.lit(" "), F.replace("b", F.lit("-"), F.lit("")))).when(kind == 3, F.concat("a", "b")).otherwise("scan.pdf")
    text = F.when(kind == 4, F.concat(F.lit("on "), "a", F.lit(" only"))).when(kind != 5, F.concat(F.lit("see "), "b"))
    files = pairs.select("o_orderkey", name.alias("name"), text.alias("text"))
    out = ops.identified(files, ["o_orderkey"], "name", "text", known, "number")
    return out.select("o_orderkey", "number", F.array_join("found", "|").alias("found"), "source")
