"""Sharding by longest processing time: groups that must stay together, largest first, each to the least-loaded shard.

Groups of one size are interchangeable, so the heap runs over size classes: a class of many groups is dealt in one step,
with the outcome of dealing its groups one by one. Only (size, number of groups) is gathered, of which there are at most
sqrt(2 * total bytes). Each class then tells how many of its groups every shard takes; groups learn their rank in their
class from counts by a prefix of their key, and rows their slot from counts by a prefix of a hash of their id, so no class,
shard or group of copies is sorted as a whole.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.llm.common import materialize, table

PREFIX = 3
#: Copies of one row, equal in id and text, that one task numbers.
COPIES = 10_000


def lpt(items: list[tuple[int, object]], shards: int) -> dict:
    """item -> shard for (size, item) pairs. Larger first; equal sizes by item; equal loads to the lower shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def _dealt(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n groups of one size each shard takes when every group goes to the least-loaded shard.

    The groups meet the loads load, load + size, load + 2 * size, ... of each shard in ascending order, ties by shard.
    """

    def below(t: int) -> int:
        return sum(max(0, -(-(t - x) // size)) for x in loads)

    low, high = min(loads), max(loads) + size * (n + 1)
    while low < high:  # the largest t with at most n places below it
        mid = (low + high + 1) // 2
        low, high = (mid, high) if below(mid) <= n else (low, mid - 1)
    taken = [max(0, -(-(low - x) // size)) for x in loads]
    left = n - sum(taken)
    for s, x in enumerate(loads):
        if left and x <= low and (low - x) % size == 0:
            taken[s] += 1
            left -= 1
    return taken


def lpt_classes(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(size, shard, groups) for (size, number of groups) pairs: what lpt() gives over all groups, class by class."""
    heap, out = [(0, s) for s in range(shards)], []
    for size, n in sorted(classes, reverse=True):
        if n <= 2 * shards:
            taken = [0] * shards
            for _ in range(n):
                load, s = heapq.heappop(heap)
                taken[s] += 1
                heapq.heappush(heap, (load + size, s))
        else:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            taken = _dealt(loads, size, n)
            heap = [(x + size * k, s) for s, (x, k) in enumerate(zip(loads, taken, strict=True))]
            heapq.heapify(heap)
        out += [(size, s, k) for s, k in enumerate(taken) if k]
    return out


def _before(count: str, keys: list[str], order: str) -> Column:
    """The sum of `count` over the group's earlier rows."""
    return F.coalesce(F.sum(count).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def shard_groups(docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot. Equal texts share a shard; shard bytes are near equal.

    size is the text's UTF-8 bytes plus 1; a null text counts as empty and groups with empty texts. Of a class of equal
    sizes, the groups go to the shards in ascending order of the SHA-256 of their text. Slots run without a gap from 0 in
    each shard, by the MD5 of the id, then id and text; a null id comes first, and rows that repeat id and text have slots
    in a row. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    named = F.coalesce(F.md5(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("key"), F.substring(named, 1, PREFIX).alias("part"))
    # rows that are equal in all are one row with a count
    slim = materialize(slim.groupBy(*slim.columns).agg(F.count("*").alias("copies")), "shard-rows")

    groups = slim.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")).withColumn("stem", F.substring("key", 1, PREFIX))
    groups = materialize(groups, "shard-groups")
    stems = groups.groupBy("bytes", "stem").agg(F.count("*").alias("n"))
    classes = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()]  # at most sqrt(2 * total) rows
    dealt = spark.createDataFrame(lpt_classes(classes, shards), "bytes long, shard int, n long")
    dealt = dealt.withColumn("low", _before("n", ["bytes"], "shard")).select("bytes", "shard", "low", (F.col("low") + F.col("n")).alias("high"))

    stems = stems.select("bytes", "stem", _before("n", ["bytes"], "stem").alias("base"))
    rank = F.col("base") + F.row_number().over(W.partitionBy("bytes", "stem").orderBy("key")) - 1
    ranked = groups.join(stems, ["bytes", "stem"]).withColumn("rank", rank)
    placed = ranked.join(dealt, "bytes").filter("rank >= low and rank < high").select("key", "shard")

    rows = materialize(slim.join(placed, "key"), "shard-placed")
    parts = rows.groupBy("shard", "part").agg(F.sum("copies").alias("n"))  # at most 16 ** PREFIX + 1 rows a shard
    parts = parts.select("shard", "part", _before("n", ["shard"], "part").alias("base"))
    inside = W.partitionBy("shard", "part").orderBy(F.asc_nulls_first("doc_id"), "key").rowsBetween(W.unboundedPreceding, -1)
    first = rows.join(F.broadcast(parts), ["shard", "part"]).withColumn("first", F.col("base") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    spans = first.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    slots = spans.withColumn("k", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + COPIES, F.col("copies")) - 1)))
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("k")).alias("slot"))


def op8_shard_lpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_shard_lpt": op8_shard_lpt}
#: Plain longest processing time over all groups, one group a step. DuckDB has no CRC-32 built in: a table of the 256 bytes'
#: remainders and a fold over each text's bytes stand for it.
ORACLE = {
    "op8_shard_lpt": r"""
WITH RECURSIVE bit(b, v, k) AS (SELECT range, CAST(range AS UINTEGER), 0 FROM range(256) UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UINTEGER)) ELSE v >> 1 END, k + 1 FROM bit WHERE k < 8),
crc AS (SELECT list(CAST(v AS UBIGINT) ORDER BY b) AS t FROM bit WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, sha256(coalesce(text, '')) AS key FROM documents),
u AS (SELECT key, any_value(text) AS text FROM d GROUP BY key),
h AS (SELECT key, regexp_extract_all(hex(encode(text)), '..') AS x FROM u),
c AS (SELECT key, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(x, lambda y: CAST('0x' || y AS UBIGINT))),
  lambda a, y: xor(a >> 8, t[CAST(xor(a, y) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS crc FROM h, crc),
g AS (SELECT key, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY key),
o AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, key) AS i FROM g),
f(i, bytes, loads, shard) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), list_transform(range(16), lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) UNION ALL
  SELECT o.i, o.bytes, list_transform(f.loads, lambda x, k: CASE WHEN k = list_position(f.loads, list_min(f.loads)) THEN x + o.bytes ELSE x END), CAST(list_position(f.loads, list_min(f.loads)) - 1 AS BIGINT) FROM f JOIN o ON o.i = f.i + 1),
n AS (SELECT bytes, shard, count(*) AS n FROM f WHERE i > 0 GROUP BY bytes, shard),
r AS (SELECT bytes, shard, sum(n) OVER (PARTITION BY bytes ORDER BY shard) AS high, sum(n) OVER (PARTITION BY bytes ORDER BY shard) - n AS low FROM n),
p AS (SELECT o.key, r.shard FROM (SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY key) - 1 AS rank FROM o) o JOIN r ON r.bytes = o.bytes AND rank >= low AND rank < high)
SELECT d.doc_id, d.size, CAST(c.crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(p.shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY p.shard ORDER BY substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 3), d.doc_id, d.key) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN p USING (key) JOIN c USING (key)
"""
}
