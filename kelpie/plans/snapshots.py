"""Changes between two stored snapshots of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.operators import snapshots as ops
from kelpie.session import shared_folder, table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


@query("""SELECT o_orderkey, 'changed' AS kind, o_orderstatus AS old, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'X' END AS new FROM orders WHERE o_orderkey % 997 = 5 UNION ALL
SELECT o_orderkey, 'removed', o_orderstatus, NULL FROM orders WHERE o_orderkey % 997 = 6 UNION ALL SELECT -o_orderkey, 'added', NULL, o_orderstatus FROM orders WHERE o_orderkey % 1999 = 7""")
def pruned_history(spark, d):
    """Orders that changed, went or came between two snapshots; buckets without any are not read."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    k, state = F.col("o_orderkey"), F.col("o_orderstatus")
    later = o.filter(k % 997 != 6).withColumn("o_orderstatus", F.when(k % 997 != 5, state).when(state != "F", "X"))
    later = later.unionByName(o.filter(k % 1999 == 7).withColumn("o_orderkey", -k))
    before, after = (shared_folder(spark, "snapshots") for _ in range(2))
    ops.take(o, ["o_orderkey"], before)
    ops.take(later, ["o_orderkey"], after)
    return ops.changes(spark, before, after, "o_orderkey long, o_orderstatus string", ["o_orderkey"], "o_orderstatus")
