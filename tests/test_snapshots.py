"""Changes between bucketed snapshots, and which buckets they read."""

from __future__ import annotations

from kelpie.operators import snapshots


def test_changes_read_unequal_buckets_only(spark, tmp_path):
    def frame(rows):
        return spark.createDataFrame(rows, "id long, state string")

    first = [(k, None if k % 5 == 0 else f"s{k % 3}") for k in range(500)] + [(None, "x")]
    second = dict(first)
    second[3], second[10], second[None] = None, "set", "y"
    del second[7]
    second[9000] = None
    a, b = (f"file://{tmp_path}/{n}" for n in "ab")
    snapshots.take(frame(first), ["id"], a, 64)
    snapshots.take(frame(list(second.items())).repartition(7), ["id"], b, 64)
    out = snapshots.changes(spark, a, b, "id long, state string", ["id"], "state")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(3, "changed", "s0", None), (10, "changed", None, "set"), (None, "changed", "x", "y"), (7, "removed", "s1", None), (9000, "added", None, None)], key=str)
    assert 1 <= len(snapshots.unequal(spark, a, b)) <= 5
    plan = out._jdf.queryExecution().toString()
    assert plan.count("PartitionFilters: [bucket_#") + plan.count("PartitionFilters: [isnotnull(bucket_#") >= 2
    assert snapshots.unequal(spark, a, a) == [] and snapshots.changes(spark, a, a, "id long, state string", ["id"], "state").count() == 0
