"""Keyed state over many files out of order: the same as judging all calls in order, and nothing left in the end."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from kelpie.streaming import events as ops
from kelpie.streaming import keyed


def plain(rows, seconds, most):
    out, seen = {}, defaultdict(list)
    for at, id_, user in sorted((t, i, u) for i, u, t in rows if u is not None and t is not None):
        before = seen[user]
        out[id_] = len(before) >= most and at - before[-most] < timedelta(seconds=seconds)
        before.append(at)
    return out


def test_limits_over_files_out_of_order(spark, tmp_path):
    r = random.Random(2)
    start = datetime(2026, 1, 1)
    rows = [(k, r.choice([1, 1, 1, 2, 3, None]), start + timedelta(seconds=r.choice([10 * k, 10 * k, 10 * k - 300 * (k > 60)]))) for k in range(600)]
    rows += [(600, 4, None), (601, 1, rows[300][2]), (602, 1, rows[300][2])]
    log = f"file://{tmp_path}/log"
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k : k + 40], "event_id long, user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(log)
    late = keyed.disorder(spark.read.parquet(log), "ts")
    assert 300 <= late < 4000
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed.use_rocks(spark)
    try:
        end = datetime(2027, 1, 1)
        judged = lambda: keyed.over_limit(ops.event_stream(spark, log, files_per_batch=2), 60, 3, f"{late} seconds")
        ops.run_once(judged(), f"file://{tmp_path}/run", "append")
        spark.createDataFrame([(None, None, end)], "event_id long, user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(log)
        job = judged().writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"file://{tmp_path}/run/out/batch={n}")).option("checkpointLocation", f"file://{tmp_path}/run/state").trigger(availableNow=True).start()
        job.awaitTermination()
        left = [p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(f"file://{tmp_path}/run/out")
    assert got.count() == got.select("event_id").distinct().count()
    assert {x.event_id: x.limited for x in got.collect()} == plain(rows, 60, 3)
    assert got.filter(F.col("limited")).count() > 20
    assert left[-1] == 0


class _Handle:
    """State of one key; a timer that goes off is listed until its handler has ended."""

    def __init__(self):
        self.timers, self.registered, self.lists = set(), 0, {}

    def getListState(self, name, schema):
        held = self.lists.setdefault(name, [])
        return type("L", (), {"appendList": lambda _, v: held.extend(v), "get": lambda _: iter(list(held)), "clear": lambda _: held.clear(), "put": lambda _, v: held.__setitem__(slice(None), v)})()

    def listTimers(self):
        return iter(list(self.timers))

    def registerTimer(self, at):
        self.registered += 1
        self.timers.add(at)


def test_one_timer_for_many_calls():
    handle, seen = _Handle(), []
    state = keyed.SlidingLimit(3600, 3)
    state.init(handle)
    calls = pd.DataFrame({"micros": [k * 90_000_000 for k in range(200)], "event_id": range(200)})

    def go_off(mark):
        values = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
        while due := [t for t in handle.timers if t <= mark]:
            for out in state.handleExpiredTimer((1,), values, SimpleNamespace(getExpiryTimeInMs=lambda: min(due))):  # noqa: B023
                seen.extend(out["event_id"].tolist())
            handle.timers.remove(min(due))

    list(state.handleInputRows((1,), iter([calls]), None))
    assert handle.registered == 1  # not one for each call
    go_off(100 * 90_000)
    assert seen == list(range(100)) and len(handle.timers) == 1
    go_off(1000 * 90_000)
    assert seen == list(range(200)) and not handle.timers and not any(handle.lists.values())
