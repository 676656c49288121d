"""Keyed state with timers: values per key that leave the state when they no longer matter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def use_rocks(spark: SparkSession) -> None:
    """Timers and lists need this store; queries that start afterwards use it."""
    for k, v in ROCKS.items():
        spark.conf.set(k, v)


class SlidingLimit(StatefulProcessor):
    """Whether a call puts its key over `most` calls in the last `seconds` (the far end excluded); every call counts.

    Calls wait until the watermark has passed them and are then judged in order of time. A key has a timer for the slot of
    `step` milliseconds of its first waiting call; when it goes off, all calls before the watermark are judged at once. State of
    a key: the calls that wait, and at most `most` times of earlier ones, which go when the last is `seconds` old.
    """

    def __init__(self, seconds: int, most: int, step: int = 60_000):
        self.window, self.most, self.step = seconds * 1_000_000, most, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at long")
        self.waiting = handle.getListState("waiting", "at long, id long")

    def _wake(self, micros: int, gone: int = -1) -> None:
        """A timer for this slot, unless one goes off before; that of `gone` is still listed while it goes off."""
        slot = (micros // 1000 // self.step + 1) * self.step
        if min((t for t in self.handle.listTimers() if t > gone), default=slot + 1) > slot:
            self.handle.registerTimer(slot)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = [c for part in rows for c in zip(part["micros"].tolist(), part["event_id"].tolist(), strict=True)]
        self.waiting.appendList(calls)
        self._wake(min(calls)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000  # no call before the watermark can come any more
        waiting = sorted(tuple(x) for x in self.waiting.get())
        due, rest = [x for x in waiting if x[0] < now], [x for x in waiting if x[0] >= now]
        times, ids, limited = sorted(x[0] for x in self.times.get()), [], []
        for at, id_ in due:
            ids.append(id_)
            limited.append(len(times) >= self.most and at - times[-self.most] < self.window)
            times = [*times, at][-self.most :]
        times = [x for x in times if now - x < self.window]
        for state, values in ((self.waiting, rest), (self.times, [(x,) for x in times])):
            if values:
                state.put(values)
            else:
                state.clear()
        if rest or times:
            self._wake(rest[0][0] if rest else times[-1] + self.window, expiredTimerInfo.getExpiryTimeInMs())
        if ids:
            yield pd.DataFrame({"user_id": pd.Series([key[0]] * len(ids), dtype="int64"), "event_id": pd.Series(ids, dtype="int64"), "limited": pd.Series(limited, dtype="bool")})


def over_limit(events: DataFrame, seconds: int, most: int, late: str) -> DataFrame:
    """(user_id, event_id, limited) of a stream with ts, user_id, event_id: see SlidingLimit. Rows later than `late` are
    dropped by the watermark; rows without user or time are left out. Needs use_rocks()."""
    # one condition that names ts stays above the watermark, so that rows without a user move it too
    some = events.withWatermark("ts", late).filter(F.when(F.col("ts").isNull(), False).otherwise(F.col("user_id").isNotNull())).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("micros"))
    return some.groupBy("user_id").transformWithStateInPandas(SlidingLimit(seconds, most), "user_id long, event_id long, limited boolean", "Append", "EventTime")


def disorder(log: DataFrame, time: str) -> int:
    """Seconds by which a row of a file lies behind the latest row of the files before it, at most; files in the order in
    which a stream takes them. As a watermark's delay it loses no row. Reads one column; one row a file is compared."""
    meta = F.col("_metadata")
    files = log.select(meta["file_modification_time"].alias("at"), meta["file_path"].alias("path"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"))
    files = files.groupBy("at", "path").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    before = F.max("high").over(W.orderBy("at", "path").rowsBetween(W.unboundedPreceding, -1))
    behind = files.select((before - F.col("low")).alias("b")).agg(F.max("b")).first()[0]
    return max(0, -(-(behind or 0) // 1_000_000)) + 1
