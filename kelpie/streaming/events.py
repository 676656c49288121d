"""Streaming forms of the event operators. Every job survives a restart: offsets and state lie in its checkpoint folder,
and each batch overwrites its own folder, so a batch that runs twice counts once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE_FIELDS = "user_id long, event_id long, old string, new string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The log as a stream of files, its times as instants in UTC."""
    raw = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def accepted(events: DataFrame, types: list[str], most_bytes: int = 8192) -> DataFrame:
    """Events of known types with a user and small properties."""
    return events.filter(F.col("event_type").isin(types) & F.col("user_id").isNotNull() & (F.coalesce(F.octet_length("props"), F.lit(0)) <= most_bytes))


def daily_totals(events: DataFrame, late: str | None = "2 days") -> DataFrame:
    """Counts by UTC day and type; a day stays open for `late`, later rows are dropped by the watermark.

    Where late is None, days never close and every row counts, in whatever order it arrives."""
    by_day = (events if late is None else events.withWatermark("ts", late)).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return by_day.select(F.col("window.start").alias("day"), "event_type", "n")


def once_per_id(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once; ids are remembered for `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, parted by silent gaps."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def _changes(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    for rows in parts:  # one Arrow batch at a time
        rows = rows.sort_values(["ts", "event_id"])
        known = rows["event_type"].tolist()
        out = pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "old": [last, *known[:-1]], "new": known})
        last = known[-1] if known else last
        yield out[out["old"].notna() & (out["old"] != out["new"])]
    state.update((last,))


def state_changes(events: DataFrame) -> DataFrame:
    """A row whenever a user's event differs in type from the one before. State: one word per user. Rows of an
    Arrow batch are put in order of time; across batches, arrival decides, as memory is not to grow with a user's rows. Events without user or type are left out."""
    some = events.filter("user_id is not null and event_type is not null").select("user_id", "event_id", "ts", "event_type")
    return some.groupBy("user_id").applyInPandasWithState(_changes, CHANGE_FIELDS, "last string", "append", GroupStateTimeout.NoTimeout)


def ordered_state_changes(events: DataFrame) -> DataFrame:
    """The same over a whole table, which is put in order of time before rows are compared. All rows take part."""
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id")))
    return events.select("user_id", "event_id", before.alias("old"), F.col("event_type").alias("new")).filter("old <> new")


def _hits(seconds: int, most: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for rows in parts:
            rows = rows.sort_values(["micros", "event_id"])
            ids, allowed = rows["event_id"].tolist(), []
            for at in rows["micros"].tolist():
                held = [x for x in held if x > at - seconds * 1_000_000][-most:]
                allowed.append(len(held) < most)
                if allowed[-1]:
                    held.append(at)
            yield pd.DataFrame({"user_id": key[0], "event_id": ids, "allowed": allowed})
        state.update((held,))

    return run


def rate_limited(events: DataFrame, seconds: int = 60, most: int = 60) -> DataFrame:
    """(user_id, event_id, allowed): an event is allowed while fewer than `most` allowed ones of its user lie in the last
    `seconds`, the far end excluded. State: at most `most` times a user. Rows of a
    user in one Arrow batch are put in order of time; events without a user are left out."""
    some = events.filter("user_id is not null").select("user_id", "event_id", F.unix_micros(F.col("ts")).alias("micros"))
    return some.groupBy("user_id").applyInPandasWithState(_hits(seconds, most), "user_id long, event_id long, allowed boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Process all that has arrived and return the rows of every batch with their batch number.

    In update mode a key's last batch holds its current value.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    # every part of the state costs a task and its stores in each batch, however little it holds
    conf, parts = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(parts)
    conf.set(parts, min(int(before), 2 * stream.sparkSession.sparkContext.defaultParallelism))
    try:
        job = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        conf.set(parts, before)
    try:
        job.awaitTermination()
    finally:
        job.stop()
    return stream.sparkSession.read.parquet(f"{folder}/out")
