"""Streaming queries over a log of several batches whose files are not in order of time."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

from kelpie.plans import streams

START = dt.datetime(2024, 3, 1, 12)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("log"))
    types = [*streams.TYPES, "error"]
    # file k holds days that lie far from those of its neighbours; 70 files are two batches
    rows = [(k, START + dt.timedelta(days=(k // 4 * 37) % 70, minutes=k % 4 * 7), k % 3, types[k * k % 5], float(k), "{}") for k in range(280)]
    rows += [(1001, START + dt.timedelta(minutes=1), 1, None, 0.0, None)]  # no type
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for k in range(71):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], schema).coalesce(1).write.mode("append").parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", sorted(streams.QUERIES))
def test_whole_table(spark, log, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{log}/events.parquet/*.parquet'")
    got = streams.QUERIES[name](spark, log)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({streams.ORACLE[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
