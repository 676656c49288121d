"""Every query of the library against its SQL on the same tables, and the driver contract."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from kelpie.plans import registry

DATA = "/root/testdata/sf0.001"


def compared(frame, columns):
    return sorted(map(tuple, frame[columns].astype(str).replace({"None": "null", "nan": "null", "<NA>": "null", "NaT": "null"}).to_numpy().tolist()))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    left = registry.queries()[name](spark, DATA).toPandas()
    right = tables.sql(registry.oracle_sql()[name]).df()
    assert sorted(left.columns) == sorted(right.columns)
    assert len(left) == len(right)
    a, b = (f[sorted(f.columns)] for f in (left, right))
    for c in a.columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            a[c], b[c] = a[c].astype(float).round(6), b[c].astype(float).round(6)
    assert compared(a, list(a.columns)) == compared(b, list(a.columns))


def test_entry_point():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
