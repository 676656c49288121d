"""Parts of an award joined to one row."""

from __future__ import annotations

from kelpie.operators.notices import combined_awards


def test_rows_are_sent_once(spark):
    rows = [(1, "A ", 1.0, "x", 5), (1, "a", 2.0, "x", 6), (2, "b", 1.0, "x", 1), (2, "c", 1.0, "y", 2), (3, None, 4.0, None, None), (4, "d", 1.0, None, 1), (4, "d", 1.0, "z", 1)]
    out = combined_awards(spark.createDataFrame(rows, "k int, s string, amount double, currency string, day int"), "k", "s", "amount", "currency", "day")
    assert sorted(map(tuple, out.collect())) == [(1, 1, 6, 3.0), (2, 2, 2, None), (3, 0, None, 4.0), (4, 1, 1, 2.0)]
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
