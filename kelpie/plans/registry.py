"""All registered queries of the library and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kelpie.plans import board, containment, distinct, events, listing, markup, merges, near, notices, numerals, reports, snapshots, streams, texts, wording

Query = Callable[[SparkSession, str], DataFrame]
_FAMILIES = [board, containment, distinct, events, listing, markup, merges, near, notices, numerals, reports, snapshots, streams, texts, wording]


def queries() -> dict[str, Query]:
    return {name: f for m in _FAMILIES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _FAMILIES for name, sql in m.ORACLE.items()}
