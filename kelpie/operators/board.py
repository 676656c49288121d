"""Operators of a notice board: facets, gates, orders with turns, links, searches. Only heads of groups ever meet each other."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.functions.arrays import has_all, has_any
from kelpie.functions.rules import deadline_class
from kelpie.functions.text import search_match
from kelpie.operators.listing import facets


def faceted(df: DataFrame, chosen: dict[str, list], *, any_of: dict[str, list] | None = None, all_of: dict[str, list] | None = None, hide: dict[str, str] | None = None, text: Column | None = None, words: str = "") -> DataFrame:
    """Rows that meet every facet; an empty list restricts nothing. any_of and all_of are over array columns; hide names a
    value that is left out unless its facet asks for it; all words of a query must occur in the text."""
    keep = facets(chosen)
    for column, values in (any_of or {}).items():
        keep = keep & has_any(F.col(column), values)
    for column, values in (all_of or {}).items():
        keep = keep & has_all(F.col(column), values)
    for column, value in (hide or {}).items():
        if value not in chosen.get(column, []):
            keep = keep & (F.col(column) != value)
    if text is not None:
        keep = keep & search_match(text, words)
    return df.filter(keep)


def in_range(df: DataFrame, day: str, first: str | None, last: str | None) -> DataFrame:
    """Rows of a span of days, both ends included; either end may be open."""
    if first:
        df = df.filter(F.col(day) >= F.lit(first).cast("date"))
    return df.filter(F.col(day) <= F.lit(last).cast("date")) if last else df


def admitted(df: DataFrame, source: str, gates: dict[str, Column]) -> DataFrame:
    """Rows that their own source's gate lets in; a source without a gate lets nothing in."""
    out = F.lit(False)
    for name, rule in gates.items():
        out = F.when(F.col(source) == name, rule).otherwise(out)
    return df.filter(out)


def interleaved_runs(df: DataFrame, run: list[str], key: str, order: list[Column]) -> DataFrame:
    """Append place: inside a run, keys take turns, in the order in which they first appear. order is total in a run."""
    w = W.partitionBy(*run).orderBy(*order)
    rows = df.withColumns({"p_": F.row_number().over(w), "turn_": F.row_number().over(W.partitionBy(*run, key).orderBy(*order))})
    rows = rows.withColumn("lead_", F.min("p_").over(W.partitionBy(*run, key)))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*run).orderBy("turn_", "lead_"))).drop("p_", "turn_", "lead_")


def consecutive_runs(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Append run: the number of the stretch of equal, consecutive values that a row lies in."""
    w = W.partitionBy(*keys).orderBy(*order)
    fresh = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    return df.withColumn("fresh_", fresh).withColumn("run", F.sum("fresh_").over(w)).drop("fresh_")


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in a total order, numbered by place; each task keeps n rows at most."""
    return df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(W.orderBy(*order)))


def deadline_runs(df: DataFrame, status: str, deadline: str, published: str, today: Column, *, descending: bool = False) -> tuple[DataFrame, list[Column], list[str]]:
    """df with class and the columns of its run, the order of runs, and their names.

    Classes stand as deadline_class has them. In a class, coming deadlines stand first, by day (the far ones first where
    descending); then the others, newest publication first. The classes keep their order in both directions.
    """
    coming = F.coalesce(F.col(deadline) >= today, F.lit(False))
    marked = df.withColumns({"class": deadline_class(F.col(status), F.col(deadline), today), "coming_": coming, "run_": F.when(coming, F.col(deadline)).otherwise(F.col(published)).cast("date")})
    days = F.datediff("run_", F.lit("1970-01-01").cast("date"))
    marked = marked.withColumn("day_", F.when(F.col("coming_") & F.lit(not descending), days).otherwise(-days))
    runs = ["class", "coming_", "run_"]
    return marked, [F.asc("class"), F.desc("coming_"), F.asc_nulls_last("day_")], runs


def deadline_page(df: DataFrame, id_: str, status: str, deadline: str, published: str, country: str, today: Column, rows: int, *, descending: bool = False) -> DataFrame:
    """The first `rows` rows by deadline, with class and place; countries take turns inside a day. A page is the feature.

    Every day has a row, so the first `rows` days fill the page, and only their rows are put in turns.
    """
    marked, order, runs = deadline_runs(df, status, deadline, published, today, descending=descending)
    first = marked.groupBy(*runs, "day_").agg(F.count("*").alias("n_")).orderBy(*order).limit(rows).withColumn("seen_", F.sum("n_").over(W.orderBy(*order)) - F.col("n_"))
    needed = first.filter(F.col("seen_") < rows).select("class", "coming_", F.coalesce("run_", F.lit("0001-01-01").cast("date")).alias("key_"))  # at most `rows` of them
    near = marked.withColumn("key_", F.coalesce("run_", F.lit("0001-01-01").cast("date"))).join(F.broadcast(needed), ["class", "coming_", "key_"], "left_semi")
    turns = interleaved_runs(near, runs, country, [F.asc(id_)]).withColumnRenamed("place", "turn_")
    return first_rows(turns, [*order, F.asc("turn_")], rows).drop("coming_", "run_", "day_", "key_", "turn_")


def related(df: DataFrame, id_: str, block: str, tags: str, order: list[Column], k: int, ignore: str) -> DataFrame:
    """(id, other, place): for each row the k rows of its block that share most tags, then by order.

    Rows of one block and one set of tags rank alike for everyone, so only the first k + 1 of each such set can be chosen:
    the rows meet these heads, not each other.
    """
    real = F.array_remove(tags, ignore)
    heads = df.withColumn("r_", F.row_number().over(W.partitionBy(block, F.array_sort(tags)).orderBy(*order))).filter(F.col("r_") <= k + 1)
    met = df.select(block, F.col(id_).alias("mine_"), real.alias("tags_")).join(heads, block).filter(F.col("mine_") != F.col(id_))
    met = met.withColumn("shared_", F.size(F.array_intersect("tags_", F.col(tags))))
    place = F.row_number().over(W.partitionBy("mine_").orderBy(F.desc("shared_"), *order))
    return met.withColumn("place", place).filter(F.col("place") <= k).select(F.col("mine_").alias(id_), F.col(id_).alias("other"), "place")


def _chosen(rows: pd.DataFrame, tags: list[str], quota: int) -> Iterator[tuple]:
    """The greedy choice over candidates in their order: (id, tag, place)."""
    taken: set = set()
    for tag in tags:
        pool = rows[(rows["tag"] == tag) & ~rows["id"].isin(taken)]
        pool = list(pool[["id", "country", "size"]].itertuples(index=False))
        picks: list = []
        for row in pool:
            if len(picks) >= quota:
                break
            known = {p.country for p in picks}
            if row.country in known and any(o.country not in known and o.size == row.size for o in pool if o not in picks):
                continue
            picks.append(row)
        for row in pool:
            if len(picks) >= quota:
                break
            if row not in picks:
                picks.append(row)
        for place, row in enumerate(picks, 1):
            taken.add(row.id)
            yield row.id, tag, place


def showcase(df: DataFrame, id_: str, tags: str, country: str, size: str, order: list[str], wanted: list[str], quota: int) -> DataFrame:
    """(id, tag, place): tag by tag in the order of `wanted`, `quota` rows by size, order and id that no earlier tag took; a
    second row comes from another country where one of its size has one.

    At most quota * len(wanted) rows are ever taken, so of each tag, size and country only so many and one quota more can
    matter. These heads, whose number does not grow with the table, are gone through in one task.
    """
    most = quota * (len(wanted) + 1)
    rows = df.select(F.col(id_).alias("id"), F.explode(F.array_distinct(tags)).alias("tag"), F.col(country).alias("country"), F.col(size).cast("int").alias("size"), *[F.col(o).alias(f"order_{k}") for k, o in enumerate(order)]).filter(F.col("tag").isin(*wanted))
    ranked = [F.asc_nulls_last(f"order_{k}") for k in range(len(order))] + [F.asc("id")]
    heads = rows.withColumn("r_", F.row_number().over(W.partitionBy("tag", "size", "country").orderBy(*ranked))).filter(F.col("r_") <= most)
    heads = heads.withColumn("p_", F.row_number().over(W.orderBy("size", *ranked))).select("id", "tag", "country", "size", "p_")

    def choose(some: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_chosen(some.sort_values("p_"), wanted, quota)), columns=["id", "tag", "place"])

    kind = df.schema[id_].dataType.simpleString()
    return heads.groupBy().applyInPandas(choose, f"id {kind}, tag string, place int")


def links_with_fallback(asked: DataFrame, rows: DataFrame, narrow: list[str], wide: list[str], order: list[Column], id_: str, k: int) -> DataFrame:
    """For each asked row the first k rows that agree in the narrow and wide keys; where there are none, in the wide alone."""
    keys = narrow + wide
    near = rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= k).select(*keys, id_, "place")
    far = rows.withColumn("place", F.row_number().over(W.partitionBy(*wide).orderBy(*order))).filter(F.col("place") <= k).select(*wide, id_, "place")
    own = asked.join(near, keys).withColumn("scope", F.lit("platform"))
    rest = asked.join(near.select(*keys).distinct(), keys, "left_anti").join(far, wide).withColumn("scope", F.lit("country"))
    return own.unionByName(rest).select(*keys, id_, "scope", "place")


def by_ids(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of some ids with their position in the list."""
    wanted = df.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{key} {df.schema[key].dataType.simpleString()}, pos int")
    return df.join(F.broadcast(wanted), key)


def matched_searches(df: DataFrame, searches: dict[str, Column], name: str) -> DataFrame:
    """A row for each search that a row meets; all searches are tried in one pass."""
    hits = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in searches.items()]), lambda x: x.isNotNull())
    return df.withColumn(name, F.explode(hits))
