"""Groups of rows that links join, however long the chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.session import discard, stored


def _nearer(links: DataFrame) -> DataFrame:
    """One step: every end of a link, and its other ends, move to the least of them all."""
    ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to"))
    moved = ends.join(least, "a").select(F.col("b").alias("a"), F.col("to").alias("b"))
    return moved.union(least.select("a", F.col("to").alias("b"))).filter("a > b").distinct()


def _hung(links: DataFrame) -> DataFrame:
    """Ends whose one link is to a lesser end. Nothing else hangs on them, and none is the least of its group."""
    ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return ends.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("links")).filter("links = 1 and b < a").select("a", "b")


def groups(links: DataFrame, a: str = "a", b: str = "b", most_steps: int = 60) -> DataFrame:
    """(member, first) for all ends of links (a, b): first is the least member that links reach.

    Links of null ends, and of an end with itself, say nothing. In each step the ends of one link to a lesser end are laid
    aside, and the others move nearer to their least; a chain takes about the logarithm of its length. What was laid aside
    then takes the first of the end it hangs on, last step first. Every step is written down, so that it is not computed
    again; a member of many links is one key of a join, which adaptive execution splits.
    """
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now, aside = stored(now, "links"), []
    for _ in range(most_steps):
        aside.append(stored(_hung(now), "aside"))
        rest = stored(now.join(aside[-1].select("a"), "a", "left_anti"), "links")
        discard(now)
        if rest.isEmpty():
            break
        now = stored(_nearer(rest), "links")
        discard(rest)
    else:
        raise RuntimeError("groups did not settle")
    found = aside.pop().select(F.col("a").alias("member"), F.col("b").alias("first"))
    for hung in reversed(aside):
        more = hung.join(found.withColumnRenamed("member", "b"), "b", "left").select(F.col("a").alias("member"), F.coalesce("first", "b").alias("first"))
        found = found.union(stored(more, "groups"))
    return found.union(found.select(F.col("first").alias("member"), "first").distinct())
