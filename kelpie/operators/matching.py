"""Matching rows by numbers and words inside texts. Both sides meet on equal keys; nothing is crossed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.functions.text import key_fold, overlap, spaced, token_set
from kelpie.operators.containment import contained, outermost


def numbers_inside(files: DataFrame, keys: list[str], name: str, known: DataFrame, number: str, least: int) -> DataFrame:
    """(keys, number, found): the known number inside a name, separators apart. A number inside a longer one that is found
    too does not count; with several left, number is null and found tells how many. Files whose names are equal without
    separators are read once; keys are unique in files."""
    numbers = known.select(key_fold(F.col(number)).alias("n_")).filter(F.length("n_") >= least).distinct()
    named = files.select(*keys, key_fold(F.col(name)).alias("name_"))
    hits = contained(named.select("name_").distinct(), ["name_"], F.col("name_"), numbers, F.col("n_"), [F.col("n_")])
    group = hits.groupBy("name_").agg(F.collect_set("n_").alias("all_")).select("name_", outermost(F.col("all_")).alias("b_"))
    each = group.select("name_", F.when(F.size("b_") == 1, F.element_at("b_", 1)).alias("number"), F.size("b_").cast("long").alias("found"))
    return named.join(each, "name_").select(*keys, "number", "found")


def chosen_by_tokens(candidates: DataFrame, group: str, id_: str, name: str, texts: DataFrame, text: str, least: int) -> DataFrame:
    """(group, chosen): of the candidates of a group the one alone whose own words its text holds. Words that two candidates
    share say nothing; without rivals no word is needed; else chosen is null."""
    words = candidates.select(group, id_, F.explode(token_set(F.col(name), least=least)).alias("t_"))
    own = words.groupBy(group, "t_").agg(F.count("*").alias("n_"), F.min(id_).alias(id_)).filter("n_ = 1")
    said = texts.select(group, F.explode(F.array_distinct(F.split(spaced(F.col(text)), " "))).alias("t_"))
    found = own.join(said, [group, "t_"]).groupBy(group).agg(F.countDistinct(id_).alias("s_"), F.min(id_).alias("one_"))
    all_ = candidates.groupBy(group).agg(F.count("*").alias("c_"), F.min(id_).alias("first_"))
    return all_.join(found, group, "left").select(group, F.when(F.col("c_") == 1, F.col("first_")).when(F.col("s_") == 1, F.col("one_")).alias("chosen"))


def best_match(left: DataFrame, right: DataFrame, block: list[str], id_: str, name: str, day: str, strong: float = 0.5, weak: float = 0.6, days: int = 7) -> DataFrame:
    """(id, other, kind, overlap): the best partner of each row in its block whose day is at most `days` away.

    strong: a day apart at most and an overlap of `strong`; weak: an overlap of `weak`. Rows meet on the block and the week
    of the day and its neighbours, so a large block is not crossed.
    """
    week = F.floor(F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) / days)
    a = left.select(*block, F.col(id_).alias("a_"), token_set(F.col(name)).alias("x_"), F.col(day).alias("d_"), F.explode(F.array(week - 1, week, week + 1)).alias("w_"))
    b = right.select(*block, F.col(id_).alias("b_"), token_set(F.col(name)).alias("y_"), F.col(day).alias("e_"), week.alias("w_"))
    gap, share = F.abs(F.datediff("d_", "e_")), overlap(F.col("x_"), F.col("y_"))
    met = a.join(b, [*block, "w_"]).select("a_", "b_", gap.alias("gap_"), share.alias("overlap"))
    rank = F.when((F.col("gap_") <= 1) & (F.col("overlap") >= strong), 2).when((F.col("overlap") >= weak) & (F.col("gap_") <= days), 1)
    ranked = met.withColumn("k_", rank).filter("k_ is not null")
    first = ranked.withColumn("r_", F.row_number().over(W.partitionBy("a_").orderBy(F.desc("k_"), F.desc("overlap"), F.asc("b_")))).filter("r_ = 1")
    return first.select(F.col("a_").alias(id_), F.col("b_").alias("other"), F.when(F.col("k_") == 2, "strong").otherwise("weak").alias("kind"), "overlap")
