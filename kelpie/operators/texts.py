"""Operators over texts and ordered text parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.functions.text import overlap, spaced, token_set
from kelpie.operators.containment import contained

def contained_phrases(docs: DataFrame, doc_id: str, text: str, phrases: DataFrame, phrase_id: str, phrase: str) -> DataFrame:
    """(doc_id, phrase_id) where all words of a phrase stand in a row in a text; one row each. A phrase without words is in no
    text."""
    def framed(words: Column) -> Column:
        return F.concat(F.lit(" "), words, F.lit(" "))

    known = phrases.select(F.col(phrase_id).alias("p_"), spaced(F.col(phrase)).alias("w_")).filter("w_ <> ''")
    found = contained(docs.select(F.col(doc_id).alias("d_"), text), ["d_"], framed(spaced(F.col(text))), known, framed(F.col("w_")), [F.col("p_")])
    return found.select(F.col("d_").alias(doc_id), F.col("p_").alias(phrase_id)).distinct()


def similar_names(left: DataFrame, right: DataFrame, block: list[str], a_id: str, b_id: str, a: str, b: str, least: float) -> DataFrame:
    """Pairs of one block whose token sets share at least `least` of the smaller set.

    Tokens are put in order, rare ones first by their count in the block. Two sets that share that much of the smaller one
    share a token among the first size - ceil(least * size) + 1 of it, so the smaller set's prefix meets all tokens of the
    other: common tokens, which stand last, bring hardly any pairs together.
    """
    x = left.select(*block, F.col(a_id), token_set(F.col(a)).alias("x_"))
    y = right.select(*block, F.col(b_id), token_set(F.col(b)).alias("y_"))
    each = x.select(*block, F.explode("x_").alias("t_")).union(y.select(*block, F.explode("y_").alias("t_")))
    counts = each.groupBy(*block, "t_").agg(F.count("*").alias("c_"))

    def prefixed(df: DataFrame, id_: str, tokens: str) -> DataFrame:
        rows = df.select(*block, id_, tokens, F.explode(tokens).alias("t_")).join(counts, [*block, "t_"])
        ranked = rows.withColumn("r_", F.row_number().over(W.partitionBy(*block, id_).orderBy("c_", "t_")))
        return ranked.withColumn("in_", F.col("r_") <= F.size(tokens) - F.ceil(least * F.size(tokens)) + 1)

    p, q = prefixed(x, a_id, "x_"), prefixed(y, b_id, "y_")
    n, m = F.size("x_"), F.size("y_")
    met = p.alias("p").join(q.alias("q"), [*block, "t_"]).filter(F.when(n <= m, F.col("p.in_")).otherwise(F.col("q.in_")))
    met = met.select(a_id, b_id, "x_", "y_").dropDuplicates([a_id, b_id])
    return met.withColumn("overlap", overlap(F.col("x_"), F.col("y_"))).filter(F.col("overlap") >= least).select(a_id, b_id, "overlap")


def smoothed(df: DataFrame, keys: list[str], order: str, score: str, weight: float = 0.3) -> Column:
    """A score with a share of both neighbours'."""
    w = W.partitionBy(*keys).orderBy(order)
    return F.col(score) + weight * (F.coalesce(F.lag(score).over(w), F.lit(0)) + F.coalesce(F.lead(score).over(w), F.lit(0)))


def within_budget(df: DataFrame, keys: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """The strongest rows of each group whose sizes together stay in the budget."""
    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(upto)).filter(F.col("used") <= budget)


def ranges(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers as (first, last)."""
    run = F.col(number) - F.row_number().over(W.partitionBy(*keys).orderBy(number))
    return df.withColumn("run_", run).groupBy(*keys, "run_").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("run_")
