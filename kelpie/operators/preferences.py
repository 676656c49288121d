"""Which notices belong in whose mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.session import stored

#: The five lists of a preference; an empty or null list asks for nothing.
LISTS = ("countries", "industries", "statuses", "tiers", "keywords")


def _list(name: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(name, F.array().cast("array<string>")))))


def with_profile(preferences: DataFrame) -> DataFrame:
    """Append profile: equal for those who ask for the same, in whatever order and case of the keywords."""
    lists = [_list(c) for c in LISTS[:-1]] + [_list(F.transform("keywords", F.lower))]
    return preferences.withColumn("profile", F.md5(F.to_json(F.struct(*[v.alias(c) for c, v in zip(LISTS, lists, strict=True)]))))


#: What a notice is met by, beside its text.
CLASS = ["n_countries", "n_industries", "n_statuses", "n_tier"]


def _met(notices: DataFrame, preferences: DataFrame, id_: str, country: str, industries: str, statuses: str, tier: str, text: Column, staged: list[str] | None) -> tuple[DataFrame, DataFrame, Column]:
    """(notices with their class and the asked keywords they hold, classes with the profiles that ask for them, whether a row of
    their join holds one of the profile's keywords). Only the distinct classes meet the profiles."""
    lower = [_list(F.transform("keywords", F.lower)) if c == "keywords" else _list(c) for c in LISTS]
    asked = preferences.dropDuplicates(["profile"]).select("profile", *[v.alias(f"{c}_") for c, v in zip(LISTS, lower, strict=True)])
    keys = lambda c: F.when(F.size(c) == 0, F.array(F.lit("any"))).otherwise(F.transform(c, lambda v: F.concat(F.lit("="), v)))
    asked = asked.withColumn("at_", F.explode(keys(F.col("countries_")))).withColumn("state_", F.explode(keys(F.col("statuses_"))))

    shown = notices.filter(F.col(country).isNull() | ~F.col(country).isin(staged or []))
    own = [F.array_compact(F.array(country)), _list(industries), _list(statuses), F.coalesce(tier, F.lit(""))]
    shown = shown.select(F.col(id_), *[v.alias(c) for c, v in zip(CLASS, own, strict=True)], F.lower(F.coalesce(text, F.lit(""))).alias("said_"))
    either = lambda values: F.concat(F.array(F.lit("any")), F.transform(values, lambda v: F.concat(F.lit("="), v)))
    classes = shown.select(CLASS).distinct()
    classes = classes.withColumn("at_", F.explode(either(F.col("n_countries")))).withColumn("state_", F.explode(either(F.col("n_statuses"))))

    met = classes.join(asked, ["at_", "state_"])
    # of several statuses in common the first one counts, so that no pair is met twice
    met = met.filter((F.col("state_") == "any") | (F.col("state_") == F.concat(F.lit("="), F.get(F.array_intersect("n_statuses", "statuses_"), F.lit(0)))))
    met = met.filter((F.size("industries_") == 0) | F.arrays_overlap("n_industries", "industries_"))
    met = stored(met.filter((F.size("tiers_") == 0) | F.array_contains("tiers_", F.col("n_tier"))).select(*CLASS, "profile", "keywords_"), "met-classes")

    sought = met.groupBy(CLASS).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("keywords_")))).alias("words_"))
    holds = F.filter("words_", lambda w: F.contains(F.col("said_"), w))
    return shown.join(sought, CLASS).select(id_, *CLASS, holds.alias("held_")), met, (F.size("keywords_") == 0) | F.arrays_overlap("keywords_", "held_")


def matching_notices(notices: DataFrame, preferences: DataFrame, id_: str, country: str, industries: str, statuses: str, tier: str, text: Column, staged: list[str] | None = None) -> DataFrame:
    """(profile, id): the notices that each profile of with_profile() asks for, once each.

    A notice must lie in no staged country and meet every list that is not empty: its country, one of its industries, one
    of its statuses, its tier (a null one is ''), and one keyword as a part of its text, whatever the case. A null country
    meets an empty list of countries only, a null text holds nothing but ''. Subscribers who ask for the same are one
    profile, and notices that differ in id and text are one class; profiles and classes meet on country and status, where
    'any' is a value of its own. Each text is read once for the keywords asked of its class.
    """
    grouped, met, worded = _met(notices, preferences, id_, country, industries, statuses, tier, text, staged)
    return grouped.join(met, CLASS).filter(worded).select("profile", id_)


def matching_sums(notices: DataFrame, preferences: DataFrame, id_: str, country: str, industries: str, statuses: str, tier: str, text: Column, staged: list[str] | None = None) -> DataFrame:
    """(profile, notices, first_id, last_id): how many notices of matching_notices() each profile asks for, the least id and the
    largest. Notices of one class that hold the same keywords are summed first, so no pair of a notice and a profile is made."""
    grouped, met, worded = _met(notices, preferences, id_, country, industries, statuses, tier, text, staged)
    sums = grouped.groupBy(*CLASS, "held_").agg(F.count("*").alias("n_"), F.min(id_).alias("first_"), F.max(id_).alias("last_"))
    return sums.join(met, CLASS).filter(worded).groupBy("profile").agg(F.sum("n_").alias("notices"), F.min("first_").alias("first_id"), F.max("last_").alias("last_id"))
