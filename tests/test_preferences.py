"""Preferences against a plain loop over all notices and subscribers."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kelpie.operators.preferences import matching_notices, matching_sums, with_profile

NOTICE = "id long, country string, industries array<string>, statuses array<string>, tier string, said string, profile string"
WANTS = "who long, countries array<string>, industries array<string>, statuses array<string>, tiers array<string>, keywords array<string>"


def test_preferences_equal_a_loop(spark):
    rng = random.Random(11)
    some = lambda values, most: rng.sample(values, rng.randrange(most + 1)) + rng.choice([[], [], [None]])
    notices = [(i, rng.choice(["aa", "bb", "any", None, "zz"]), rng.choice([None, some(["x", "y", "z"], 2)]), some(["open", "closed", "any"], 3), rng.choice(["t1", "t2", None]), rng.choice(["Pump House", "Éclair any", None, ""]), "extra") for i in range(150)]
    wants = [(k, some(["aa", "bb", "any"], 2), rng.choice([None, some(["x", "y"], 2)]), some(["open", "closed"], 2), some(["t1", ""], 2), some(["PUMP", "éclair", "any"], 2)) for k in range(120)]
    given = lambda v: [x for x in v or [] if x is not None]

    def asks(n, w):
        _, country, industries, statuses, tier, said, _ = n
        _, c, i, s, t, k = (given(x) if isinstance(x, list) else [] if x is None else x for x in w)
        return country != "zz" and (not c or country in c) and (not i or set(i) & set(given(industries))) and (not s or set(s) & set(given(statuses))) and (not t or (tier or "") in t) and (not k or any(x.lower() in (said or "").lower() for x in k))

    people = with_profile(spark.createDataFrame(wants, WANTS))
    found = matching_notices(spark.createDataFrame(notices, NOTICE), people, "id", "country", "industries", "statuses", "tier", F.col("said"), ["zz"])
    got = [tuple(r) for r in people.select("who", "profile").join(found, "profile").select("who", "id").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(w[0], n[0]) for w in wants for n in notices if asks(n, w)}
    assert matching_notices(spark.createDataFrame([], NOTICE), people, "id", "country", "industries", "statuses", "tier", F.col("said")).count() == 0


def test_sums_equal_the_pairs_summed(spark):
    """Counts, least and largest ids, without a row for each pair: many notices of a few classes, most of them asked for by all."""
    rng = random.Random(3)
    notices = [(i, rng.choice(["aa", None]), rng.choice([None, ["x"], ["x", None, "y"]]), rng.choice([["open"], ["closed", "open"], ["open", "closed"]]), rng.choice(["t1", None]), rng.choice(["Pump", "house PUMP", None]), "") for i in range(300)]
    wants = [(k, rng.choice([[], ["aa"]]), rng.choice([[], ["y"]]), rng.choice([[], ["open", "closed"]]), rng.choice([None, [""]]), rng.choice([[], ["pump", "House"], ["house"], [""], ["none"]])) for k in range(60)]
    people, of = with_profile(spark.createDataFrame(wants, WANTS)), ("id", "country", "industries", "statuses", "tier", F.col("said"))
    pairs = matching_notices(spark.createDataFrame(notices, NOTICE), people, *of)
    expected = pairs.groupBy("profile").agg(F.count("*"), F.min("id"), F.max("id"))
    found = matching_sums(spark.createDataFrame(notices, NOTICE), people, *of)
    assert found.count() > 5 and sorted(found.collect()) == sorted(expected.collect())
