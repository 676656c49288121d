"""Near-duplicate self-joins and groups against plain loops over all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql.functions import lit

from kelpie.operators import near_pairs as module
from kelpie.operators.components import groups
from kelpie.operators.near_pairs import near_pairs, procurement_audit, word_nodes
from kelpie.session import stored

SCHEMA = "id long, buyer string, words array<string>, amount long, day string, recent boolean, node string, n int"
COLUMNS = ("id", "buyer", "words", "amount", "day", "recent", "node", "n")


def near(a, b, percent):
    a, b = set(a or []) - {None}, set(b or []) - {None}
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def joined(links, ids):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def made(seed, count, vocabulary, buyers):
    """Rows in which copies, near copies and a few very frequent words are common, with nulls and clashing columns."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    weights = [1 / (k + 1) for k in range(vocabulary)]
    rows, said = [], []
    for i in range(count):
        if said and rng.random() < 0.5:
            s = list(rng.choice(said))
            for _ in range(rng.randrange(3)):
                s[rng.randrange(len(s))] = rng.choices(words, weights)[0]
        else:
            s = rng.choices(words, weights, k=rng.randrange(1, 25))
        said.append(s)
        s = rng.choice([s, s, s, s, s + [None], s + s])
        rows.append((i, rng.choice([*buyers, None]), rng.choice([s] * 20 + [None, []]), rng.choice([None, 0, *range(1, count)]), rng.choice([None, *"abcdef"]), rng.random() < 0.3, "x", 7))
    return rows


@pytest.mark.parametrize("percent", [50, 80, 95, 100])
@pytest.mark.parametrize("part", [3, 1000])
def test_pairs_are_those_of_all_pairs(spark, percent, part):
    rows = made(percent + part, 260, 60, ["p", "q"])
    nodes = stored(word_nodes(spark.createDataFrame(rows, SCHEMA), ["buyer"], "words", "id", "recent"), "test-nodes")
    kept = {r.node: r for r in nodes.collect()}
    want = {tuple(sorted((a.node, b.node))) for a, b in combinations(kept.values(), 2) if a.buyer == b.buyer and (a.asked or b.asked) and near(a.words, b.words, percent)}
    got = [tuple(r) for r in near_pairs(nodes, ["buyer"], percent, part_nodes=part).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plain = {(b, tuple(sorted(set(w) - {None}))) for _, b, w, *_ in rows if b and w and set(w) - {None}}
    assert {(r.buyer, tuple(r.words)) for r in kept.values()} == plain


@pytest.mark.parametrize("percent", [30, 50, 70, 80, 95])
def test_pairs_of_crowded_blocks_and_of_words_put_in_order_by_a_join(spark, monkeypatch, percent):
    rows = made(percent, 200, 40, ["p", "q"])
    nodes = stored(word_nodes(spark.createDataFrame(rows, SCHEMA), ["buyer"], "words", "id", "recent"), "test-nodes")
    listed = sorted(tuple(r) for r in near_pairs(nodes, ["buyer"], percent, carry=["first_id"]).collect())
    monkeypatch.setattr(module, "LISTED_WORDS", 5)
    monkeypatch.setattr(module, "BLOCK_NODES", 5)
    kept = {r.node: r.first_id for r in nodes.collect()}
    joined_ = sorted(tuple(r) for r in near_pairs(nodes, ["buyer"], percent, part_nodes=4, carry=["first_id"]).collect())
    assert (listed or percent > 80) and joined_ == listed and all((a, b) == (kept[u], kept[v]) for u, v, a, b in listed)


def rows_sent(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    empty, none = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, empty, none)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_frequent_words_do_not_multiply_the_rows_sent(spark):
    """4,000 sets over 24 words: each word is in hundreds of sets, and still a set is sent to few buckets."""
    rng = random.Random(7)
    sets = {tuple(sorted(rng.sample(range(24), 4))) for _ in range(4_000)}
    rows = [(i, "p", [f"w{k}" for k in s], 1, "d", True, None, None) for i, s in enumerate(sets)]
    nodes = stored(word_nodes(spark.createDataFrame(rows, SCHEMA), ["buyer"], "words", "id", "recent"), "test-nodes")
    before = rows_sent(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for it
    try:
        pairs = near_pairs(nodes, ["buyer"], 70, part_nodes=5).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = rows_sent(spark) - before
    assert pairs == 0 and len(sets) < sent < 40 * len(sets), sent


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_short_sets_that_meet_in_a_bucket_are_near(spark, monkeypatch, percent):
    """With both checks left out a crowded block gives the same pairs, so none is made that they would have to drop."""
    rng = random.Random(percent)
    rows = [(i, "p", [f"w{k}" for k in rng.sample(range(12), rng.randrange(1, 7))], 1, "d", True, None, None) for i in range(700)]
    nodes = stored(word_nodes(spark.createDataFrame(rows, SCHEMA), ["buyer"], "words", "id", "recent"), "test-nodes")
    kept = [(r.node, r.words) for r in nodes.collect()]
    want = {tuple(sorted((u, v))) for (u, a), (v, b) in combinations(kept, 2) if near(a, b, percent)}
    monkeypatch.setattr(module, "BLOCK_NODES", 5)
    for check in ("_sketched", "_near"):
        monkeypatch.setattr(module, check, lambda *_: lit(True))
    got = [tuple(r) for r in near_pairs(nodes, ["buyer"], percent).collect()]
    assert (want or percent == 90) and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("percent", [30, 50, 70, 80])
def test_pairs_of_short_and_long_sets_of_crowded_blocks(spark, monkeypatch, percent):
    """Sizes on both sides of the largest short one, in one crowded block."""
    rng = random.Random(percent)
    said = [rng.sample(range(26), rng.randrange(1, 24)) for _ in range(120)]
    for s in said[:]:
        said.append(sorted({*s[rng.randrange(3) :], rng.randrange(26)}))
    rows = [(i, "p", [f"w{k}" for k in s], 1, "d", i % 3 > 0, None, None) for i, s in enumerate(said)]
    nodes = stored(word_nodes(spark.createDataFrame(rows, SCHEMA), ["buyer"], "words", "id", "recent"), "test-nodes")
    kept = nodes.collect()
    want = {tuple(sorted((a.node, b.node))) for a, b in combinations(kept, 2) if (a.asked or b.asked) and near(a.words, b.words, percent)}
    monkeypatch.setattr(module, "BLOCK_NODES", 5)
    got = [tuple(r) for r in near_pairs(nodes, ["buyer"], percent).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_an_audit_sends_a_row_few_times(spark):
    """3,000 rows, nine of ten in blocks without a row asked about: words are put in order once, and those blocks stay."""
    rng = random.Random(3)
    rows = [(i, f"p{i % 50}", [f"w{k}" for k in rng.sample(range(40), 4)], i + 1, f"d{i % 10}", i % 10 == 0, None, None) for i in range(3_000)]
    df = stored(spark.createDataFrame(rows, SCHEMA), "test-rows")
    before = rows_sent(spark)
    assert procurement_audit(df, "id", "buyer", "words", "amount", "day", "recent").count() == 3_000
    sent = rows_sent(spark) - before
    assert sent < 4 * len(rows), sent


@pytest.mark.parametrize("seed", range(3))
def test_audit_equals_all_pairs(spark, seed):
    rows = made(seed, 160, 40, ["p", "q", "r"])
    links, why = [], {r[0]: set() for r in rows}
    for a, b in combinations(rows, 2):
        if not (a[5] or b[5]):
            continue
        (buyer, w, amount, day), (buyer2, w2, amount2, day2) = a[1:5], b[1:5]
        reasons = set()
        if buyer and buyer == buyer2:
            reasons |= {"same_amount"} if amount and amount == amount2 else set()
            reasons |= {"same_day"} if day and day == day2 and near(w, w2, 50) else set()
            reasons |= {"same_words"} if near(w, w2, 80) else set()
        reasons |= {"same_offer"} if amount and amount == amount2 and near(w, w2, 100) else set()
        if reasons:
            links.append((a[0], b[0]))
            why[a[0]] |= reasons
            why[b[0]] |= reasons
    roots = joined(links, why)
    got = procurement_audit(spark.createDataFrame(rows, SCHEMA), "id", "buyer", "words", "amount", "day", "recent").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.group_id == roots[r.id]
        assert {k for k in ("same_amount", "same_day", "same_words", "same_offer") if r[k]} == why[r.id]


def test_audit_of_no_rows_and_of_rows_that_say_nothing(spark):
    assert procurement_audit(spark.createDataFrame([], SCHEMA), "id", "buyer", "words", "amount", "day", "recent").count() == 0
    rows = [(1, None, None, None, None, None, None, None), (2, "p", [], 0, None, True, None, None), (None, "p", ["a"], 5, "d", True, None, None), (3, "p", ["a"], 5, "d", None, None, None)]
    got = procurement_audit(spark.createDataFrame(rows, SCHEMA), "id", "buyer", "words", "amount", "day", "recent").collect()
    assert sorted(tuple(r) for r in got) == [(i, i, False, False, False, False) for i in (1, 2, 3)]


def test_a_large_class_is_not_expanded(spark):
    """20,000 equal rows are one node; pairs among them are never made."""
    df = spark.range(20_000).selectExpr("id", "'p' AS buyer", "array('a', 'b') AS words", "5L AS amount", "'d' AS day", "id = 19999 AS recent")
    got = procurement_audit(df, "id", "buyer", "words", "amount", "day", "recent")
    assert got.filter("group_id = 0 and same_amount and same_day and same_words and same_offer").count() == 20_000


def test_groups_of_chains_stars_and_nothing(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(300)]
    loose = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    links = chain + star + loose + chain[:5] + [(None, 3), (4, None)]
    rng.shuffle(links)
    got = {r.member: r.first for r in groups(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == joined(real, {x for pair in real for x in pair})
    assert groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ends_of_one_link_are_sent_in_one_step(spark):
    """A chain of 200, each with 50 that hang on it alone: the steps that shorten the chain leave those where they are."""
    chain = [(100 * i, 100 * i + 100) for i in range(200)]
    links = stored(spark.createDataFrame(chain + [(100 * i, 100 * i + 1 + k) for i in range(200) for k in range(50)], "a long, b long"), "test-links")
    before = rows_sent(spark)
    assert groups(links).filter("first = 0").count() == 201 + 200 * 50
    sent = rows_sent(spark) - before
    assert sent < 10 * links.count(), sent
