"""Orders with turns, quotas and related rows against plain loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kelpie.operators import board as ops


def rotated(items, key):
    queues: dict = {}
    for x in items:
        queues.setdefault(x[key], []).append(x)
    out, k = [], 0
    while len(out) < len(items):
        out += [q[k] for q in queues.values() if k < len(q)]
        k += 1
    return out


def test_turns_inside_runs(spark):
    r = random.Random(1)
    rows = [(k, r.randint(0, 4), r.choice("abcd")) for k in range(200)]
    got = {x.id: x.place for x in ops.interleaved_runs(spark.createDataFrame(rows, "id int, run int, key string"), ["run"], "key", [F.asc("id")]).collect()}
    for run in range(5):
        mine = [{"id": i, "key": k} for i, q, k in rows if q == run]
        assert [x["id"] for x in rotated(mine, "key")] == [i for _, i in sorted((got[x["id"]], x["id"]) for x in mine)]


def test_runs_are_consecutive(spark):
    rows = [(1, "g", v) for v in ()] or [(k, "g", v) for k, v in enumerate(["a", "a", None, None, "a", "b", "b", "a"])]
    got = {x.id: x.run for x in ops.consecutive_runs(spark.createDataFrame(rows, "id int, g string, v string"), ["g"], [F.asc("id")], "v").collect()}
    assert [len({got[k] for k in ks}) for ks in ((0, 1), (2, 3), (5, 6))] == [1, 1, 1] and len(set(got.values())) == 5


def test_showcase_equals_the_greedy_loop(spark):
    r = random.Random(2)
    tags = ["x", "y", "z"]
    for _ in range(4):
        rows = [(k, r.sample(tags + ["other"], r.randint(1, 3)), r.choice("abc"), r.randint(0, 2), r.choice([None, 1, 2, 3])) for k in range(r.choice([0, 3, 12, 120]))]
        taken, want = set(), []
        order = sorted(rows, key=lambda x: (x[3], x[4] is None, x[4] or 0, x[0]))
        for tag in tags:
            pool = [x for x in order if x[0] not in taken and tag in x[1]]
            picks: list = []
            for x in pool:
                if len(picks) < 2 and not (picks and any(p[2] == x[2] for p in picks) and any(o not in picks and o[3] == x[3] and all(o[2] != p[2] for p in picks) for o in pool)):
                    picks.append(x)
            for x in pool:
                if len(picks) < 2 and x not in picks:
                    picks.append(x)
            taken |= {x[0] for x in picks}
            want += [(x[0], tag, n) for n, x in enumerate(picks, 1)]
        df = spark.createDataFrame(rows, "id int, tags array<string>, country string, size int, due int").repartition(3)
        got = [tuple(x) for x in ops.showcase(df, "id", "tags", "country", "size", ["due"], tags, 2).collect()]
        assert sorted(got) == sorted(want)


def test_related_rows_meet_heads_only(spark):
    r = random.Random(3)
    tags = ["p", "q", "general"]
    rows = [(k, r.choice("ab"), r.sample(tags, r.randint(1, 3)), r.randint(0, 5)) for k in range(80)]
    df = spark.createDataFrame(rows, "id int, block string, tags array<string>, due int")
    got = sorted((x.id, x.other, x.place) for x in ops.related(df, "id", "block", "tags", [F.asc("due"), F.asc("id")], 3, "general").collect())
    want = []
    for i, block, mine, _ in rows:
        others = sorted((-len((set(mine) - {"general"}) & set(t)), due, j) for j, b, t, due in rows if b == block and j != i)
        want += [(i, j, n) for n, (_, _, j) in enumerate(others[:3], 1)]
    assert got == sorted(want)


def test_recommended_order_in_whole(spark):
    """Sections, classes and turns of every row against plain sorting."""
    from itertools import groupby

    from kelpie.plans import board

    rows = [r.asDict() for r in board.sort_recommended(spark, "/root/testdata/sf0.001").collect()]
    facts = {r.id: r for r in board._board(spark, "/root/testdata/sf0.001").filter("tier <> 'excluded'").collect()}
    assert sorted(r["id"] for r in rows) == sorted(facts)
    today = str(board.base.TODAY)
    for r in rows:
        f = facts[r["id"]]
        coming = f.deadline is not None and str(f.deadline)[:10] >= today
        expected = 0 if coming and f.status in board.LIVE else {"planned": 1, "suspended": 2, "awarded": 3}.get(f.status, 4 if coming else 5)
        assert r["class"] == expected and (r["section"] == 2) == (expected > 0)
        if r["section"] == 2:
            assert r["run"] == str(f.deadline if coming else f.pub)[:10]
    key = lambda r: (r["class"], r["deadline"] is not None and r["deadline"] >= today, r["run"])
    for _, run in groupby(sorted((r for r in rows if r["section"] == 2), key=key), key=key):
        run = list(run)
        ids = sorted(r["id"] for r in run)
        queues, turns = {}, []
        for i in ids:
            queues.setdefault(facts[i].country, []).append(i)
        while any(queues.values()):
            turns += [q.pop(0) for q in queues.values() if q]
        assert [r["id"] for r in sorted(run, key=lambda r: r["place"])] == turns
    assert len([r for r in rows if r["section"] == 0]) <= 2 * len(board.INDUSTRIES)


def test_early_pages(spark):
    from pyspark.sql import functions as F

    from kelpie.operators.notices import page

    frame = spark.range(95).repartition(4)
    for number, first, n in ((-3, 0, 10), (1, 0, 10), (3, 20, 10), (10, 90, 5), (77, 90, 5)):
        assert sorted(r.id for r in page(frame, [F.asc("id")], number, 10).collect()) == list(range(first, first + n))
    assert page(frame.limit(0), [F.asc("id")], 4, 10).count() == 0
