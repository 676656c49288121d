"""Longest processing time by size classes against the plain heap over all groups, and slots of repeated rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict


def loads_of(groups: list[int], placed: dict, shards: int) -> list[int]:
    out = [0] * shards
    for k, s in placed.items():
        out[s] += groups[k]
    return out


def test_classes_equal_the_plain_heap():
    from kelpie.llm.sharding import lpt, lpt_classes

    r = random.Random(3)
    for trial in range(300):
        shards = r.randint(1, 9)
        sizes = [r.randint(1, 60) for _ in range(r.randint(1, 12))]
        groups = [s for s in sizes for _ in range(r.choice([1, 2, 5, 40, 300]))]
        plain = lpt([(s, k) for k, s in enumerate(groups)], shards)
        by_class = Counter((groups[k], s) for k, s in plain.items())
        got = lpt_classes(list(Counter(groups).items()), shards)
        assert {(size, s): n for size, s, n in got} == dict(by_class), trial
    assert lpt_classes([], 4) == []
    assert sum(n for _, _, n in lpt_classes([(7, 10**12)], 16)) == 10**12


def test_shards_equal_the_plain_heap_over_all_groups(spark, monkeypatch):
    from kelpie.llm import sharding

    monkeypatch.setattr(sharding, "COPIES", 7)
    r = random.Random(5)
    rows = [(k, "x" * r.randint(0, 40) + str(r.randint(0, 3))) for k in range(400)]
    rows += [(k, None) for k in range(60)] + [(None, "same")] * 40 + [(7, "same")] * 30 + [(None, None)] * 3
    got = sharding.shard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=3).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t in rows:
        size[t or ""] += len(t or "") + 1
    names = sorted(size)
    plain = sharding.lpt([(size[t], k) for k, t in enumerate(names)], 3)
    expected = loads_of([size[t] for t in names], plain, 3)
    load, slots = [0] * 3, defaultdict(list)
    for x in got:
        load[x.shard] += x.size
        slots[x.shard].append(x.slot)
    assert load == expected
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in rows)
    where = defaultdict(set)
    for x in got:
        where[x.text_crc32, x.size].add(x.shard)
    assert all(len(s) == 1 for s in where.values())
