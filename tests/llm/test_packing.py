"""The BM25 index against the plain formula, and retrieval across the whole table."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np


def test_index_equals_the_formula():
    from kelpie.llm.packing import B, K1, Bm25Index, idf, strongest

    r = random.Random(2)
    docs = [np.array([r.randint(0, 40) for _ in range(r.randint(1, 60))]) for _ in range(50)]
    corpus = docs + [np.array([r.randint(0, 40) for _ in range(20)]) for _ in range(30)]  # counts of more than one shard
    df = np.zeros(41)
    for d in corpus:
        df[np.unique(d)] += 1
    mean = sum(len(d) for d in corpus) / len(corpus)
    index = Bm25Index(docs, idf(df, len(corpus)), mean)

    def weight(t: int, d: np.ndarray) -> float:
        tf = Counter(d.tolist())[t]
        return math.log(1 + (len(corpus) - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(d) / mean))

    for seed in (0, 7, 49):
        want = [sum(weight(t, d) for t in set(docs[seed].tolist())) for d in docs]
        assert np.allclose(index.scores(seed), want, rtol=1e-4)
    top = strongest(docs, idf(df, len(corpus)), mean)
    for d, t in zip(docs, top.tolist(), strict=True):
        assert weight(t, d) >= max(weight(x, d) for x in set(d.tolist())) - 1e-5


def test_a_window_takes_the_best_unused_neighbours():
    from kelpie.llm.packing import fill_windows, idf

    docs = [np.array([k % 3 * 10 + j for j in range(8)]) for k in range(12)]  # three topics of four documents
    df = np.zeros(40)
    for d in docs:
        df[d] += 1
    pieces, n = fill_windows(docs, idf(df, 12), 8.0, window=32)
    assert n == 3
    for s in range(3):
        assert len({d % 3 for d, _, _, q, _ in pieces if q == s}) == 1


def test_plan_covers_all_terms():
    from kelpie.llm.packing import shard_plan

    rows = [(1, 10, 100), (2, 10, 5000), (3, 1, 10), (4, 900, 100), (9, 10, 950), (10, 1, 60)]
    first, count, shards = shard_plan(rows, 12, 1000, 100)
    assert count[2] == 5 and count[4] == 9 and count[1] == 1
    spans = sorted((int(first[t]), int(first[t] + count[t])) for t, _, _ in rows)
    assert max(b for _, b in spans) == shards and first[9] != first[10]
    assert not {*range(first[2], first[2] + 5)} & {int(first[t]) for t in (1, 3, 4, 9, 10)}


def test_related_documents_meet_wherever_they_lie(spark):
    """Documents on one subject lie in different files and far apart; they share windows."""
    from kelpie.llm.packing import pack_documents

    r = random.Random(1)
    common = [f"common{k}" for k in range(60)]
    topics = ["quasar", "zeppelin", "marzipan", "obsidian", "kumquat", "fjord"]
    rows = [(k, " ".join(r.choice(common) for _ in range(30)) + f" {topics[k % 6]}" * 6) for k in range(300)] + [(900, None), (901, ""), (None, "quasar"), (None, "quasar")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "doc_id")
    got = pack_documents(docs, window=512, shard_tokens=4000).collect()
    assert Counter(x.doc_id for x in got if x.start == 0) == Counter(i for i, _ in rows)
    windows: dict[int, Counter] = {}
    for x in got:
        if x.doc_id is not None and x.doc_id < 900:
            windows.setdefault(x.sequence_id, Counter())[x.doc_id % 6] += 1
    alike = sum(max(c.values()) for c in windows.values()) / sum(sum(c.values()) for c in windows.values())
    assert alike > 0.75, alike  # 0.17 by chance
    assert all(sum(x.length for x in got if x.sequence_id == s) in (2**k for k in range(10)) for s in windows)
