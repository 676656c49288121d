"""Removal of repeated strings against every window by itself; suffix arrays against sorted suffixes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        spans = int(np.count_nonzero(np.diff(gone.astype(int)) == 1) + gone[0])
        out.append((doc_id, len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)

    def prose(n):
        return "".join(r.choice("abcdeé ßz日") for _ in range(n))

    passage, line, page = prose(90), prose(45), prose(400)
    docs = [None, "", "short", prose(39), prose(40), "a" * 300, "ab" * 100, "aab" * 77, page, page, page, page[:250] + "X" + page[250:], passage * 3]
    for _ in range(60):
        docs.append(prose(r.randint(0, 300)) + r.choice([passage, line, line + line, passage[:50], "a" * 60, ""]) + prose(r.randint(0, 300)))
    return [(k if k % 7 else 7, t) for k, t in enumerate(docs)] + [(None, passage)]


@pytest.mark.parametrize(("shard", "piece"), [(2 << 20, 1 << 20), (300, 128), (0, 1 << 20)])
def test_equal_to_every_window(spark, shard, piece):
    """With whole shards, with tiny shards and pieces, and with every key on the way round."""
    from pyspark.sql import functions as F

    from kelpie.llm import repeats

    rows = corpus(3)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, key string").repartition(4)
    out = repeats.remove_repeats(frame, length=40, k=12, shard_bytes=shard, piece=piece)
    got = out.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("kept")).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 40), key=key)
    assert repeats.remove_repeats(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("dense", "many"), [(0, 0), (10**9, 0), (0, 10**9), (128, 4)])
def test_suffix_arrays_and_prefixes(monkeypatch, dense, many):
    from kelpie.llm import suffix_array as s

    monkeypatch.setattr(s, "DENSE", dense)
    monkeypatch.setattr(s, "MANY", many)
    r = np.random.default_rng(dense % 97 + many % 89)
    for trial in range(250):
        t = r.integers(0, r.choice([1, 2, 3, 256]), r.integers(0, 80)).astype(np.uint8)
        t = np.tile(t[: 1 + len(t) // 4], 4) if trial % 3 == 0 else t
        b = bytes(t)
        sa = s.suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        prefixes = s.common_prefixes(t, sa)
        for x, y in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            same = next((k for k in range(len(b)) if b[x + k : x + k + 1] != b[y + k : y + k + 1] or x + k >= len(b) or y + k >= len(b)), len(b))
            assert prefixes[y] == same


def test_long_runs():
    from kelpie.llm.suffix_array import common_prefixes, suffix_array

    n = 100_000
    t = np.zeros(n, np.uint8)
    sa = suffix_array(t)
    assert np.array_equal(sa, np.arange(n)[::-1])
    assert np.array_equal(common_prefixes(t, sa), np.append(np.arange(n - 1)[::-1] + 1, 0))
