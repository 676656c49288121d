"""The containment automaton against plain searches."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.operators import containment, texts


def plain(all_texts, strings):
    return sorted((i, k) for i, t in enumerate(all_texts) for k, s in enumerate(strings) if s in t)


def buffers(all_texts):
    return np.frombuffer(b"".join(all_texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in all_texts])]).astype(np.int64)


@pytest.mark.parametrize("seed", range(40))
def test_automaton_equals_search(monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(containment, "SEGMENT", r.choice([1, 3, 16, 1024]))
    monkeypatch.setattr(containment, "HEAD", r.choice([2, 4, 256]))
    alphabet = r.choice([b"a", b"ab", bytes(range(256))])
    some = lambda n: bytes(r.choice(alphabet) for _ in range(n))
    strings = sorted({some(r.randint(1, 9)) for _ in range(r.randint(1, 30))})
    all_texts = [some(r.randint(0, 60)) + r.choice([b"", *strings]) + some(r.randint(0, 9)) for _ in range(20)] + [b""]
    a = containment.Automaton.loaded(containment.Automaton.of(strings).dumped())
    assert sorted(zip(*(x.tolist() for x in a.found(*buffers(all_texts))), strict=True)) == plain(all_texts, strings)


def test_contained_in_spark(spark, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK_BYTES", 40)  # many blocks and passes
    monkeypatch.setattr(containment, "PASS_BLOCKS", 2)
    rows = [(1, "naïve text"), (1, "naïve text"), (None, "text"), (3, None), (4, "")]
    known = [("a", "naïve"), ("b", "text"), ("b", "text"), ("c", ""), ("d", None), *[(f"x{k}", f"zzz{k}") for k in range(30)]]
    texts_, strings = spark.createDataFrame(rows, "id int, string_ string"), spark.createDataFrame(known, "name string, s string")
    found = containment.contained(texts_, ["id"], F.col("string_"), strings, F.col("s"), [F.col("name")])
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "a"), (1, "a"), (1, "b"), (1, "b"), (1, "b"), (1, "b"), (None, "b"), (None, "b")], key=str)
    for a, b in ((texts_.limit(0), strings), (texts_, strings.limit(0))):
        assert containment.contained(a, ["id"], F.col("string_"), b, F.col("s"), [F.col("name")]).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_windows_equal_search(seed):
    r = random.Random(seed)
    alphabet = r.choice(["a", "ab", "aß字𝄞 "])
    some = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    strings = sorted({some(r.randint(1, 9)).encode() for _ in range(r.randint(1, 30))})
    all_texts = [(some(r.randint(0, 60))).encode() + r.choice([b"", *strings]) for _ in range(20)] + [b""]
    bits = np.zeros(1 << 10, np.uint8)  # a small filter lets others pass
    h = containment._Spans(np.frombuffer(b"".join(strings), np.uint8)).of(*(buffers(strings)[1][k:][: len(strings)] for k in (0, 1)))
    for k in range(containment.PROBES):
        at = containment._probe(h, k, 8 * len(bits))
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    raw, off = buffers(all_texts)
    text, start, end = containment._passing(raw, off, sorted({len(s) for s in strings}), bits)
    found = [(t, raw[a:b].tobytes()) for t, a, b in zip(text.tolist(), start.tolist(), end.tolist(), strict=True)]
    assert len(found) == len(set(found))
    assert sorted((t, strings.index(s)) for t, s in found if s in strings) == plain(all_texts, strings)


@pytest.mark.parametrize("lengths", [0, 64])
def test_many_strings_in_one_pass(spark, monkeypatch, lengths):
    monkeypatch.setattr(containment, "BLOCK_BYTES", 40)
    monkeypatch.setattr(containment, "LENGTHS", lengths)
    monkeypatch.setattr(containment, "PASS_BLOCKS", 8)
    known = spark.range(100).select(F.concat(F.lit("n"), "id").alias("s"))
    files = spark.createDataFrame([(1, "doc n77 and n77"), (2, "n5"), (3, "n100"), (4, "x")], "id int, name string")
    found = containment.contained(files, ["id"], F.col("name"), known, F.col("s"), [F.col("s").alias("n")])
    assert sorted(map(tuple, found.collect())) == [(1, "n7"), (1, "n77"), (2, "n5"), (3, "n1"), (3, "n10")]
    if lengths:  # one read of the texts, not one for each eight blocks
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_longest_and_identified(spark):
    known = spark.createDataFrame([("LP-006-2026",), ("LP-006-20",), ("CVC LP 008 2026",), ("AB-000000000001",), ("AB-000000000002",)], "number string")
    files = [
        (1, "lp-006-2026.pdf", "AB-000000000001"),  # the longer of two nested ones
        (2, "cvc_lp_008_2026.pdf", "AB-000000000001"),  # separators replaced
        (3, "LP0062026.pdf", "about LP-006-20 here"),  # too short without separators: the text
        (4, "AB000000000001 AB000000000002", None),  # several without separators, no text
        (5, "AB000000000001 AB000000000002", "cvc lp 008 2026"),  # several, but the text tells
        (6, "x", "AB-000000000001 and AB-000000000002"),
        (7, None, None),
    ]
    got = containment.identified(spark.createDataFrame(files, "id int, name string, text string"), ["id"], "name", "text", known, "number").collect()
    assert {r.id: (r.number, len(r.found), r.source) for r in got} == {
        1: ("LP-006-2026", 1, "name"),
        2: ("CVC LP 008 2026", 1, "squashed name"),
        3: ("LP-006-20", 1, "text"),
        4: (None, 2, "squashed name"),
        5: ("CVC LP 008 2026", 1, "text"),
        6: (None, 2, "text"),
    }


def test_a_million_words(spark):
    """A text that consists of the phrases' own words; ten million characters."""
    phrases = spark.createDataFrame([(k, f"first{k % 50} second{k}") for k in range(200)], "id int, phrase string")
    text = " ".join(f"first{k % 50}" for k in range(1_200_000)) + " second7 first7 second7"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.time()
    found = texts.contained_phrases(docs, "doc_id", "text", phrases, "id", "phrase").collect()
    assert [(r.doc_id, r.id) for r in found] == [(1, 7)]
    assert time.time() - began < 60
