"""The manifest against a plain recursive tree, and appended witnesses against whole trees."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """(root, siblings of each node as (left, right) pairs) by plain levels."""
    paths, below = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, under = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for k in range(len(run)):
                for leaf in below[at + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(H(*run))
            under.append([x for b in below[at : at + 16] for x in b])
        nodes, below = up, under
    return nodes[0], paths


def folded(leaf, path):
    for left, right in path:
        leaf = H(left, leaf, right)
    return leaf


def brute(rows):
    def leaf(row, text):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))

    trees = {}
    for row in rows:
        text = row[4]
        seen = text
        if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
            seen = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        trees.setdefault(row[1], []).append(((row[0] is not None, row[0] or 0, leaf(row, text)), leaf(row, text), leaf(row, seen), row[0]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    sub = {s: tree([x[1] for x in sorted(trees[s])]) for s in names}
    root, above = tree([sub[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for (_, leaf_, seen, doc_id), path in zip(sorted(trees[s]), sub[s][1], strict=True):
            whole = path + up
            out.append((doc_id, leaf_, sub[s][0], root, H(*(x for p in whole for x in p)), folded(seen, whole), folded(seen, whole) == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, node int"


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 40, "b": 1, None: 3}, {"a": 700, "": 17, "ä": 16}, {f"s{k}": 1 + k % 3 for k in range(40)}])
def test_equal_to_a_plain_tree(spark, sizes):
    from pyspark.sql import functions as F

    from kelpie.llm import merkle

    r = random.Random(1)
    rows = [(r.choice([None, *range(900)]) if s == "a" else k, s, r.choice([None, "en"]), k, r.choice([None, "", "Some Text", "lower", f"Ö{k}"]), "x", 1) for s, n in sizes.items() for k in range(n)]
    rows += rows[:2]
    seen = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", merkle._UPPER, merkle._LOWER)).otherwise(F.col("text"))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = merkle.manifest(frame, seen=seen, full=True, levels=1).collect()  # blocks of 16, so that several rounds are needed
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(x)[:7] for x in got), key=key) == sorted(brute(rows), key=key)
    assert all(merkle.fold(x.leaf, x.witness) == x.root for x in got)


def test_nothing_gives_nothing(spark):
    from kelpie.llm.merkle import manifest

    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4095, 4096])
def test_witnesses_grow_as_siblings_join(n):
    from kelpie.llm.merkle import Appender, levels_of, resolve

    nodes = [H(str(k)) for k in range(n)]
    stream = Appender(levels_of(n))
    first = stream.append(nodes[0])
    witnesses = [first]
    for k, node in enumerate(nodes[1:], 1):
        witnesses.append(stream.append(node))
        if first and k < 16:
            assert len(first[0][0].nodes) == k + 1  # each sibling extends the open run's witnesses
    root, paths = tree(nodes)
    assert stream.finish() == root
    assert [resolve(w) for w in witnesses] == [[x for p in path for x in p] for path in paths]
