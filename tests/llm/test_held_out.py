"""Held-out accuracy of the trained scores, and the gain of the language model over word counts, on the small tables."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def held_out(spark, query: str, label: str) -> tuple[float, float, float]:
    """(recall, share of false positives, area under the curve) over labelled rows that were not learnt from."""
    from kelpie.llm import registry

    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", label)
    rows = registry.queries()[query](spark, DATA).filter("held_out").join(labels, "doc_id").toPandas()
    y, p, s = rows[label].to_numpy(), rows["predicted"].to_numpy(), rows["score"].to_numpy()
    rank = np.empty(len(s))
    rank[np.argsort(s)] = np.arange(1, len(s) + 1)
    n = y.sum()
    auc = (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))
    return p[y == 1].mean(), p[y == 0].mean(), auc


def test_quality(spark):
    recall, wrong, auc = held_out(spark, "op2_rff_quality", "quality")
    print(f"quality: recall {recall:.3f}, false positives {wrong:.3f}, area {auc:.3f}")
    assert recall > 0.9 and wrong < 0.2 and auc > 0.95


def test_toxicity():
    """The network alone, on the labelled rows of a larger table; the small one has too few toxic rows to learn from."""
    import zlib

    import pyarrow as pa
    import pyarrow.parquet as pq

    from kelpie.llm.toxicity import THRESHOLD, fit, score_texts

    d = "/root/testdata/sf0.1"
    labels = {i: y for i, y in zip(*(c.to_pylist() for c in pq.read_table(f"{d}/labels.parquet", columns=["doc_id", "toxic"]).columns), strict=True)}
    table = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"])
    rows = [(i, t or "", labels[i]) for i, t in zip(*(c.to_pylist() for c in table.columns), strict=True) if i in labels and len(t or "") < 6000]
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows]
    learnt = [r for r, h in zip(rows, held, strict=True) if not h]
    some = [r for r in learnt if r[2]] + [r for r in learnt if not r[2]][:900]
    net = fit([t for _, t, _ in some], [y for _, _, y in some])
    rest = [r for r, h in zip(rows, held, strict=True) if h]
    score, y = score_texts(net, pa.array([t for _, t, _ in rest], pa.string())), np.array([y for _, _, y in rest])
    recall, wrong = (score[y == 1] >= THRESHOLD).mean(), (score[y == 0] >= THRESHOLD).mean()
    print(f"toxicity: recall {recall:.3f}, false positives {wrong:.3f}, rows {len(y)}, toxic {int(y.sum())}")
    assert recall > 0.8 and wrong < 0.04


def test_pseudo_likelihood_beats_word_counts(spark):
    import re

    from kelpie.llm import registry

    got = {r.doc_id: r for r in registry.queries()["op6_pseudo_likelihood"](spark, DATA).collect()}
    word = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    texts = {r.doc_id: word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "")) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    assert {i: r.n_words for i, r in got.items()} == {i: len(w) for i, w in texts.items()}
    counts = Counter(x for w in texts.values() for x in w)
    total = sum(counts.values())
    unigram = sum(n * np.log(n / total) for n in counts.values()) / total
    score = sum(r.log_likelihood for r in got.values()) / total
    print(f"nats a word: {score:.3f}, word counts {unigram:.3f}")
    assert score > unigram + 0.1
