"""The methods behind the operators against plain forms of them: suffix arrays, ranks, kernels, isotonic curves, labelers."""

from __future__ import annotations

import math
import random

import numpy as np


def test_suffix_array_and_index_find_every_occurrence():
    from kelpie.llm.decontaminate import FMIndex, suffix_array

    r = random.Random(1)
    for n, sigma in ((1, 2), (40, 3), (300, 2), (500, 40)):
        text = np.array([0 if r.random() < 0.1 else r.randint(1, sigma) for _ in range(n)], np.int64)
        whole = np.append(text, 0)
        order = suffix_array(whole.copy())
        assert sorted(order.tolist()) == list(range(n + 1))

        def until_stop(i):  # a suffix up to its first 0; of two equal ones the later 0 is the smaller
            j = i + int(np.flatnonzero(whole[i:] == 0)[0])
            return [*whole[i:j].tolist(), 0, -j]

        assert order.tolist() == sorted(range(n + 1), key=until_stop)
        index = FMIndex(text)
        for c in range(sigma + 1):
            place = np.arange(n + 2)
            want = np.concatenate([[0], np.cumsum(index.bwt == c)])
            if c < index.text_sigma:
                assert (index.rank(np.full(n + 2, c), place) == want).all()
        for m in (1, 2, 3):
            phrases = np.array([[r.randint(1, sigma) for _ in range(m)] for _ in range(30)])
            low, high = index.search(phrases)
            for p, a, b in zip(phrases, low, high, strict=True):
                want = [i for i in range(n - m + 1) if (text[i : i + m] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_fourier_features_approximate_the_kernel_and_sums_give_ridge():
    from kelpie.llm.quality import GAMMA, RIDGE, STATISTICS, Rff

    r = np.random.default_rng(2)
    k = len(STATISTICS)
    rff = Rff(np.zeros(k), np.ones(k), features=8001)
    x = r.normal(0, 0.5, (20, k))
    z = rff(x)[:, :-1]
    exact = np.exp(-GAMMA * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - exact).max() < 0.06
    small = Rff(np.zeros(k), np.ones(k))
    x, y = r.normal(0, 1, (400, k)), r.integers(0, 2, 400).astype(float)
    z = small(x)
    parts = [(z[i::7].T @ z[i::7], z[i::7].T @ y[i::7]) for i in range(7)]
    a, b = sum(p for p, _ in parts), sum(q for _, q in parts)
    beta = np.linalg.solve(a + RIDGE * 400 * np.eye(len(a)), b)
    direct = np.linalg.lstsq(np.concatenate([z, np.sqrt(RIDGE * 400) * np.eye(len(a))]), np.concatenate([y, np.zeros(len(a))]), rcond=None)[0]
    assert np.allclose(z @ beta, z @ direct, atol=1e-6)


def test_isotonic_curve_is_the_best_rising_one():
    from kelpie.llm.quality import isotonic

    r = np.random.default_rng(3)
    x, y, w = np.arange(40.0), np.sort(r.normal(0, 1, 40)) + r.normal(0, 0.5, 40), r.integers(1, 5, 40).astype(float)
    at, value = isotonic(x, y, w)
    assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all()
    # the largest mean of a run that ends at or after a place, least over runs that begin at or before it
    best = [max(min(np.average(y[i : j + 1], weights=w[i : j + 1]) for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    blocks = np.unique(np.round(best, 9))
    assert np.allclose(np.sort(value), blocks)


def test_labelers_reliabilities_are_recovered():
    from collections import Counter

    from kelpie.llm.pii import VOTES, estimate, train

    r = random.Random(4)
    right = {"v_regex": 0.95, "v_check": 0.9, "v_gazetteer": 0.7, "v_context": 0.75, "v_border": 0.85}
    wrong = {"v_regex": 0.3, "v_check": 0.1, "v_gazetteer": 0.35, "v_context": 0.2, "v_border": 0.4}
    counted, truth = Counter(), {}
    for _ in range(20_000):
        y = r.random() < 0.6
        votes = tuple(1 if r.random() < (right if y else wrong)[v] else -1 for v in VOTES)
        counted["name", votes] += 1
        truth.setdefault(votes, [0, 0])[int(y)] += 1
    rows = [(k, v, n) for (k, v), n in sorted(counted.items())]
    post, reliability = estimate(rows)
    for v in VOTES:
        assert abs(reliability[v][0] - right[v]) < 0.06 and abs(reliability[v][1] - wrong[v]) < 0.06
    for (_, votes, n), q in zip(rows, post, strict=True):
        if n > 300:
            assert abs(q - truth[votes][1] / n) < 0.1
    model = train([("name", (*votes, 1, 0), n) for _, votes, n in rows])

    def logit(votes) -> float:
        return sum(model.weights.get(k, 0) for k in [("kind", "name"), *zip(VOTES, votes, strict=True), ("f_length", 1), ("f_digits", 0)])

    agree = sum(n for (_, votes, n), q in zip(rows, post, strict=True) if (logit(votes) >= 0) == (q >= 0.5))
    assert agree / 20_000 > 0.95 and math.isfinite(logit((1,) * 5))


def test_similar_sets_share_a_signature():
    from kelpie.llm.ngram_join import signatures

    r = np.random.default_rng(5)
    flags = r.random(1 << 12) < 0.5
    for n in (12, 40, 200, 1500):
        for _ in range(25):
            pool = np.unique(r.integers(0, 2**63, n + n // 8, dtype=np.uint64))
            a = np.sort(r.choice(pool, n, replace=False))
            b = a.copy()
            spare = int((1 - 0.9) / 1.9 * 2 * n / 2)
            for k in r.choice(n, spare, replace=False):
                b[k] = r.integers(0, 2**63, dtype=np.uint64)
            b = np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert np.intersect1d(signatures(a, flags), signatures(b, flags)).size
