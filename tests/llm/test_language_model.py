"""The masked window network against probabilities worked out place by place, and its gain over a unigram model."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np


def small_net():
    from kelpie.llm import language_model as lm

    r = np.random.default_rng(1)
    net = lm.Window(lm.Tree(r.integers(1, 1000, 25).astype(float)))
    for v in net.rows.values():
        v += r.normal(0, 0.5, v.shape).astype(np.float32)
    return lm, net


def test_every_token_is_masked_and_probabilities_add_up():
    lm, net = small_net()
    r = np.random.default_rng(2)
    texts = [r.integers(0, 25, n) for n in (1, 2, 7, 40)]
    leaves, places = lm.padded(texts, 25)
    assert (leaves[places] == np.concatenate(texts)).all()
    got = net.log_probability(net.layer(leaves)[places], leaves[places])

    def probability(h, leaf: int) -> float:
        p = 1.0
        for j in range(int(net.tree.length[leaf])):
            unit = int(net.tree.node[j][leaf])
            z = float(h @ net.rows["unit"][unit]) + float(net.rows["bias"][unit, 0])
            p *= 1 / (1 + np.exp(-float(net.tree.turn[j][leaf]) * z))
        return p

    at = 0
    for text in texts:
        for k, word in enumerate(text.tolist()):
            x = np.zeros(lm.WIDTH)
            for d in range(1, lm.SIDE + 1):
                x += net.rows["left"][text[k - d] if k >= d else 25]
                x += net.rows["right"][text[k + d] if k + d < len(text) else 25]
            h = np.tanh(x / (2 * lm.SIDE) ** 0.5)
            all_ = [probability(h, w) for w in range(25)]
            assert abs(sum(all_) - 1) < 1e-5
            assert abs(np.log(all_[word]) - got[at]) < 1e-4
            other = text.copy()
            other[k] = (word + 1) % 25  # the word at the place has no part in what is expected there
            l2, p2 = lm.padded([other], 25)
            assert np.allclose(net.layer(l2)[p2][k], h, atol=1e-5)
            at += 1


def test_a_step_follows_the_slope(monkeypatch):
    lm, net = small_net()
    monkeypatch.setattr(lm, "RATE", 0.01)
    leaves, places = lm.padded([np.random.default_rng(3).integers(0, 25, 300)], 25)
    score = lambda: float(net.log_probability(net.layer(leaves)[places], leaves[places]).mean())
    before = score()
    seen, power = {k: np.zeros(len(v)) for k, v in net.rows.items()}, {k: np.zeros(len(v), np.float32) for k, v in net.rows.items()}
    for _ in range(20):
        net.step(leaves, places, seen, power)
    assert score() > before + 0.02


def test_untrained_units_give_the_word_counts():
    from kelpie.llm import language_model as lm

    counts = np.array([50.0, 20, 20, 6, 3, 1])
    net = lm.Window(lm.Tree(counts))
    got = net.log_probability(np.zeros((6, lm.WIDTH), np.float32), np.arange(6))
    assert np.allclose(np.exp(got), counts / counts.sum(), atol=1e-5)


def test_scores_beat_unigrams_and_tell_repeated_texts(spark):
    """Two vocabularies that never mix: the words around a place tell which one it is from."""
    from kelpie.llm.language_model import score_documents

    r = random.Random(7)
    sides = [[f"{s}{k}{s}" for k in range(200)] for s in "ab"]
    rows = []
    for k in range(400):
        words = [r.choice(sides[k % 2]) for _ in range(120)] + [f"only{k}of{r.random()}"]
        rows.append((k, " ".join(words)))
    rows += [(1000, rows[0][1]), (1001, None), (1002, " .,! "), (1003, ""), (None, "a1a a2a")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, leaves string").repartition(4)
    got = score_documents(docs, stride=1, rounds=4)
    assert got.columns == ["doc_id", "text", "leaves", "n_words", "log_likelihood", "mean_log_likelihood", "n_unseen"]
    by_id = {x.doc_id: x for x in got.collect()}
    assert len(by_id) == len(rows) and by_id[5].text == rows[5][1] and by_id[5].leaves == "x"
    words = Counter(w for _, t in rows for w in (t or "").split())
    total = sum(words.values())
    unigram = np.mean([np.log(words[w] / total) for _, t in rows[:400] for w in t.split() if not w.startswith("only")])
    score = np.mean([by_id[k].mean_log_likelihood for k in range(400)])
    assert score > unigram + 0.3, (score, unigram)
    for i in (1001, 1002, 1003):
        assert (by_id[i].n_words, by_id[i].log_likelihood, by_id[i].mean_log_likelihood, by_id[i].n_unseen) == (0, 0.0, 0.0, 0)
    assert abs(by_id[0].log_likelihood - by_id[1000].log_likelihood) < 1e-3
    assert all(x.log_likelihood < 0 for i, x in by_id.items() if i not in (1001, 1002, 1003))


def test_words_of_one_document_alone_are_counted(spark):
    from kelpie.llm import language_model as lm

    rows = [(1, "the the the new new old"), (2, "the old thing thing"), (3, "the the thing other"), (4, "the one one one"), (5, "the one")]
    got = {x.doc_id: x.n_unseen for x in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), carry=["doc_id"], head=1).collect()}
    assert got == {1: 2, 2: 0, 3: 1, 4: 0, 5: 0}


def test_the_rounds_learn_from_every_place(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    from kelpie.llm import language_model as lm

    _, net = small_net()
    seen: list[int] = []
    monkeypatch.setattr(lm.Window, "step", lambda self, leaves, places, *_: seen.extend(places.tolist()))
    texts = [np.arange(n, dtype="<u2") % 25 for n in (1, 2, 7, 40)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts], pa.binary())], ["leaves"])
    for turn in range(lm.ROUNDS):
        list(lm._train(SimpleNamespace(value=(net.tree, net.rows)), turn * lm.STRIDE // lm.ROUNDS, lm.STRIDE)([batch]))
    assert sorted(seen) == lm.padded([t.astype(np.int64) for t in texts], net.edge)[1].tolist()


def test_a_step_equals_slopes_of_plain_loops():
    """Sums of slopes by unit and by context word, against loops over places and units."""
    from kelpie.llm import language_model as lm

    r = np.random.default_rng(11)
    net = lm.Window(lm.Tree(r.integers(1, 1000, 25).astype(float)))
    net.rows["unit"] = r.normal(0, 0.3, net.rows["unit"].shape).astype(np.float32)
    leaves, places = lm.padded([r.integers(0, 25, 40), r.integers(0, 25, 3)], net.edge)
    old = {k: v.copy() for k, v in net.rows.items()}
    slope, n = {k: np.zeros(v.shape) for k, v in old.items()}, {k: np.zeros(len(v)) for k, v in old.items()}
    scale = (2 * lm.SIDE) ** -0.5
    for p in places:
        context = [("left", leaves[p - k]) for k in range(1, lm.SIDE + 1)] + [("right", leaves[p + k]) for k in range(1, lm.SIDE + 1)]
        h = np.tanh(sum(old[name][w].astype(float) for name, w in context) * scale)
        dh = np.zeros(lm.WIDTH)
        for j in range(net.tree.length[leaves[p]]):
            node, turn = int(net.tree.node[j][leaves[p]]), net.tree.turn[j][leaves[p]]
            dz = turn / (1 + np.exp(turn * (old["unit"][node] @ h + old["bias"][node, 0])))
            dh += dz * old["unit"][node]
            for name, g in (("unit", dz * h), ("bias", dz)):
                slope[name][node] += g
                n[name][node] += 1
        for name, w in context:
            slope[name][w] += dh * (1 - h * h) * scale
            n[name][w] += 1
    seen = {k: np.zeros(len(v)) for k, v in old.items()}
    power = {k: np.zeros(len(v), np.float32) for k, v in old.items()}
    net.step(leaves, places, seen, power)
    for name in old:
        g = slope[name] / np.sqrt(np.maximum(n[name], 1))[:, None]
        want = old[name] + lm.RATE * g / np.sqrt((g**2).mean(1) + 1e-3)[:, None]
        assert (seen[name] == n[name]).all() and np.allclose(net.rows[name], want, atol=2e-4), name


def test_a_step_is_the_same_with_units_as_matrices_or_by_paths(monkeypatch):
    from kelpie.llm import language_model as lm

    r = np.random.default_rng(8)
    counts, leaves, rows = r.zipf(1.3, 300).clip(0, 9999).astype(float), r.integers(0, 300, 400), {}
    for top in (0, 1, 31, 1000):
        monkeypatch.setattr(lm, "TOP", top)
        net = lm.Window(lm.Tree(counts))
        run, places = lm.padded([leaves], 300)
        seen, power = {k: np.zeros(len(v)) for k, v in net.rows.items()}, {k: np.zeros(len(v), np.float32) for k, v in net.rows.items()}
        for _ in range(2):
            net.step(run, places, seen, power)
        rows[top] = net.rows | {f"seen {k}": v for k, v in seen.items()}
        assert all(np.allclose(rows[top][k], rows[0][k], atol=1e-4) for k in rows[0])


def planned(lm, counts, leaves: np.ndarray, batches: list[np.ndarray], together: bool):
    net = lm.Window(lm.Tree(counts))
    seen, power = {k: np.zeros(len(v)) for k, v in net.rows.items()}, {k: np.zeros(len(v), np.float32) for k, v in net.rows.items()}
    plans = net.plans(leaves, batches, seen) if together else [None] * len(batches)
    for some, plan in zip(batches, plans, strict=True):
        net.step(leaves, some, seen, power, plan)
    return net.rows | {f"seen {k}": v for k, v in seen.items()}


def test_steps_planned_together_equal_steps_alone():
    """Batches of one place, of one word over and over, and in any order of places, beside ordinary ones."""
    from kelpie.llm import language_model as lm

    r = np.random.default_rng(12)
    counts = r.zipf(1.3, 300).clip(0, 9999).astype(float)
    leaves, places = lm.padded([r.integers(0, 300, 400), np.full(100, int(np.argmin(counts))), np.full(60, int(np.argmax(counts))), r.integers(0, 300, 1)], 300)
    batches = [places[:64], r.permutation(places[64:400:2]), places[400:500], places[500:560], places[560:], places[65:400:2]]
    one, other = (planned(lm, counts, leaves, batches, x) for x in (True, False))
    assert all(np.allclose(one[k], other[k], atol=1e-5) for k in one)
    contexts = np.zeros(301)
    np.add.at(contexts, np.concatenate([leaves[x - k] for x in batches for k in range(1, lm.SIDE + 1)]), 1)
    assert (one["seen left"] == contexts).all()


def test_a_run_of_places_takes_its_context_words_once():
    from kelpie.llm import language_model as lm

    _, net = small_net()
    leaves, places = lm.padded([np.arange(2000) % 25], 25)
    batch = np.concatenate([places[i : i + lm.RUN] for i in range(0, 1500, 3 * lm.RUN)])
    (plan,) = net.plans(leaves, [batch], {k: np.zeros(len(v)) for k, v in net.rows.items()})
    assert len(plan["context"]) == len(batch) + 2 * lm.SIDE * len(batch) / lm.RUN
    assert (plan["context"][plan["place"]] == leaves[batch]).all()


def test_sums_in_layers_equal_sums_by_row():
    from kelpie.llm import language_model as lm

    r = np.random.default_rng(4)
    row, cut = r.zipf(1.2, 3000).clip(0, 500), np.array([0, 1000, 1000, 1001, 3000])
    for width in (1, lm.WIDTH):
        x = r.normal(0, 1, (3000, width)).astype(np.float32)
        for (i, j), (order, layers, rows, (n,)) in zip(zip(cut[:-1], cut[1:], strict=True), lm._mentions(row, cut), strict=True):
            want, times = np.zeros((501, width)), np.bincount(row[i:j], minlength=501)
            np.add.at(want, row[i:j], x[i:j])
            assert (np.sort(rows) == np.flatnonzero(times)).all() and (n == times[rows]).all()
            if j > i:
                assert np.allclose(lm._sums(x[i:j].take(order, 0), layers), want[rows], atol=1e-3)
