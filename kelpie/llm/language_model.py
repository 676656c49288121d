"""Masked pseudo-likelihood: a bidirectional window network predicts every word from the words on both sides.

Every distinct word of the corpus is counted in a table that grows with it. The HEAD most frequent words are leaves of their
own in a Huffman tree; the others share a leaf with the words of the same ending, inside which their own count decides. Two
embeddings a leaf, one for words to the left of the masked place and one for words to the right, are summed over SIDE words
each and squashed; every node of the tree holds a logistic unit over that layer, so the probabilities of all leaves add up
to 1 and a word costs as many units as its code is long. The units' biases start from the corpus counts.

Training passes over all texts. In each round, every partition starts from the same network, runs stochastic gradient steps
on every STRIDE-th run of RUN places, and hands in the rows it has changed; Spark adds them up, each row weighted by how often it
was changed, and the averages are the next round's network. Words without a leaf of their own are scored by their count in
all other documents, through a join with the table of counts. A document's score is the sum over its words.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import ALNUM, LOWER, discard, finished_shuffles_go, materialize, quiet_threads, ranges, running_sums, slices, span_hashes, table, utf8_of, word_spans

HEAD, BUCKETS = 28_672, 4096
SIDE, WIDTH = 3, 16
#: Each round learns from every STRIDE-th run of places, from another one on: together the rounds learn from all.
STRIDE, ROUNDS = 2, 2
RATE, BATCH = 0.3, 1024
#: The tree's heaviest units, over two fifths of all that words descend through: a step takes them for all its places as matrices.
TOP = 31
#: Places are dealt to the rounds and shuffled in runs of so many, which have most of the words around them in common.
RUN = 64
#: So many slopes of a row are added as layers over all rows, further ones row by row.
LAYERS = 6
#: Steps are planned so many at once.
PLANNED = 16
SUFFIX = 3
CHUNK_BYTES = 256 << 10
PLACES = 4096
#: What a word that no other document holds counts as.
UNSEEN = 0.5


def words_of(texts: pa.Array):
    """(hashes, buckets, first) of chunks of texts: each word's hash, the bucket of its ending, each text's first word."""
    whole, offsets = utf8_of(texts)
    for i, j in slices(offsets, CHUNK_BYTES):
        raw = LOWER[whole[offsets[i] : offsets[j]]]
        start, end, first = word_spans(raw, offsets[i : j + 1] - offsets[i], ALNUM)
        sums = running_sums(raw)
        ending = span_hashes(raw, np.maximum(start, end - SUFFIX), end, sums)
        yield span_hashes(raw, start, end, sums).view(np.int64), (ending % np.uint64(BUCKETS)).astype(np.int64), first


def _count_words(batches):
    """(word, bucket, count), summed over about a million words at a time."""

    def summed(parts):
        word, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
        code, word = pd.factorize(word)
        of = np.empty(len(word), np.int64)
        of[code] = bucket  # one word, one ending
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(of), pa.array(np.bincount(code, minlength=len(word)))], ["word", "bucket", "count"])

    held, size = [], 0
    for batch in batches:
        for word, bucket, _ in words_of(batch.column(0)):
            held.append((word, bucket))
            size += len(word)
            if size >= 1 << 20:
                yield summed(held)
                held, size = [], 0
    if held:
        yield summed(held)


class Tree:
    """A Huffman tree over leaves. At depth j, leaf k's path has the unit node[j][k] and goes turn[j][k] (-1 or 1) there;
    length[k] is the number of units on the path, the root first."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        weight = np.append(np.maximum(counts, 0.01), np.zeros(n))
        heap = [(c, k) for k, c in enumerate(weight[:n].tolist())]
        heapq.heapify(heap)
        above, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
        root = 2 * n - 2
        for new in range(n, root + 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            above[x] = above[y] = new
            side[y] = 1
            weight[new] = a + b
            heapq.heappush(heap, (a + b, new))
        right = np.zeros(2 * n)
        turned = np.flatnonzero(side)
        right[above[turned]] = weight[turned]
        share = right[n : root + 1] / weight[n : root + 1]
        self.bias = np.log(share / (1 - share)).astype(np.float32)
        up, turns, at = [], [], np.arange(n)
        while (at != root).any():  # all leaves climb together; those at the root stay there
            turns.append(np.where(at == root, 0, 2 * side[at] - 1))
            at = np.where(at == root, root, above[at])
            up.append(at - n)
        self.length = np.array([(t != 0) for t in turns]).sum(0)
        depth = len(up)
        back = self.length[None, :] - 1 - np.arange(depth)[:, None]  # the climb, seen from the root
        live = back >= 0
        pick = lambda x: np.take_along_axis(np.array(x), np.maximum(back, 0), 0) * live
        self.node, self.turn = pick(up).astype(np.uint16), pick(turns).astype(np.float32)
        # the same paths one after another: leaf k's are path[start[k] : start[k] + length[k]], and turns alike
        self.start = np.cumsum(self.length) - self.length
        live = live.T
        self.path, self.turns = self.node.T[live], self.turn.T[live]
        # units are numbered by rising weight, so the heaviest are the last ones, and every path begins with some of them
        self.light = max(len(self.bias) - TOP, 0)
        heavy = self.path >= self.light
        leaf = np.repeat(np.arange(n), self.length)
        self.skip = np.bincount(leaf[heavy], minlength=n)
        self.top = np.zeros((n, len(self.bias) - self.light), np.int8)
        self.top[leaf[heavy], self.path[heavy].astype(np.int64) - self.light] = self.turns[heavy]


class Window:
    """The network: embeddings of context words to the left and right, and units of the tree with their biases."""

    def __init__(self, tree: Tree, rows: dict[str, np.ndarray] | None = None, seed: int = 5):
        self.tree, self.edge = tree, len(tree.length)  # the edge, a context only, has the last row of both embeddings
        if rows is None:
            r, leaves = np.random.default_rng(seed), len(tree.length)
            rows = {s: np.append(r.normal(0, 0.3, (leaves, WIDTH)), np.zeros((1, WIDTH)), 0).astype(np.float32) for s in ("left", "right")}
            rows["unit"], rows["bias"] = np.zeros((len(tree.bias), WIDTH), np.float32), tree.bias[:, None].copy()
        self.rows = rows

    def layer(self, leaves: np.ndarray) -> np.ndarray:
        """The hidden layer at each place of a run of leaves; the edge stands SIDE times before, between and after texts."""
        return np.tanh(self._around(leaves) * np.float32((2 * SIDE) ** -0.5))

    def _around(self, leaves: np.ndarray) -> np.ndarray:
        """At each place of a run of leaves, the sum of the embeddings to its left and right."""
        x, y = self.rows["left"].take(leaves, 0), self.rows["right"].take(leaves, 0)
        h = np.zeros_like(x)
        for k in range(1, SIDE + 1):
            h[k:] += x[:-k]
            h[:-k] += y[k:]
        return h

    def _descend(self, leaves: np.ndarray):
        """For each depth: the first so many leaves that reach it, their units and turns. Leaves come by falling depth."""
        length = self.tree.length[leaves]
        reach = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        for j, m in enumerate(reach.tolist()):
            yield m, self.tree.node[j].take(leaves[:m]), self.tree.turn[j].take(leaves[:m])

    def _by_depth(self, leaves: np.ndarray) -> np.ndarray:
        return np.argsort((255 - np.minimum(self.tree.length[leaves], 255)).astype(np.uint8), kind="stable")

    def log_probability(self, h: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Of each leaf at its place."""
        out = np.empty(len(leaves), np.float32)
        unit, bias = self.rows["unit"], self.rows["bias"].ravel()
        for i in range(0, len(leaves), 4 * PLACES):
            order = self._by_depth(leaves[i : i + 4 * PLACES])
            some, wide = leaves[i : i + 4 * PLACES][order], h[i : i + 4 * PLACES].take(order, 0)
            total = np.zeros(len(some), np.float32)
            for m, node, turn in self._descend(some):
                z = _dots(unit.take(node, 0), wide[:m])
                z += bias.take(node)
                z *= turn  # minus log(1 + exp(-z)), of exponents below 0 alone
                total[:m] += np.minimum(z, 0)
                np.abs(z, out=z)
                np.negative(z, out=z)
                np.exp(z, out=z)
                z += 1
                total[:m] -= np.log(z, out=z)
            out[i + order] = total
        return out

    def plans(self, leaves: np.ndarray, batches: list[np.ndarray], seen: dict[str, np.ndarray]) -> list[dict]:
        """What steps on some batches of places need of leaves and paths, worked out for all these steps at once. seen: how often
        each row is changed; rows of the heaviest units are counted in the step."""
        tree, size = self.tree, np.array([len(x) for x in batches])
        of = np.repeat(np.arange(len(batches)), size)
        place = np.concatenate([np.sort(x) for x in batches]) + of * len(leaves)
        # the places and the words around them, in a row: places that lie together share most of these
        fresh = np.minimum(np.diff(place, prepend=-2 * SIDE), 2 * SIDE + 1)
        end = np.cumsum(fresh)
        at = ranges(place + SIDE + 1 - fresh, fresh)
        place, cut = end - 1 - SIDE, np.concatenate([[0], end[np.cumsum(size) - 1]])
        context = leaves.take(at % len(leaves))
        mine = np.zeros(len(at), np.int64)
        mine[place] = 1
        left, right = np.zeros_like(mine), np.zeros_like(mine)
        for k in range(1, SIDE + 1):
            left[:-k] += mine[k:]
            right[k:] += mine[:-k]
        word = context.take(place)
        place -= cut.take(of)
        contexts = _mentions(context, cut, left, right)
        # units of the paths beside the heaviest: the first of every path, then the second ones, and so on
        rest = tree.length.take(word) - tree.skip.take(word)
        deep = np.flatnonzero(rest)
        start = (tree.start + tree.skip).take(word.take(deep))
        order, node, path, ends, layers = _layers(of.take(deep), start, rest.take(deep), len(batches), 2 * LAYERS)
        deep = deep.take(order) - (np.cumsum(size) - size).take(of.take(deep.take(order)))
        deeps = np.cumsum([0, *(x[0][0] if x[0] else 0 for x in layers)])
        turn, node = tree.turns.take(node), tree.path.take(node)
        units = _mentions(node, ends)
        first, out = np.cumsum(size) - size, []
        for name, row, n in (("left", context, left), ("right", context, right), ("unit", node, None), ("bias", node, None)):
            seen[name] += np.bincount(row, n, len(seen[name]))
        for b, (i, n) in enumerate(zip(first.tolist(), size.tolist(), strict=True)):
            span = slice(ends[b], ends[b + 1])
            out.append({"context": context[cut[b] : cut[b + 1]], "place": place[i : i + n], "word": word[i : i + n], "contexts": contexts[b], "deep": deep[deeps[b] : deeps[b + 1]],
                        "path": path[span], "layers": layers[b], "node": node[span], "turn": turn[span], "units": units[b]})
        return out

    def step(self, leaves: np.ndarray, places: np.ndarray, seen: dict[str, np.ndarray], power: dict[str, np.ndarray], plan: dict | None = None) -> None:
        """One gradient step on the words at some places. seen: how often each row was changed; power: its squared slopes.
        plan: what plans() gives for these places, whose rows it has counted."""
        plan = plan or self.plans(leaves, [places], seen)[0]
        context, place, word, light = plan["context"], plan["place"], plan["word"], self.tree.light
        scale = np.float32((2 * SIDE) ** -0.5)
        h = np.tanh(self._around(context).take(place, 0) * scale)
        # the heaviest units of all places as matrices; a turn of 0 is a unit off the path
        turn = self.tree.top.take(word, 0).astype(np.float32)
        heavy = self.rows["unit"][light:]
        dz = h @ heavy.T
        dz += self.rows["bias"].ravel()[light:]
        dz *= turn
        np.exp(dz, out=dz)
        dz += 1
        np.divide(turn, dz, out=dz)
        ones = np.ones(len(h), np.float32)
        dh, to_unit, to_bias = dz @ heavy, dz.T @ h, (ones @ dz)[:, None]
        row, n = np.arange(light, light + len(heavy)), ones @ (turn * turn)
        for name in ("unit", "bias"):
            seen[name][light:] += n
        # all other units of all paths at once
        if len(plan["node"]):
            deep, path, node, turn = plan["deep"], plan["path"], plan["node"], plan["turn"]
            u, wide = self.rows["unit"].take(node, 0), h.take(deep.take(path), 0)
            z = _dots(u, wide)
            z += self.rows["bias"].ravel().take(node)
            z *= turn
            np.exp(z, out=z)
            z += 1
            dz = np.divide(turn, z, out=z)[:, None]
            u *= dz
            wide *= dz
            dh[deep] += _sums(u, plan["layers"])
            order, layers, more, (times,) = plan["units"]
            to_unit = np.concatenate([to_unit, _sums(wide.take(order, 0), layers)])
            to_bias = np.concatenate([to_bias, _sums(dz.take(order, 0), layers)])
            row, n = np.concatenate([row, more]), np.concatenate([n, times])
        # what a word's places say of it as a context
        dh *= 1 - h * h
        dh *= scale
        wide = np.zeros((len(context), WIDTH), np.float32)
        wide[place] = dh
        left, right = np.zeros_like(wide), np.zeros_like(wide)
        for k in range(1, SIDE + 1):
            left[:-k] += wide[k:]
            right[k:] += wide[:-k]
        order, layers, words, times = plan["contexts"]
        sides = [_sums(x.take(order, 0), layers) for x in (left, right)]
        self._move({"bias": row}, n, to_bias, power)
        self._move({"unit": row, "left": words, "right": words}, np.concatenate([n, *times]), np.concatenate([to_unit, *sides]), power)

    def _move(self, at: dict[str, np.ndarray], n: np.ndarray, g: np.ndarray, power: dict) -> None:
        """Change rows by the sums g of their n slopes; steps shrink with a row's squared slopes. Row numbers come table by table."""
        some = np.maximum(n, np.float32(1))  # a row without slopes stays as it is
        p = _dots(g, g)
        p /= some * np.float32(g.shape[1])
        i = 0
        for name, row in at.items():
            mine = p[i : i + len(row)]
            mine += power[name].take(row)
            power[name][row] = mine
            i += len(row)
        p += np.float32(1e-3)
        p *= some
        np.sqrt(p, out=p)
        g *= np.divide(np.float32(RATE), p, out=p)[:, None]
        i = 0
        for name, row in at.items():
            rows, mine = self.rows[name], g[i : i + len(row)]
            mine += rows.take(row, 0)
            whole = f"V{rows.itemsize * rows.shape[1]}"  # a row as one item is put in a third of the time
            np.put(rows.view(whole), row, mine.astype(rows.dtype, copy=False).view(whole))
            i += len(row)


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The product of each row of x with that of y."""
    return (x * y) @ np.ones(x.shape[1], x.dtype)


def _layers(batch: np.ndarray, first: np.ndarray, n: np.ndarray, batches: int, most: int) -> tuple:
    """Groups k of the numbers first[k], first[k] + 1, ..., n[k] of them, at least one; those of a batch lie together.

    Gives (an order of the groups within their batch, numbers, which group of its batch each is of, where each batch's numbers
    begin, layers of each batch). A batch's numbers begin with one of every group, then come second ones of the groups that have
    it, and so on `most` times, then all others group by group; layers tells how many each layer has, and where the others of
    each group begin."""
    key = batch * (most + 1) + np.maximum(most + 1 - n, 0)
    order = np.argsort(key.astype(np.uint16 if batches * (most + 1) < 1 << 16 else np.int64), kind="stable")
    batch, first, n = batch.take(order), first.take(order), n.take(order)
    sizes = np.bincount(batch * (most + 2) + np.minimum(n, most + 1), minlength=batches * (most + 2)).reshape(batches, -1)
    sizes = sizes[:, ::-1].cumsum(1)[:, ::-1][:, 1:]  # [b, k]: groups of batch b with over k numbers
    begin = np.cumsum(sizes[:, 0]) - sizes[:, 0]
    layered, sizes = sizes[:, :most], sizes.tolist()
    group = ranges(np.zeros(layered.size, np.int64), layered.ravel())
    numbers = first.take(group + np.repeat(begin, layered.sum(1))) + np.repeat(np.tile(np.arange(most), batches), layered.ravel())
    long = np.flatnonzero(n > most)
    more = n.take(long) - most
    tail = np.bincount(batch.take(long), more, batches).astype(np.int64)
    to, to_tail = (np.concatenate([[0], np.cumsum(x)]) for x in (layered.sum(1), tail))
    joined = lambda x, y: np.concatenate([part[i[b] : i[b + 1]] for b in range(batches) for part, i in ((x, to), (y, to_tail))])
    all_groups = joined(group, np.repeat(long - begin.take(batch.take(long)), more))
    all_numbers = joined(numbers, ranges(first.take(long) + most, more))
    starts, i, layers = np.cumsum(more) - more, 0, []
    for size in sizes:
        j = i + size.pop()
        layers.append(([m for m in size if m], starts[i:j] - (starts[i] if j > i else 0)))
        i = j
    return order, all_numbers, all_groups, to + to_tail, layers


def _mentions(row: np.ndarray, cut: np.ndarray, *times: np.ndarray) -> list[tuple]:
    """For each batch, from cut[b] to cut[b + 1]: (order, layers, the rows named, how often each is). The order puts mentions of
    rows into layers. times: what each mention counts, 1 if not given."""
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    row = row.astype(np.uint16)
    order = np.concatenate([np.argsort(row[i:j], kind="stable") + i for i, j in spans])
    at, fresh = row.take(order), np.ones(len(row), bool)
    fresh[1:] = at[1:] != at[:-1]
    fresh[cut[:-1][cut[:-1] < len(row)]] = True
    first = np.flatnonzero(fresh)
    n = np.diff(first, append=len(at))
    counts = [np.add.reduceat(x.take(order), first) if len(first) else n for x in times] or [n]
    groups, numbers, _, ends, layers = _layers(np.repeat(np.arange(len(spans)), np.diff(np.searchsorted(first, cut))), first, n, len(spans), LAYERS)
    rows, order = at.take(first.take(groups)).astype(np.int64), order.take(numbers)
    counts, out, g = [x.take(groups).astype(np.float32) for x in counts], [], 0
    for (i, j), (sizes, more) in zip(spans, layers, strict=True):
        h = g + (sizes[0] if sizes else 0)
        out.append((order[i:j] - i, (sizes, more), rows[g:h], [x[g:h] for x in counts]))
        g = h
    return out


def _sums(x: np.ndarray, layers: tuple[list[int], np.ndarray]) -> np.ndarray:
    """The sum of each group's rows, which lie in layers; in place."""
    sizes, more = layers
    out, at = x[: sizes[0]], sizes[0]
    for m in sizes[1:]:
        out[:m] += x[at : at + m]
        at += m
    if len(more):
        rest = x[at:]  # two columns add as one complex number, in half the time
        out[: len(more)] += np.add.reduceat(rest, more, axis=0) if x.shape[1] % 2 else np.add.reduceat(rest.view(np.complex64), more, axis=0).view(np.float32)
    return out


def padded(leaves: list[np.ndarray], edge: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaves of texts in a row with their edges, places of the words)."""
    n = np.array([len(x) for x in leaves])
    first = np.cumsum(n + SIDE) - n
    out = np.full(int((n + SIDE).sum()) + SIDE, edge, np.int64)
    places = ranges(first, n)
    out[places] = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
    return out, places


def _tails(word: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """For each row its distinct words and how often it has each."""
    order = np.lexsort((word, row))
    word, row = word[order], row[order]
    fresh = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])])) if len(word) else np.zeros(0, np.int64)
    times = np.diff(np.append(fresh, len(word)))
    each = pa.StructArray.from_arrays([pa.array(word[fresh], pa.int64()), pa.array(times, pa.int32())], ["word", "k"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[fresh], np.arange(rows + 1)), pa.int32()), each)


def _encode(head, own_leaves: int):
    """Rows (ref, n, leaves, tail): leaf numbers of each text's words, and those without a leaf of their own with their counts."""

    def run(batches):
        known = pd.Index(head.value)
        ref = TaskContext.get().partitionId() << 33
        for batch in batches:
            for word, bucket, first in words_of(batch.column(batch.num_columns - 1)):
                at = known.get_indexer(word)
                own = at >= 0
                leaves = np.where(own, at, own_leaves + bucket).astype("<u2")
                rows = len(first) - 1
                tail = _tails(word[~own], np.repeat(np.arange(rows), np.diff(first))[~own], rows)
                data = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((2 * first).astype(np.int32).tobytes()), pa.py_buffer(leaves.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(ref, ref + rows)), pa.array(np.diff(first).astype(np.int64)), data, tail], ["ref", "n", "leaves", "tail"])
                ref += rows

    return run


def _chunks(batches, column: int):
    """Lists of leaf arrays of whole texts, about PLACES * 16 words at a time, with the rows they come from."""
    for batch in batches:
        texts = [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column(column).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        for i, j in slices(offsets, PLACES * 16):
            yield batch, texts[i:j], i, j


def _train(model, turn: int, stride: int):
    """Rows of the network that a partition has changed: (name, row, seen, v), v being weighted by seen."""

    def run(batches):
        quiet_threads()
        tree, rows = model.value
        net = Window(tree, {k: v.copy() for k, v in rows.items()})
        seen = {k: np.zeros(len(v)) for k, v in rows.items()}
        power = {k: np.zeros(len(v), np.float32) for k, v in rows.items()}
        r = np.random.default_rng(turn)
        for _, texts, _, _ in _chunks(batches, 0):
            leaves, places = padded(texts, net.edge)
            runs = np.arange(0, len(places), RUN)
            runs = r.permutation(runs[turn % stride :: stride])
            for i in range(0, len(runs), BATCH // RUN * PLANNED):
                batches = []
                for k in range(i, min(i + BATCH // RUN * PLANNED, len(runs)), BATCH // RUN):
                    some = (runs[k : k + BATCH // RUN, None] + np.arange(RUN)).ravel()
                    batches.append(places[some[some < len(places)]])
                for some, plan in zip(batches, net.plans(leaves, batches, seen), strict=True):
                    net.step(leaves, some, seen, power, plan)
        for number, (name, v) in enumerate(sorted(net.rows.items())):
            at = np.flatnonzero(seen[name])
            w = seen[name][at]
            wide = np.zeros((len(at), WIDTH))
            wide[:, : v.shape[1]] = v[at] * w[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), pa.array(at), pa.array(w), *(pa.array(wide[:, k]) for k in range(WIDTH))], ["part", "row", "seen", *(f"v{k}" for k in range(WIDTH))])

    return run


def fit(encoded: DataFrame, tree: Tree, tasks: int, stride: int = STRIDE, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The network after some rounds over all texts; at most four rows a leaf reach the driver in a round."""
    spark = encoded.sparkSession
    net = Window(tree)
    values = [f"v{k}" for k in range(WIDTH)]
    for turn in range(rounds):
        model = spark.sparkContext.broadcast((tree, net.rows))
        changed = encoded.select("leaves").coalesce(tasks).mapInArrow(_train(model, turn * stride // rounds, stride), "part long, row long, seen double, " + ", ".join(f"{v} double" for v in values))
        with finished_shuffles_go(spark):
            summed = changed.groupBy("part", "row").agg(F.sum("seen").alias("seen"), *[F.sum(v).alias(v) for v in values]).toPandas()
        for number, name in enumerate(sorted(net.rows)):
            mine = summed[summed["part"] == number]
            at = mine["row"].to_numpy(np.int64)
            net.rows[name][at] = (mine[values].to_numpy() / mine[["seen"]].to_numpy())[:, : net.rows[name].shape[1]]
        net.rows["left"][net.edge] = net.rows["right"][net.edge] = 0
        model.unpersist()
    return net.rows


def _scores(model, inside):
    """(ref, n, likelihood): the network's part of each text's score."""

    def run(batches):
        quiet_threads()
        net, share = Window(*model.value), inside.value
        for batch, texts, i, j in _chunks(batches, 2):
            leaves, places = padded(texts, net.edge)
            word = leaves[places]
            each = net.log_probability(net.layer(leaves)[places], word) - share[word]
            first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            total = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(total[first[1:]] - total[first[:-1]])], ["ref", "n", "likelihood"])

    return run


def score_documents(docs: DataFrame, *, text_col: str = "text", carry: list[str] | None = None, head: int = HEAD, stride: int = STRIDE, rounds: int = ROUNDS) -> DataFrame:
    """The columns in carry (default: all), then n_words, log_likelihood, mean_log_likelihood and n_unseen.

    log_likelihood is the sum over a document's words of the logarithm of their probability with the word itself masked;
    n_unseen counts words that no other document holds. A null or empty text, or one without words, has n_words 0 and sums
    of 0. head: words with a leaf of their own; in each of `rounds` rounds, every stride-th run of places is learnt
    from. Equal texts score alike but for rounding; repeated rows count and are scored each, each being another document to
    the others. Input columns with these names are replaced; an empty table gives no rows.
    """
    spark, added = docs.sparkSession, ["n_words", "log_likelihood", "mean_log_likelihood", "n_unseen"]
    kept = [c for c in (docs.columns if carry is None else carry) if c not in added]
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    words = materialize(texts.mapInArrow(_count_words, "word long, bucket long, count long").groupBy("word", "bucket").agg(F.sum("count").alias("count")), "words")
    top = words.orderBy(F.desc("count"), "word").limit(head).toPandas().sort_values("word")
    known, own = top["word"].to_numpy(np.int64), top["count"].to_numpy(float)
    known_words = spark.sparkContext.broadcast(known)  # `head` words at most
    heads = spark.createDataFrame([(int(w),) for w in known], "word long")
    rest = words.join(F.broadcast(heads), "word", "left_anti")
    shared = rest.groupBy("bucket").agg(F.sum("count").alias("count")).toPandas()  # at most BUCKETS rows
    counts = np.zeros(head + BUCKETS)
    counts[: len(own)] = own
    counts[head + shared["bucket"].to_numpy(np.int64)] = shared["count"].to_numpy(float)

    # the texts' own columns lie beside their leaves, so that both are numbered alike
    names = {f"c{k}": c for k, c in enumerate(kept)}
    source = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in names.items()], F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = ", ".join([*(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in names.items()), "ref long, n long, leaves binary, tail array<struct<word:bigint,k:int>>"])
    encoded = materialize(source.mapInArrow(_with_carried(_encode(known_words, head), len(names)), schema), "leaves")

    tree = Tree(counts)
    n_words = encoded.agg(F.sum("n")).first()[0] or 0
    tasks = int(max(spark.sparkContext.defaultParallelism, n_words // (16 << 20)))
    rows = fit(encoded, tree, tasks, stride, rounds)
    model = spark.sparkContext.broadcast((tree, rows))  # fixed size, about 10 MB
    share = np.zeros(head + BUCKETS)
    share[head:] = np.log(np.maximum(counts[head:], 1))
    inside = spark.sparkContext.broadcast(share)
    part = encoded.select("ref", "n", "leaves").mapInArrow(_scores(model, inside), "ref long, n long, likelihood double")

    rare = encoded.select("ref", F.inline("tail"))
    left = F.greatest(F.col("count") - F.col("k"), F.lit(0))
    by_doc = rare.join(rest, "word").groupBy("ref").agg(F.sum(F.col("k") * F.log(left + UNSEEN)).alias("inside"), F.sum(F.when(left == 0, F.col("k")).otherwise(0)).alias("unseen"))
    scored = materialize(part.join(by_doc, "ref", "left").select("ref", "n", (F.col("likelihood") + F.coalesce("inside", F.lit(0.0))).alias("sum"), F.coalesce("unseen", F.lit(0)).alias("unseen")), "scores")
    discard(words)
    out = encoded.select("ref", *names).join(scored, "ref")
    mean = F.when(F.col("n") > 0, F.col("sum") / F.col("n")).otherwise(F.lit(0.0))
    return out.select(*[F.col(k).alias(c) for k, c in names.items()], F.col("n").alias("n_words"), F.col("sum").alias("log_likelihood"), mean.alias("mean_log_likelihood"), F.col("unseen").cast("long").alias("n_unseen"))


def _with_carried(encode, n: int):
    """encode() over the last column, beside the first n columns of the same rows."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def seen():
            for batch in batches:
                held.append(batch)
                yield batch

        at = 0
        for out in encode(seen()):
            if at == held[0].num_rows:
                held.pop(0)
                at = 0
            mine = held[0].slice(at, out.num_rows)
            at += out.num_rows
            yield pa.RecordBatch.from_arrays([*mine.columns[:n], *out.columns], [*mine.schema.names[:n], *out.schema.names])

    return run


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), carry=["doc_id"])


QUERIES = {"op6_pseudo_likelihood": op6_pseudo_likelihood}
ORACLE: dict[str, str] = {}
