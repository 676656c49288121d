"""Suffix arrays by induced sorting and their permuted common prefixes, for one shard of bytes in numpy.

A suffix is smaller (S) or larger (L) than the next one; leftmost S suffixes are sorted by their substrings, recursively
where these repeat (their names written in two digits), and all others are induced from them in one pass up and one down. A pass goes bucket by bucket: what
one bucket's suffixes induce into others is placed in one step, and what they induce into their own bucket is the next step,
so that a pass takes a few hundred steps. Where a text is short for its symbols, or one symbol runs long, it goes suffix by suffix.
"""

from __future__ import annotations

import math

import numpy as np

#: Fewer suffixes a symbol than this and a pass goes suffix by suffix.
DENSE = 128
#: So does it where one symbol stands so often in a row: each of these is a step of its bucket.
RUN = 4096
#: From so many names on the recursion writes each as two digits, so that its symbols are few.
MANY = 1 << 14


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last is larger than the empty suffix."""
    n = len(t)
    step = np.ones(n, np.int8)
    step[:-1] = (t[:-1] > t[1:]).astype(np.int8) - (t[:-1] < t[1:])
    decided = np.where(step != 0, np.arange(n), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    return step[decided] < 0


def _steps(t, smaller, seeds, start, n_large, out):
    """Both passes, bucket by bucket."""
    n, sigma = len(t), len(start)
    end = np.append(start[1:], n)
    ptr = start.copy()

    def scatter(found, to, sign):
        c = t[found]
        o = np.argsort(c, kind="stable")
        c, count = c[o], np.bincount(c, minlength=sigma)
        rank = np.arange(len(c)) - (np.cumsum(count) - count)[c]
        out[to[c] + rank if sign > 0 else to[c] - 1 - rank] = found[o]
        to += sign * count

    def induce(batch, to, sign, want):
        found = batch[batch > 0] - 1
        found = found[smaller[found] == want]
        if len(found):
            scatter(found, to, sign)

    out[ptr[t[n - 1]]] = n - 1
    ptr[t[n - 1]] += 1
    symbols = t[seeds]
    order = np.argsort(symbols, kind="stable")
    seeds, of = seeds[order], np.searchsorted(symbols[order], np.arange(sigma + 1))
    for c in range(sigma):
        at = start[c]
        while at < ptr[c]:
            at, before = int(ptr[c]), at
            induce(out[before:at], ptr, 1, False)
        if of[c] < of[c + 1]:
            induce(seeds[of[c] : of[c + 1]], ptr, 1, False)
    tail = end.copy()
    for c in range(sigma - 1, -1, -1):
        at = end[c]
        while tail[c] < at:
            at, before = int(tail[c]), at
            induce(out[at:before][::-1], tail, -1, True)
        if n_large[c]:
            induce(out[start[c] : start[c] + n_large[c]][::-1], tail, -1, True)


def _walk(t, smaller, seeds, start, out):
    """Both passes, suffix by suffix."""
    n = len(t)
    symbols, small, sa = t.tolist(), smaller.tolist(), [-1] * n
    end = np.append(start[1:], n).tolist()
    head, tail = start.tolist(), list(end)
    for p in reversed(seeds.tolist()):
        c = symbols[p]
        tail[c] -= 1
        sa[tail[c]] = p
    c = symbols[n - 1]
    sa[head[c]] = n - 1
    head[c] += 1
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not small[j]:
            c = symbols[j]
            sa[head[c]] = j
            head[c] += 1
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and small[j]:
            c = symbols[j]
            end[c] -= 1
            sa[end[c]] = j
    out[:] = sa


def _induced(t, smaller, seeds, sigma) -> np.ndarray:
    count = np.bincount(t, minlength=sigma)
    start, out = np.cumsum(count) - count, np.full(len(t), -1, np.int64)
    if sigma * DENSE <= len(t) and np.diff(np.flatnonzero(t[1:] != t[:-1]), prepend=-1, append=len(t) - 1).max() < RUN:
        _steps(t, smaller, seeds, start, count - np.bincount(t[smaller], minlength=sigma), out)
    else:
        _walk(t, smaller, seeds, start, out)
    return out


def _names(t, leftmost, order) -> tuple[np.ndarray, int]:
    """A name for each leftmost S place in text order, equal where substrings are equal, ascending as they are; and their number."""
    n, m = len(t), len(leftmost)
    length = np.empty(n, np.int64)
    length[leftmost[:-1]] = np.diff(leftmost) + 1
    length[leftmost[-1]] = -1  # it ends with the text, as no other does
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    pairs = np.flatnonzero(same)
    long = length[a[pairs]] > 64
    for k in pairs[long].tolist():
        x, y, w = int(a[k]), int(b[k]), int(length[a[k]])
        same[k] = np.array_equal(t[x : x + w], t[y : y + w])
    pairs, k = pairs[~long], 0
    while len(pairs):
        equal = t[a[pairs] + k] == t[b[pairs] + k]
        same[pairs[~equal]] = False
        k += 1
        pairs = pairs[equal]
        pairs = pairs[length[a[pairs]] > k]
    name = np.empty(n, np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~same)])
    return name[leftmost], m - int(same.sum())


def _recursion(names: np.ndarray, n_names: int, n: int) -> np.ndarray:
    """The suffix array of the names. Two digits a name keep the order of suffixes, where that still leaves a shorter text."""
    m = len(names)
    if m < MANY or 2 * m > 0.85 * n:
        return suffix_array(names, n_names)
    base = math.isqrt(n_names - 1) + 1
    digits = np.empty(2 * m, np.uint16 if base <= 1 << 16 else np.int64)
    digits[::2], digits[1::2] = np.divmod(names, base)
    out = suffix_array(digits, base)
    return out[out % 2 == 0] // 2


def suffix_array(t: np.ndarray, sigma: int = 256) -> np.ndarray:
    """The places of t's suffixes in ascending order, for integers from 0 to sigma - 1. Empty for an empty text."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    smaller = _types(t)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(leftmost) > 1:
        flag = np.zeros(n, bool)
        flag[leftmost] = True
        order = _induced(t, smaller, leftmost, sigma)
        names, n_names = _names(t, leftmost, order[flag[order]])
        if n_names == len(leftmost):
            sorted_ = np.empty(len(leftmost), np.int64)
            sorted_[names] = np.arange(len(leftmost))
        else:
            sorted_ = _recursion(names, n_names, n)
        leftmost = leftmost[sorted_]
    return _induced(t, smaller, leftmost, sigma)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of the bytes t, the length that its suffix has in common with the one before it in order.

    A place whose left neighbour goes on as well in the suffix before has one less than that neighbour; only the others are
    compared, eight bytes a step.
    """
    n = len(t)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    left = np.arange(n) - 1
    follows = np.zeros(n, bool)
    inner = (before > 0) & (left >= 0)
    follows[inner] = t[left[inner]] == t[before[inner] - 1]
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = t
    words = np.zeros(n + 8, np.uint64)
    for k in range(8):
        words |= padded[k : n + 8 + k].astype(np.uint64) << np.uint64(8 * k)
    place = np.flatnonzero(~follows & (before >= 0))
    other, most = before[place], n - np.maximum(place, before[place])
    active, at = np.arange(len(place)), 0
    length = np.zeros(len(place), np.int64)
    while len(active):
        if len(active) <= 8 and at:  # few and long: compare them in ever larger pieces
            for k in active.tolist():
                length[k] = at + _run(t, int(place[k]) + at, int(other[k]) + at)
            break
        differ = words[place[active] + at] ^ words[other[active] + at]
        same = differ == 0
        stop = active[~same]
        d = differ[~same]
        low = d & (~d + np.uint64(1))
        length[stop] = at + np.searchsorted(_BYTE_STARTS, low, "right") - 1
        at += 8
        active = active[same]
        over = most[active] <= at
        length[active[over]] = at
        active = active[~over]
    out[place] = np.minimum(length, most)
    known = np.where(follows, 0, np.arange(n))
    known = np.maximum.accumulate(known)
    return np.where(follows, out[known] - (np.arange(n) - known), out)


_BYTE_STARTS = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)


def _run(t: np.ndarray, a: int, b: int) -> int:
    got, size, n = 0, 64, len(t)
    while True:
        w = min(size, n - max(a, b) - got)
        if w <= 0:
            return got
        x = t[a + got : a + got + w] != t[b + got : b + got + w]
        if x.any():
            return got + int(x.argmax())
        got, size = got + w, min(size * 2, 1 << 20)
