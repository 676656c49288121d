"""Benchmark decontamination with an FM-index per training shard.

Test items become phrases of 13 words. A shard is some megabytes of documents inside one task. Its words are coded by the
phrases' vocabulary; a word that no phrase has ends a run, and runs shorter than the shortest phrase are left out, since
no phrase fits in them. Over the coded runs stands an FM-index: a suffix array, the Burrows-Wheeler transform in a wavelet
matrix for ranks, and suffix positions sampled at every eighth place and at each run's start. All phrases are searched
backwards together, occurrences are located by walking to a sampled position, and their word spans are merged.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import ALNUM, LOWER, annotate, slices, span_hashes, table, utf8_of, word_spans

PHRASE_WORDS = 13
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<start:int,end:int>>"


class FMIndex:
    """An FM-index over symbols 1..sigma; 0 separates runs and ends the text. Phrases hold no 0."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        text = np.append(np.asarray(text, np.int64), 0)
        self.n, self.text_sigma = len(text), int(text.max()) + 1
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.text_sigma))])
        self.levels = max(1, (self.text_sigma - 1).bit_length())
        # wavelet matrix: for each bit from the top, ones before each place, and the number of zeros
        self.ones, self.zeros = [], []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.bwt = bwt
        sampled = (sa % sample == 0) | (text[sa - 1] == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = sa[sampled]

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place of the transform."""
        low, at = np.zeros(len(symbol), np.int64), place.astype(np.int64)
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            ones, z = self.ones[k], self.zeros[k]
            a, b = ones[low], ones[at]
            low, at = np.where(one, z + a, low - a), np.where(one, z + b, at - b)
        return at - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open suffix ranges of the rows of a phrase matrix, by backward search over all rows at once."""
        m = len(phrases)
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        alive = np.flatnonzero((phrases < self.text_sigma).all(1))
        gone = np.ones(m, bool)
        gone[alive] = False
        low[gone] = high[gone] = 0
        for j in range(phrases.shape[1] - 1, -1, -1):
            if not len(alive):
                break
            c = phrases[alive, j]
            first = self.before[c]
            low[alive], high[alive] = first + self.rank(c, low[alive]), first + self.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        high = np.maximum(high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled row, then add the steps."""
        rows, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            at = rows[todo]
            done = self.sampled[at]
            out[todo[done]] = self.samples[self.sample_rank[at[done]]] + steps
            todo = todo[~done]
            if len(todo):
                at = rows[todo]
                c = self.bwt[at]
                rows[todo] = self.before[c] + self.rank(c, at)
            steps += 1
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; each 0 is smaller than all else and the later 0 the smaller, so runs end comparisons."""
    n = len(text)
    stop = text == 0
    zeros = int(stop.sum())
    rank = text + zeros
    rank[stop] = np.arange(zeros)[::-1]
    order = np.argsort(rank, kind="stable")
    first = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    width = 1
    while True:
        # only suffixes that still share their rank are sorted again
        size = np.diff(np.append(np.flatnonzero(first), n))
        tied = np.flatnonzero(np.repeat(size, size) > 1)
        if not len(tied):
            return order
        suffix = order[tied]
        nxt = rank[np.minimum(suffix + width, n - 1)]
        inner = np.lexsort((nxt, group[tied]))
        order[tied] = suffix[inner]
        nxt, g = nxt[inner], group[tied]
        fresh = np.concatenate([[True], (nxt[1:] != nxt[:-1]) | (g[1:] != g[:-1])])
        first[tied] = fresh
        group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[order[tied]] = group[tied]
        width *= 2


@dataclass
class PhraseBook:
    """Distinct phrases of one block of items, as codes of the block's own vocabulary."""

    vocabulary: np.ndarray  # sorted word hashes; the code of a word is its place plus 1
    near: np.ndarray  # flags by the low bits of a hash: may it be in the vocabulary?
    by_length: list[tuple[np.ndarray, np.ndarray]]  # (phrases of one length, their numbers)
    item_start: np.ndarray  # items of phrase p: items[item_start[p]:item_start[p + 1]]
    items: np.ndarray
    shortest: int


def phrase_book(items: list[tuple[object, str | None]], phrase_words: int = PHRASE_WORDS) -> PhraseBook | None:
    """Phrases of items: every run of phrase_words words; an item of fewer, but not none, is one phrase."""
    raw, offsets = utf8_of(pa.array([t for _, t in items], pa.string()))
    raw = LOWER[raw]
    start, end, first = word_spans(raw, offsets, ALNUM)
    if not len(start):
        return None
    vocabulary, code = np.unique(span_hashes(raw, start, end), return_inverse=True)
    code = code + 1
    phrases: dict[tuple, list[int]] = {}
    for i in range(len(items)):
        words = code[first[i] : first[i + 1]].tolist()
        for k in range(max(1, len(words) - phrase_words + 1) if words else 0):
            phrases.setdefault(tuple(words[k : k + phrase_words]), []).append(i)
    near = np.zeros(1 << 20, bool)
    near[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    lengths: dict[int, list] = {}
    for p, words in enumerate(phrases):
        lengths.setdefault(len(words), []).append((words, p))
    owners = [sorted(set(v)) for v in phrases.values()]
    return PhraseBook(
        vocabulary,
        near,
        [(np.array([w for w, _ in v], np.int64), np.array([p for _, p in v])) for v in lengths.values()],
        np.concatenate([[0], np.cumsum([len(o) for o in owners])]),
        np.concatenate([np.array(o) for o in owners]),
        min(lengths),
    )


def find_phrases(book: PhraseBook, raw: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in a shard's words: (first word, word count, phrase number)."""
    none = (np.zeros(0, np.int64),) * 3
    hashes = span_hashes(raw, start, end)
    place = np.flatnonzero(book.near[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
    if not len(place):
        return none
    found = np.minimum(np.searchsorted(book.vocabulary, hashes[place]), len(book.vocabulary) - 1)
    known = book.vocabulary[found] == hashes[place]
    place, codes = place[known], found[known] + 1
    if not len(place):
        return none
    row = np.searchsorted(first, place, "right")
    fresh = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (row[1:] != row[:-1])])
    run = np.cumsum(fresh) - 1
    keep = np.bincount(run)[run] >= book.shortest
    place, codes, run = place[keep], codes[keep], run[keep]
    if not len(place):
        return none
    gap = np.concatenate([[0], np.cumsum(run[1:] != run[:-1])])  # a 0 between runs
    text = np.zeros(len(place) + gap[-1], np.int64)
    at = np.arange(len(place)) + gap
    text[at] = codes
    word = np.zeros(len(text), np.int64)
    word[at] = place
    index = FMIndex(text)
    out = []
    for phrases, numbers in book.by_length:
        low, high = index.search(phrases)
        hit = np.flatnonzero(high > low)
        if len(hit):
            count = high[hit] - low[hit]
            rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            position = index.locate(rows)
            out.append((word[position], np.full(len(position), phrases.shape[1]), np.repeat(numbers[hit], count)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none


def _searcher(blocks):
    """blocks: broadcast pairs of item ids and texts, searched one after the other over each shard."""

    def compute(texts: pa.Array):
        whole, offsets = utf8_of(texts)
        cols: list[list] = [[] for _ in range(7)]
        for i, j in slices(offsets, SHARD_BYTES):
            raw = LOWER[whole[offsets[i] : offsets[j]]]
            start, end, first = word_spans(raw, offsets[i : j + 1] - offsets[i], ALNUM)
            delta = np.zeros(len(start) + 1, np.int64)
            owned: dict[int, set[str]] = {}
            for block in blocks:
                ids, book = _book(block)
                if book is None:
                    continue
                word, count, phrase = find_phrases(book, raw, start, end, first)
                np.add.at(delta, word, 1)
                np.add.at(delta, word + count, -1)
                for r, p in np.unique(np.stack([np.searchsorted(first, word, "right") - 1, phrase]), axis=1).T.tolist():
                    owned.setdefault(r, set()).update(ids[k] for k in book.items[book.item_start[p] : book.item_start[p + 1]])
            hit = np.cumsum(delta)[:-1] > 0
            before = np.concatenate([[0], np.cumsum(hit)])
            n_words, n_hit = np.diff(first), before[first[1:]] - before[first[:-1]]
            cols[0] += n_words.tolist()
            cols[1] += n_hit.tolist()
            for r in range(j - i):
                items = sorted(owned.get(r, ()))
                cols[2].append(len(items))
                cols[3].append(hashlib.sha256(",".join(items).encode()).hexdigest())
                cols[4].append(bool(n_hit[r] and 20 * n_hit[r] >= n_words[r]))
                cols[5].append(items)
                cols[6].append(_spans(hit, start, end, int(first[r]), int(first[r + 1]), int(offsets[i + r] - offsets[i])) if n_hit[r] else [])
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), span]
        return [pa.array(c, t) for c, t in zip(cols, types, strict=True)]

    return compute


def _spans(hit, start, end, a: int, b: int, base: int) -> list[dict]:
    """Merged spans of hit words of one row, in UTF-8 bytes of its text."""
    step = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
    return [{"start": int(start[a + x]) - base, "end": int(end[a + y - 1]) - base} for x, y in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)]


_books: dict[str, tuple[list[str], PhraseBook | None]] = {}


def _book(block):
    if block.id not in _books:
        items = block.broadcast.value
        if len(_books) > 8:
            _books.clear()
        _books[block.id] = [str(i) for i, _ in items], phrase_book(items)
    return _books[block.id]


@dataclass
class _Block:
    id: str
    broadcast: object


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[_Block]:
    """The items in broadcasts of at most BLOCK_BYTES of text each (one item more, if a single text is longer)."""
    sc, out, held, size = benchmark.sparkSession.sparkContext, [], [], 0

    def close():
        nonlocal held, size
        b = sc.broadcast(held)
        out.append(_Block(uuid.uuid4().hex, b))
        held, size = [], 0

    for r in benchmark.select(F.col(f"`{item_col}`"), F.col(f"`{text_col}`")).filter(F.col(f"`{item_col}`").isNotNull()).toLocalIterator():
        n = len((r[1] or "").encode())
        if held and size + n > BLOCK_BYTES:
            close()
        held.append((r[0], r[1]))
        size += n
    if held:
        close()
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", carry: list[str] | None = None, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Append RESULT to each document: words, hit words, items that occur, their digest, the verdict, and removal spans.

    contaminated: n_hit > 0 and 20 * n_hit >= n_words. A null or empty text has no words and no hits; so does every text
    where the benchmark is empty. Items with a null id are ignored, and so are null texts of items. Repeated rows, of
    documents or of items, are each judged; item ids are counted once. spans are merged and in UTF-8 bytes. Input columns
    with the names of RESULT are replaced. The benchmark is a stated query set, held against all documents in blocks of
    bounded size.
    """
    return annotate(docs, _searcher(_blocks(benchmark, item_col, item_text_col)), RESULT, text_col=text_col, carry=carry)


def op1_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES = {"op1_fm_decontamination": op1_fm_decontamination}
ORACLE = {
    "op1_fm_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 12], ' ') AS phrase, least(len(w), 13) AS n FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k)),
h AS (SELECT g.doc_id, g.k, g.n, p.item_id FROM g JOIN p ON g.phrase = p.phrase AND g.n = p.n),
c AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT doc_id, k, n FROM h), LATERAL (SELECT unnest(range(0, n)) AS j) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
 coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
}
