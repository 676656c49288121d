"""Alignment of two tokenizers over whole texts, by products of sparse incidence matrices.

A matrix tells which bytes each token covers, another which group of tokens it is in; they are held as compressed rows and
multiplied row by row (Gustavson): row i of A·B' is the sum of the rows of B' that row i of A names. The product over bytes
has an entry for each pair of tokens that overlap, the product over groups one for each pair that shares a group.

A task takes texts in chunks. It keeps the pairs of ids that a chunk links once, with the number of documents that hold
each, and for every document the places of its pairs in that list; so what is counted over the corpus, and what comes back,
is one row for each pair and chunk, not for each pair and document.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import give_back, materialize, quiet_threads, ranges, slices, table, utf8_of
from kelpie.llm.tokens import vocabulary_path

A_FILE, A_RANKS, B_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
CHUNK_BYTES = 1 << 20
#: Bytes of a text that go to the second tokenizer at once; a longer one is cut before blanks.
LONG = 1 << 20
#: Entries that one step of a product expands.
STEP = 1 << 18
#: A pair of ids is one number: the first id's bits above these.
B_BITS = 15
#: All bytes of characters below U+0200 are less than this one. Unicode has always classed those characters as it does now.
PLAIN = 0xC8


# --- compressed sparse rows ----------------------------------------------------------------------------------------


class Csr:
    """A sparse matrix of whole numbers by compressed rows."""

    def __init__(self, start: np.ndarray, column: np.ndarray, value: np.ndarray, columns: int):
        self.start, self.column, self.value, self.columns = start, column, value, columns

    @property
    def rows(self) -> int:
        return len(self.start) - 1

    def transposed(self) -> Csr:
        order = np.argsort(self.column, kind="stable") if np.any(self.column[1:] < self.column[:-1]) else slice(None)
        row = np.repeat(np.arange(self.rows), np.diff(self.start))
        count = np.bincount(self.column, minlength=self.columns)
        return Csr(np.concatenate([[0], np.cumsum(count)]), row[order], self.value[order], self.rows)

    def product_sizes(self, other: Csr) -> np.ndarray:
        """Terms that each row of the product sums up."""
        terms = np.concatenate([[0], np.cumsum(np.diff(other.start)[self.column])])
        return terms[self.start[1:]] - terms[self.start[:-1]]

    def product(self, other: Csr):
        """(row, column, value) of self times other, some rows at a time, in order of rows and columns."""
        total = np.concatenate([[0], np.cumsum(self.product_sizes(other))])
        for i, j in slices(total, STEP):
            at = slice(self.start[i], self.start[j])
            inner = self.column[at]
            count = np.diff(other.start)[inner]
            take = ranges(other.start[inner], count)
            row = np.repeat(np.repeat(np.arange(i, j), np.diff(self.start[i : j + 1])), count)
            column, value = other.column[take], np.repeat(self.value[at], count) * other.value[take]
            key = row * other.columns + column
            if np.any(key[1:] < key[:-1]):
                order = np.argsort(key, kind="stable")
                row, column, value, key = row[order], column[order], value[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            yield row[first], column[first], np.add.reduceat(value, first) if len(first) else value


def byte_incidence(length: np.ndarray) -> Csr:
    """Tokens that follow each other, over bytes."""
    end = np.cumsum(length)
    n = int(end[-1]) if len(end) else 0
    return Csr(np.concatenate([[0], end]), np.arange(n), np.ones(n, np.int64), n)


def group_incidence(group: np.ndarray, groups: int) -> Csr:
    """Tokens over groups: each is in one."""
    return Csr(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), groups)


# --- the two tokenizers --------------------------------------------------------------------------------------------


class Tokenizers:
    """Ids of both for whole texts, and the bytes of every id."""

    def __init__(self, folder=vocabulary_path):
        quiet_threads()
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(folder(A_RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(folder(A_FILE))
        self.whole.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=folder(B_FILE))
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}
        entries = [self.whole.id_to_token(k) or "" for k in range(self.whole.get_vocab_size())]
        self.a_bytes = _Bytes([bytes(byte_of[c] for c in e) for e in entries])
        self.b_bytes = _Bytes([bytes([int(p[3:5], 16)]) if self.pieces.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, self.pieces.id_to_piece(k)) for k in range(self.pieces.get_piece_size()))])
        # characters that Unicode classes otherwise today than long ago go through the vocabulary file's own library
        self.odd = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _odd_ranges()) + "]")

    def a(self, text: str, data: np.ndarray) -> list[int]:
        """Ids of a blank and text; data are the bytes of both."""
        if data.max() < PLAIN or not self.odd.search("".join(set(text))):
            return self.fast.encode_ordinary(" " + text)
        return self.whole.encode(" " + text, add_special_tokens=False).ids

    def b(self, texts: list[str]) -> list[list[int]]:
        if max(map(len, texts), default=0) <= LONG:
            return self.pieces.encode(texts, num_threads=1)
        return [list(chain.from_iterable(self.pieces.encode(_cut(t), num_threads=1))) for t in texts]


#: A single blank between other characters.
_GAP = regex.compile(r"(?<=[^ \u2581]) (?=[^ \u2581])")


def _cut(text: str) -> list[str]:
    """text in parts of about LONG, cut at single blanks: no piece goes on over one, and the tokenizer puts it back itself."""
    parts, at = [], 0
    while gap := _GAP.search(text, at + LONG):
        parts.append(text[at : gap.start()])
        at = gap.end()
    return [*parts, text[at:]]


def _odd_ranges() -> list[tuple[int, int]]:
    """Characters that were not yet, or are no longer, letters, numbers or blanks as they are today."""

    def kind(category: str) -> str:
        return category if category in ("Cn", "Co") else category[0] if category[0] in "LNZ" else ""

    out: list[tuple[int, int]] = []
    for k in range(0x200, 0x110000):
        was, now = (kind(u.category(chr(k))) for u in (unicodedata.ucd_3_2_0, unicodedata))
        if was == "Cn" or was != now:
            if out and out[-1][1] == k - 1:
                out[-1] = (out[-1][0], k)
            else:
                out.append((k, k))
    return out


class _Bytes:
    def __init__(self, entries: list[bytes]):
        self.length = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.start[ids], self.length[ids])]


_tokenizers: list[Tokenizers] = []


def tokenizers() -> Tokenizers:
    if not _tokenizers:
        _tokenizers.append(Tokenizers())
    return _tokenizers[0]


# --- a chunk of texts ----------------------------------------------------------------------------------------------


class Aligned:
    """The alignment of some texts, one after the other: tokens, groups and links, and where each text's begin."""

    def __init__(self, texts: list[str]):
        t = tokenizers()
        usable = [bool(x) for x in texts]
        data = [np.frombuffer(b" " + x.encode(), np.uint8) for x in texts]
        a = [t.a(x, d) if u else [] for x, d, u in zip(texts, data, usable, strict=True)]
        b = iter(t.b([x for x in texts if x]))
        b = [next(b) if u else [] for u in usable]
        for k, d in enumerate(data):
            if usable[k] and not all(np.array_equal(v.joined(np.array(ids, np.int64)), d) for v, ids in ((t.a_bytes, a[k]), (t.b_bytes, b[k]))):
                a[k], b[k] = [], []
        self.a_first, self.b_first = (np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64) for ids in (a, b))
        self.a, self.b = (np.fromiter(chain.from_iterable(ids), np.int64, int(first[-1])) for ids, first in ((a, self.a_first), (b, self.b_first)))
        a_length, b_length = t.a_bytes.length[self.a], t.b_bytes.length[self.b]
        a_end, b_end = np.cumsum(a_length), np.cumsum(b_length)
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        self.groups = len(ends)
        self.a_group, self.b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        text_end = np.concatenate([[0], a_end])[self.a_first]
        self.group_first = np.searchsorted(ends, text_end, "right")
        self.a_bytes_of, self.b_bytes_of = byte_incidence(a_length), byte_incidence(b_length)

    def links(self):
        """(A token, B token, common bytes) of every overlap, in parts."""
        yield from self.a_bytes_of.product(self.b_bytes_of.transposed())

    def _by_group(self) -> tuple[Csr, Csr]:
        return group_incidence(self.a_group, self.groups), group_incidence(self.b_group, self.groups).transposed()

    def shared(self):
        """(A token, B token, 1) of every pair in one group, in parts."""
        a, b = self._by_group()
        yield from a.product(b)

    def shared_sizes(self) -> np.ndarray:
        a, b = self._by_group()
        return a.product_sizes(b)

    def group_texts(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text: decimal ids by group."""

        def last(group):
            return np.append(group[1:] != group[:-1], True)[: len(group)].astype(np.int64)

        parts = np.concatenate([self.a + _A_IDS * last(self.a_group), self.b + 2 * _A_IDS + _B_IDS * last(self.b_group)])
        order = np.argsort(np.concatenate([2 * self.a_group, 2 * self.b_group + 1]), kind="stable")
        words = list(map(_written().__getitem__, parts[order].tolist()))
        return ["".join(words[i:j])[:-1] for i, j in zip((self.a_first + self.b_first)[:-1].tolist(), (self.a_first + self.b_first)[1:].tolist(), strict=True)]


_A_IDS, _B_IDS = 1 << 16, 1 << B_BITS
_words: list[str] = []


def _written() -> list[str]:
    """Each id with the sign that follows it: in a group and at its end, for either tokenizer."""
    if not _words:
        _words.extend(f"{k}{sign}" for n, signs in ((_A_IDS, ",|"), (_B_IDS, ",;")) for sign in signs for k in range(n))
    return _words


def _texts(column: pa.Array):
    """(first, texts) of a column in chunks of about CHUNK_BYTES."""
    _, off = utf8_of(column)
    for i, j in slices(off, CHUNK_BYTES):
        yield i, column.slice(i, j - i).fill_null("").to_pylist()


_CHUNKS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, chunk long, places array<int>, times array<int>, pairs array<long>, holders array<int>"


def _lists(values: np.ndarray, first: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def _chunks(batches):
    """Every document's figures and the places of its pairs; a chunk's first row has the pairs and their numbers of holders."""
    chunk = TaskContext.get().partitionId() << 40
    for batch in batches:
        for i, texts in _texts(batch.column(1)):
            x, n = Aligned(texts), len(texts)
            parts = [(row, (x.a[row] << B_BITS) | x.b[column]) for row, column, _ in x.links()] or [(np.zeros(0, np.int64),) * 2]
            row, pair = (np.concatenate(p) for p in zip(*parts, strict=True))
            pairs, place = np.unique(pair, return_inverse=True)
            text = np.searchsorted(x.a_first, row, "right") - 1
            held, times = np.unique(text * max(1, len(pairs)) + place, return_counts=True)
            of, place = np.divmod(held, max(1, len(pairs)))
            first = np.searchsorted(of, np.arange(n + 1))
            shared = np.concatenate([[0], np.cumsum(x.shared_sizes())])[x.a_first]
            once = [len(pairs)] + [0] * (n - 1)
            once = np.concatenate([[0], np.cumsum(once)])
            valid = pa.array([k > 0 for k in range(n)])  # null but in the first row
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, n),
                    *(pa.array(np.diff(v), pa.int64()) for v in (x.a_first, x.b_first, x.group_first)),
                    pa.array(np.bincount(text, minlength=n), pa.int64()),
                    pa.array(np.diff(shared), pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in x.group_texts()]),
                    pa.array([chunk] * n, pa.int64()),
                    _lists(place.astype(np.int32), first, pa.int32()),
                    _lists(times.astype(np.int32), first, pa.int32()),
                    _only_first(pairs, valid, pa.int64()),
                    _only_first(np.bincount(place, minlength=len(pairs)).astype(np.int32), valid, pa.int32()),
                ],
                [f.split(" ")[0] for f in _CHUNKS.split(", ")],
            )
            chunk += 1
    give_back()


def _only_first(values: np.ndarray, null: pa.Array, kind) -> pa.Array:
    n = len(null)
    offsets = pa.array([0] + [len(values)] * n, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind), mask=null)


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_shared long"


def _counted(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's documents with the sums over their links of what the corpus counts for each pair."""
    place = counts["place"].to_numpy()
    total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    total[place], best[place] = counts["total"].to_numpy(), counts["best"].to_numpy(zero_copy_only=False)
    documents = documents.combine_chunks()
    columns = {c: documents[c].combine_chunks() for c in ("places", "times")}
    places, times = (c.flatten().to_numpy(zero_copy_only=False) for c in columns.values())
    count = np.diff(np.concatenate([[0], np.cumsum(columns["places"].value_lengths().to_numpy(zero_copy_only=False))]))
    end = np.cumsum(count)

    def summed(v):
        sums = np.concatenate([[0], np.cumsum(v[places] * times)])
        return pa.array(sums[end] - sums[end - count], pa.int64())

    out = {f: documents[f] for f in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    out |= {"n_best": summed(best), "count_sum": summed(total), "groups_sha256": documents["groups_sha256"], "n_shared": documents["n_shared"]}
    return pa.table(out)


def align(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared.

    n_a and n_b are tokens; groups end where tokens of both end; n_links are pairs of tokens that overlap, n_shared those that
    share a group. Of a pair of ids, the corpus counts the documents that link it: count_sum adds this up over links, n_best
    counts the links whose pair has the highest count of its first id, ties included. Null and empty texts, and those that
    the tokenizers do not give back byte for byte, have no tokens: zeros and an empty digest. Rows that repeat count each;
    other columns are ignored whatever their names; an empty table gives no rows.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    chunks = materialize(slim.mapInArrow(_chunks, _CHUNKS), "aligned-chunks")
    first = chunks.filter(F.col("pairs").isNotNull()).select(F.col("chunk").alias("part"), F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "of"))
    linked = first.select("part", "place", F.col("of.pairs").alias("pair"), F.col("of.holders").alias("holders"))
    totals = materialize(linked.groupBy("pair").agg(F.sum("holders").alias("total")), "pair-totals")
    a_id = F.shiftright("pair", B_BITS)
    highest = totals.groupBy(a_id.alias("a")).agg(F.max("total").alias("highest"))  # a row for each id of the first vocabulary
    totals = totals.join(F.broadcast(highest), a_id == F.col("a")).select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    counts = linked.select("part", "place", "pair").join(totals, "pair").select("part", "place", "total", "best")
    figures = chunks.drop("pairs", "holders")
    return figures.groupBy("chunk").cogroup(counts.groupBy("part")).applyInArrow(_counted, _RESULT)


def token_links(docs: DataFrame, *, kind: str = "bytes", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The links themselves: doc_id, a (place of the token), a_id, b, b_id, common; kind is `bytes` or `group`.

    common is the number of bytes both tokens cover, or 1 for tokens of one group. Rows of no tokens give none.
    """

    def run(batches):
        for batch in batches:
            for i, texts in _texts(batch.column(1)):
                x, ids = Aligned(texts), batch.column(0).slice(i, len(texts))
                for a, b, common in x.links() if kind == "bytes" else x.shared():
                    text = np.searchsorted(x.a_first, a, "right") - 1
                    columns = [ids.take(pa.array(text)), *map(pa.array, (a - x.a_first[text], x.a[a], b - x.b_first[text], x.b[b], common))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a", "a_id", "b", "b_id", "common"])

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, a long, a_id long, b long, b_id long, common long")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLE: dict[str, str] = {}
