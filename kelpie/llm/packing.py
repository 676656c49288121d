"""Retrieval packing: a sharded BM25 index returns unused neighbours of each seed document, which fill its window.

Every document is encoded once. Document frequencies, the number of documents and their mean length are counted over the
whole table. A document goes to the shard of its strongest term, the one of the largest BM25 weight by those counts, so
documents that share what tells them from the rest meet, wherever they lay in the input. A term of many documents has
several shards, dealt by a hash; terms of few share one. A shard of about SHARD_TOKENS ids has its own inverted index with
corpus-wide weights. A seed opens a window; its unused neighbours follow by BM25 over all its distinct terms; without any
left, the next unused document follows. A document that crosses the end of a window is cut there and its rest seeds the
next window, so every full window holds exactly `window` ids. What remains at a shard's end is cut at powers of two,
largest first, so that no padding is needed there either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import crc32, give_back, materialize, mix64, quiet_threads, ranges, table
from kelpie.llm.tokens import END_ID, encoder, vocabulary_path

WINDOW = 4096
SHARD_TOKENS = 1 << 18
SHARD_DOCS = 1 << 12
SHARDS_A_TASK = 256
K1, B = 1.2, 0.75
ENCODED = "doc_id long, ids binary, n long, place long, term long, count long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)


def length_norms(docs: list[np.ndarray], mean: float) -> np.ndarray:
    """What a document's length adds below the line of BM25."""
    return (K1 * (1 - B + B * np.array([len(d) for d in docs], np.float64) / max(mean, 1e-9))).astype(np.float32)


def bm25(weight: np.ndarray, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term of `weight` (idf) that occurs tf times adds to the score of a document with that norm."""
    return weight * tf * np.float32(K1 + 1) / (tf + norm)


def term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences), ordered by document and term."""
    lengths = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    bits, kind = (16, np.uint32) if len(docs) <= 1 << 16 and (not len(ids) or ids.max() < 1 << 16) else (32, np.uint64)
    key = np.repeat(np.arange(len(docs), dtype=kind) << kind(bits), lengths)
    key |= ids.astype(kind)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    found = key[first]
    return (found >> kind(bits)).astype(np.int64), (found & kind((1 << bits) - 1)).astype(np.int64), np.diff(np.append(first, len(key))).astype(np.float32)


class Bm25Index:
    """An inverted index over token-id arrays. weight: idf by term over the whole corpus; mean: its mean length."""

    def __init__(self, docs: list[np.ndarray], weight: np.ndarray, mean: float):
        self.n = len(docs)
        doc, term, tf = term_counts(docs)
        w = bm25(weight.take(term), tf, length_norms(docs, mean).take(doc))
        self.doc_start = np.searchsorted(doc, np.arange(self.n + 1))
        present = np.unique(term)
        self.terms = np.searchsorted(present, term)  # of each document in turn, numbered inside the shard
        order = np.argsort(self.terms, kind="stable")
        self.doc, self.weight = doc[order], w[order].astype(np.float64)
        self.start = np.searchsorted(self.terms[order], np.arange(len(present) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all distinct terms of the seed."""
        mine = self.terms[self.doc_start[seed] : self.doc_start[seed + 1]]
        at = ranges(self.start[mine], self.start[mine + 1] - self.start[mine])
        return np.bincount(self.doc.take(at), self.weight.take(at), self.n)


def fill_windows(docs: list[np.ndarray], weight: np.ndarray, mean: float, window: int = WINDOW):
    """Pieces (document, start, length, sequence, offset) of one shard; sequences count from 0."""
    index, unused = Bm25Index(docs, weight, mean), np.ones(len(docs), bool)
    sequence, offset, nxt = 0, 0, 0
    queue: list[int] = []
    pieces: list[list[int]] = []
    total = sum(len(d) for d in docs)
    ends, left = [window] * (total // window), total % window
    while left:
        ends.append(1 << (left.bit_length() - 1))
        left -= ends[-1]
    for _ in range(len(docs)):
        while queue and not unused[queue[-1]]:
            queue.pop()
        if queue:
            doc = queue.pop()
        else:
            while not unused[nxt]:
                nxt += 1
            doc = nxt
        unused[doc] = False
        at, n, opened = 0, len(docs[doc]), offset == 0
        while at < n:
            take = min(n - at, ends[sequence] - offset)
            pieces.append([doc, at, take, sequence, offset])
            at, offset = at + take, offset + take
            if offset == ends[sequence]:
                sequence, offset, opened = sequence + 1, 0, True
        if opened and offset:  # this document seeds the open window
            score = np.where(unused, index.scores(doc), 0)[::-1]
            order = np.argsort(score, kind="stable")  # best last; ties to the earlier document
            queue = (len(docs) - 1 - order[np.searchsorted(score[order], 0, "right") :]).tolist()
    return pieces, sequence + (offset > 0)


def _width(path: str) -> str:
    """The type that holds the vocabulary's ids, as stored."""
    return "<u2" if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _encode(path: str, end_id: int):
    """Rows of documents (doc_id, ids, n, place) and, at the end of a partition, document frequencies (term, count)."""

    def run(batches):
        enc, tail, kind = encoder(path), end_id.to_bytes(4, "little"), _width(path)
        place, df = TaskContext.get().partitionId() << 33, np.zeros(0, np.int64)
        names = ["doc_id", "ids", "n", "place", "term", "count"]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                docs = [np.frombuffer(enc.encode(t) + tail, "<u4") for t in some.column(1).to_pylist()]
                _, term, _ = term_counts(docs)
                more = np.bincount(term, minlength=len(df))
                more[: len(df)] += df
                df, rows = more, len(docs)
                none = pa.nulls(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([d.astype(kind).tobytes() for d in docs], pa.binary()), pa.array([len(d) for d in docs], pa.int64()), pa.array(np.arange(place, place + rows)), none, none], names)
                place += rows
        term = np.flatnonzero(df)
        give_back()
        none = pa.nulls(len(term), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(len(term), pa.binary()), none, none, pa.array(term), pa.array(df[term])], names)

    return run


def strongest(docs: list[np.ndarray], weight: np.ndarray, mean: float) -> np.ndarray:
    """The term of the largest BM25 weight of each document, ties to the lower id; no document is empty."""
    doc, term, tf = term_counts(docs)
    if not len(doc):
        return np.zeros(0, np.int64)
    w = bm25(weight.take(term), tf, length_norms(docs, mean).take(doc))
    first = np.searchsorted(doc, np.arange(len(docs)))
    top = np.maximum.reduceat(w, first)
    best = np.flatnonzero(w == top.take(doc))  # terms stand in order, so the first of equals has the lowest id
    return term[best[np.concatenate([[True], doc[best][1:] != doc[best][:-1]])]]


def _terms(path: str, corpus):
    """(term, n) of each stored document."""

    def run(batches):
        kind = _width(path)
        weight, mean = corpus.value
        for batch in batches:
            docs = [np.frombuffer(d, kind) for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(strongest(docs, weight, mean), pa.int64()), pa.array([len(d) for d in docs], pa.int64())], ["term", "n"])

    return run


def _route(path: str, corpus, plan):
    """Stored documents (doc_id, ids, place) with their term and shard."""

    def run(batches):
        kind = _width(path)
        (weight, mean), (first, count) = corpus.value, plan.value
        for batch in batches:
            term = strongest([np.frombuffer(d, kind) for d in batch.column(1).to_pylist()], weight, mean)
            place = batch.column(2).to_numpy()
            shard = first[term] + (mix64(place.astype(np.uint64)) % count[term].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(term, pa.int64()), pa.array(shard, pa.int64())], [*batch.schema.names, "term", "shard"])

    return run


def shard_plan(rows: list[tuple[int, int, int]], size: int, shard_tokens: int, shard_docs: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first shard of each term, its number of shards, shards in all) from (term, documents, tokens); size: terms there are."""
    first, count = np.zeros(size, np.int64), np.ones(size, np.int64)
    shard, filled = 0, 0.0
    for term, docs, tokens in sorted(rows):
        share = max(docs / shard_docs, tokens / shard_tokens)
        if share >= 1:
            shard, filled = shard + (filled > 0), 0.0
            first[term], count[term] = shard, int(-(-share // 1))
            shard += count[term]
            continue
        if filled and filled + share > 1:
            shard, filled = shard + 1, 0.0
        first[term] = shard
        filled += share
    return first, count, int(shard + (filled > 0))


def _pack(path: str, window: int, corpus):
    """Pieces of documents that come ordered by shard; one shard is held at a time."""

    def run(batches):
        quiet_threads()
        kind = _width(path)
        weight, mean = corpus.value
        ids, docs, shard = [], [], None

        def flush():
            pieces, _ = fill_windows(docs, weight, mean, window)
            cols = list(zip(*pieces, strict=True)) if pieces else [[]] * 5
            crcs = [crc32(docs[d][a : a + k].astype("<u4")) for d, a, k, _, _ in pieces]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[d] for d in cols[0]], pa.int64()),
                    pa.array(cols[1], pa.int64()),
                    pa.array(cols[2], pa.int64()),
                    pa.array(crcs, pa.int64()),
                    pa.array([len(docs[d]) for d in cols[0]], pa.int64()),
                    pa.array([(shard << 32) + s for s in cols[3]], pa.int64()),
                    pa.array(cols[4], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            for doc_id, data, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at != shard and docs:
                    yield from flush()
                    ids, docs = [], []
                shard = at
                ids.append(doc_id)
                docs.append(np.frombuffer(data, kind))
        if docs:
            yield from flush()
        ids, docs = [], []
        give_back()

    return run


def pack_documents(docs: DataFrame, *, window: int = WINDOW, vocabulary: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: PIECES. Each id of each document lies in exactly one piece; no sequence is padded.

    A null or empty text is the end id alone. Repeated rows are packed each on its own; equal BM25 scores go to the earlier
    document. A null id stays null. Other columns are ignored. An empty table gives no rows. sequence_id is unique in the
    whole result: the shard in its high bits, a counter below. Nothing is gathered but counts by term of the vocabulary.
    """
    spark, path = docs.sparkSession, vocabulary or vocabulary_path()
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    encoded = materialize(slim.mapInArrow(_encode(path, end_id), ENCODED), "packing-ids")
    stored = encoded.filter("place is not null")
    n, total = stored.agg(F.count("*"), F.sum("n")).first()
    frequent = encoded.filter("place is null").groupBy("term").agg(F.sum("count").alias("df")).toPandas()  # at most the vocabulary
    size = encoder(path).tokenizer.get_vocab_size() + 1
    df = np.zeros(size)
    df[frequent["term"].to_numpy(np.int64)] = frequent["df"].to_numpy(float)
    corpus = spark.sparkContext.broadcast((idf(df, n), (total or 0) / max(n, 1)))  # as long as the vocabulary
    terms = stored.select("ids").mapInArrow(_terms(path, corpus), "term long, n long").groupBy("term").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    first, count, shards = shard_plan([tuple(r) for r in terms.collect()], size, shard_tokens, shard_docs)  # at most the vocabulary
    plan = spark.sparkContext.broadcast((first, count))
    routed = stored.select("doc_id", "ids", "place").mapInArrow(_route(path, corpus, plan), "doc_id long, ids binary, place long, term long, shard long")
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-shards // SHARDS_A_TASK))
    ordered = routed.repartition(tasks, "shard").sortWithinPartitions("shard", "term", "place")
    return ordered.select("doc_id", "ids", "shard").mapInArrow(_pack(path, window, corpus), PIECES)


def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op5_retrieval_packing": op5_retrieval_packing}
ORACLE: dict[str, str] = {}
