"""Removal of long strings that occur elsewhere: suffix arrays over shards in which all equal strings meet.

Every window of `length` bytes has a key, the least hash of the K-byte strings in it. It depends on the window's bytes alone,
so equal windows have equal keys; neighbouring windows with one key form a fragment. Fragments are first counted by their
digest: one that occurs twice is covered whole, wherever it stands. Of the others, those whose key has further fragments go
with one of each of these to the shard of their key. A shard's suffix array and permuted common prefixes tell which of its
windows occur twice. A key with more fragments than a shard may hold takes the exact way round: its windows' digests are
counted one by one, dealt by the digest.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import discard, give_back, materialize, ranges, slices, span_hashes, table, utf8_of
from kelpie.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 400
#: Bytes of the strings whose least hash is a window's key.
K = 64
#: Bytes of fragments that one suffix array covers; a key with more takes the other way.
SHARD_BYTES = 2 << 20
#: Windows of one text, and bytes of texts, that are cut into fragments at once.
PIECE = 1 << 20
#: No byte of UTF-8: it ends a fragment in a shard.
BREAK = b"\xff"
_FRAGMENTS = "row long, start int, windows int, key long, digest binary, again boolean"


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of h[i : i + width] for each i that has so many."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def fragments(raw: np.ndarray, offsets: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, ...]:
    """(text, place, windows, key, again) of the fragments of some texts in one buffer; place is in the buffer.

    again: the string of the key stands in the fragment more than once, so that a window may repeat inside it.
    """
    k = min(k, length)
    width = length - k + 1
    each = np.maximum(np.diff(offsets) - length + 1, 0)
    window = ranges(offsets[:-1], each)
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    at = np.arange(len(raw) - k + 1)
    h = span_hashes(raw, at, at + k)
    key = _least(h, width)[window]
    new = np.ones(len(window), bool)
    new[1:] = (window[1:] != window[:-1] + 1) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(window)))
    place, key = window[first], key[first]
    span = windows + width - 1
    starts = np.cumsum(span) - span
    hits = np.add.reduceat((h[ranges(place, span)] == np.repeat(key, span)).astype(np.int64), starts)
    return np.searchsorted(offsets, place, "right") - 1, place, windows, key, hits > 1


def _cut(length: int, k: int, most: int):
    """Fragments of the texts of Arrow batches (row, text)."""

    def pieces(raw, off):
        """(first text, offsets) of pieces of bounded size; a long text in several that overlap."""
        for i, j in slices(off, most):
            if off[j] - off[i] <= 2 * most:
                yield i, off[i : j + 1], 0
            else:
                for a in range(int(off[i]), int(off[j]) - length + 1, most):
                    yield i, np.array([a, min(a + most + length - 1, int(off[j]))]), a - int(off[i])

    def run(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            raw, off = utf8_of(batch.column(1))
            for i, o, base in pieces(raw, off):
                part = raw[o[0] : o[-1]]
                local = o - o[0]
                text, place, windows, key, again = fragments(part, local, length, k)
                if not len(place):
                    continue
                view = memoryview(np.ascontiguousarray(part))
                digests = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(place.tolist(), (place + windows + length - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[i + text]), pa.array((place - local[text] + base).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(digests, pa.binary()), pa.array(again)],
                    ["row", "start", "windows", "key", "digest", "again"],
                )
        give_back()

    return run


def _fetch(length: int):
    """The bytes of chosen fragments: (row, text, wanted) to (key, row, start, windows, known, bytes)."""
    schema = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("known", pa.bool_()), ("bytes", pa.binary())])

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        for batch in batches:
            wanted = batch.column(2)
            for i in range(batch.num_rows):
                text, out, held = (batch.column(1)[i].as_py() or "").encode(), [], 0
                row = batch.column(0)[i].as_py()
                for w in wanted[i].as_py():
                    data = text[w["start"] : w["start"] + w["windows"] + length - 1]
                    out.append((w["key"], row, w["start"], w["windows"], w["known"], data))
                    held += len(data)
                    if held >= PIECE:
                        yield batch_of(out)
                        out, held = [], 0
                if out:
                    yield batch_of(out)

    return run


def repeated(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some fragments, which of its windows occur a second time among all windows of all of them."""
    t = np.frombuffer(BREAK.join(parts) + BREAK, np.uint8)
    sa = suffix_array(t)
    prefixes = common_prefixes(t, sa)
    long = prefixes >= length  # the suffix before starts with the same window
    long[sa[:-1]] |= long[sa[1:]]
    out, at = [], 0
    for p in parts:
        out.append(long[at : at + len(p) - length + 1])
        at += len(p) + 1
    return out


def _runs(flag: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(flag.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _shards(length: int, most: int):
    """Spans (row, start, end) of repeated windows of fragments that come sorted by key."""

    def solved(held):
        out = []
        for (_, row, start, _, known, _), flag in zip(held, repeated([x[5] for x in held], length), strict=True):
            if not known:
                out += [(row, start + a, start + b + length - 1) for a, b in _runs(flag)]
        return out

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["row", "start", "end"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size >= most and x[0] != held[-1][0]:
                    yield batch_of(solved(held))
                    held, size = [], 0
                held.append(x)
                size += len(x[5])
        if held:
            yield batch_of(solved(held))
        give_back()

    return run


def _windows(length: int):
    """(digest, row, start) of every window of some fragments; row is null where the fragment is known to be covered."""

    def run(batches):
        for batch in batches:
            for _, row, start, windows, known, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                view = memoryview(data)
                for a in range(0, windows, 8192):
                    b = min(windows, a + 8192)
                    digests = [hashlib.blake2b(view[k : k + length], digest_size=16).digest() for k in range(a, b)]
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([None if known else row] * (b - a), pa.int64()), pa.array(range(start + a, start + b), pa.int64())], ["digest", "row", "start"])

    return run


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["start"], s["end"]) for s in spans or []):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def _keep(batches):
    """(doc_id, text, spans) to doc_id, n_bytes, n_removed, spans, kept."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part, out = batch.slice(i, 256), []
            for doc_id, text, spans in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                data, spans = (text or "").encode(), _merged(spans)
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc_id, len(data), len(data) - len(kept), [{"start": a, "end": b} for a, b in spans], kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})), pa.binary()))],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )


def repeated_spans(rows: DataFrame, length: int = LENGTH, *, k: int = K, piece: int = PIECE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(row, start, end) of byte spans of windows that occur twice in rows (row, text); row is unique. Spans may overlap.

    k, piece and shard_bytes are the bytes of a key's strings, of texts cut at once and of a shard; they change no result.
    """
    cut = materialize(rows.filter(F.octet_length("text") >= length).mapInArrow(_cut(length, k, piece), _FRAGMENTS), "fragments")
    distinct = cut.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct("row", "start")).alias("first"), F.max("windows").alias("windows"), F.max("again").alias("again"))
    distinct = materialize(distinct, "distinct-fragments")
    covered = cut.join(distinct.filter("n > 1").select("key", "digest"), ["key", "digest"])
    end = (F.col("start") + F.col("windows") + F.lit(length - 1)).cast("long")
    spans = [covered.select("row", F.col("start").cast("long").alias("start"), end.alias("end"))]

    keys = distinct.groupBy("key").agg(F.count("*").alias("fragments"), F.sum((F.col("n") == 1).cast("int")).alias("open"), F.max("again").alias("again"), F.sum(F.col("windows").cast("long") + F.lit(length)).alias("bytes"))
    keys = keys.filter("open > 0 and (fragments > 1 or again)").select("key", (F.col("bytes") > shard_bytes).alias("large"))
    chosen = distinct.join(keys, "key").select("key", "large", "first.row", "first.start", "windows", (F.col("n") > 1).alias("known"))
    chosen = materialize(chosen, "chosen-fragments")
    schema = "key long, row long, start int, windows int, known boolean, bytes binary"
    for large in (False, True):
        of = chosen.filter(F.col("large") == large)
        if of.isEmpty():
            continue
        by_text = of.groupBy("row").agg(F.collect_list(F.struct("key", "start", "windows", "known")).alias("wanted"))
        found = rows.join(by_text, "row").select("row", "text", "wanted").mapInArrow(_fetch(length), schema)
        if not large:
            spans.append(found.repartition("key").sortWithinPartitions("key").mapInArrow(_shards(length, shard_bytes), "row long, start long, end long"))
            continue
        each = materialize(found.mapInArrow(_windows(length), "digest binary, row long, start long"), "windows")
        twice = each.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
        spans.append(each.filter("row is not null").join(twice, "digest").select("row", "start", (F.col("start") + length).alias("end")))
    out = materialize(reduce(DataFrame.unionByName, spans), "repeated-spans")
    discard(cut)
    discard(distinct)
    discard(chosen)
    return out


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (maximal removed runs), kept (the remaining bytes).

    A byte goes if it lies in a string of `length` bytes that starts anywhere else too, in the same document or another;
    strings are judged on the whole input, and no string spans two documents. Texts are UTF-8 bytes; a null text is empty.
    Rows that repeat, or share an id or have none, are documents each on its own, so copies of `length` bytes or more lose
    all bytes. Other columns are ignored whatever their names; an empty table gives no rows. limits are those of
    repeated_spans.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = materialize(slim.withColumn("row", F.monotonically_increasing_id()), "repeat-texts")
    spans = repeated_spans(rows.select("row", "text"), length, **limits)
    by_row = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.join(by_row, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept binary")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op13_suffix_dedup": op13_suffix_dedup}
#: Every window of every text by itself, as two hexadecimal digits a byte.
ORACLE = {
    "op13_suffix_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS s FROM d WHERE len(h) >= {2 * LENGTH}),
m AS (SELECT r, s, md5(substr(h, 2 * s + 1, {2 * LENGTH})) AS x FROM w JOIN d USING (r)),
hit AS (SELECT r, s FROM m WHERE x IN (SELECT x FROM m GROUP BY x HAVING count(*) > 1)),
o AS (SELECT r, s, CASE WHEN s > lag(s) OVER (PARTITION BY r ORDER BY s) + {LENGTH} THEN 1 ELSE 0 END AS new FROM hit),
i AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS island FROM o),
span AS (SELECT r, min(s) AS a, max(s) + {LENGTH} AS b FROM i GROUP BY r, island),
part AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span),
kept AS (SELECT p.r, count(*) AS n, sum(p.b - p.a) AS removed, string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(d.h), 2 * max(b) + 1) AS h FROM part p JOIN d USING (r) GROUP BY p.r)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept k USING (r)
"""
}
