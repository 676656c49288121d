"""N-gram Jaccard join on token-combination prefixes.

A document is the set of its word shingles. Shingles are ordered rare before frequent, inside a class by hash; frequent
ones are told by a sketch of fixed width that counts all documents. If two sets overlap by o, their prefixes of length
size - o + s share at least s shingles. Rare shingles of a prefix are indexed alone. Where a prefix reaches the frequent
class, it is extended by one shingle for each of g hash classes, so that a similar partner either shares a rare shingle
or two frequent ones of one class: pairs of frequent shingles of a class are indexed. g grows with the set, which keeps
the pairs in proportion to the prefix.

Equal sets are one node. In each bucket of the index, members are first compared with a few pivots only, verified, and
joined into components. Of pairs that sizes and sketches allow, each set is first verified against one partner; the other
pairs are verified only where their sets still lie in different components. Members of a bucket that still lie in different
components are then compared with each other inside a join whose condition rejects by size and by an exact bound (the bits in which two 512-bit parity sketches differ
never exceed the symmetric difference). Large sets fill those bits, so their pairs also meet a sketch of n / 16 to n / 8
bucket counts, whose difference never exceeds the symmetric difference either. Only near-certain links reach the
verification on whole sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import LOWER, NON_SPACE, discard, give_back, materialize, mix64, slices, span_hashes, table, utf8_of, word_spans
from kelpie.llm.components import connected_components

SHINGLE_WORDS = 3
SIMILAR_PERCENT = 90
SKETCH_BITS = 18
CHUNK_BYTES = 256 << 10
PIVOT_SEEDS = (0, 0x5A17C3B96E2D48F1, 0x26B9E15D7C3A0F84, 0x713D5E8A92C4B66F)
BLOCK_NODES = 256
PARITY_WORDS = 8
_PARITY = [f"b{k}" for k in range(PARITY_WORDS)]


def shingle_sets(texts: pa.Array, words: int = SHINGLE_WORDS):
    """The sorted distinct shingle hashes of each text, in order; a text of fewer words is one shingle."""
    whole, offsets = utf8_of(texts)
    for i, j in slices(offsets, CHUNK_BYTES):
        raw = LOWER[whole[offsets[i] : offsets[j]]]
        start, end, first = word_spans(raw, offsets[i : j + 1] - offsets[i], NON_SPACE)
        h = span_hashes(raw, start, end)
        n = len(h) - words + 1
        joined = np.zeros(max(n, 0), np.uint64)
        for k in range(words):
            joined = mix64(joined + h[k : k + max(n, 0)] + np.uint64(k + 1))
        for r in range(j - i):
            a, b = int(first[r]), int(first[r + 1])
            if b - a >= words:
                s = np.sort(joined[a : b - words + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                short = np.zeros(1, np.uint64)
                for k in range(a, b):
                    short = mix64(short + h[k : k + 1] + np.uint64(100 + k - a))
                yield short
            else:
                yield np.zeros(0, np.uint64)


def node_id(s: np.ndarray) -> int:
    """A signed 64-bit id of a set; the chance that any two of n different sets share it is about n * n / 2**65."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity(s: np.ndarray) -> list[int]:
    """A sketch of 512 bits: each shingle flips one."""
    bits = np.bincount((s >> np.uint64(40)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(">i8").tolist()


def coarse(s: np.ndarray) -> bytes:
    """Shingles in each of n / 16 to n / 8 hash buckets; nothing for small sets, whose parity tells enough."""
    if len(s) < 64:
        return b""
    buckets = 1 << (len(s).bit_length() - 4)
    return np.bincount(((s >> np.uint64(30)) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets).astype("<u2").tobytes()


def coarse_difference(x: bytes, y: bytes) -> tuple[int, int]:
    """(a bound that the symmetric difference of two sets is never below, the sum of their sizes) from coarse()."""
    a, b = np.frombuffer(x, "<u2").astype(np.int64), np.frombuffer(y, "<u2").astype(np.int64)
    few = min(len(a), len(b))
    if not few:
        return 0, 0
    a, b = a.reshape(-1, few).sum(0), b.reshape(-1, few).sum(0)
    return int(np.abs(a - b).sum()), int(a.sum() + b.sum())


def pack_set(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: two sets of 20,000 share one by chance in a millionth of all cases."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack_set(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, 2:] = six
    return out.view("<u8").ravel()


def _describe(words: int):
    """Rows of documents (id, size, node, parity, coarse) and, at the end of a partition, rows of its sketch (slot, count)."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "text_key", "n", "node", *_PARITY, "coarse", "slot", "count"]
        for batch in batches:
            rows, fine = [], []
            for s in shingle_sets(batch.column(1), words):
                np.add.at(counts, (s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), 1)
                rows.append((len(s), node_id(s), *parity(s)))
                fine.append(coarse(s))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (2 + PARITY_WORDS)
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in cols), pa.array(fine, pa.binary()), none, none], names)
        slot = np.flatnonzero(counts)
        give_back()
        none = pa.nulls(len(slot), pa.int64())
        yield pa.RecordBatch.from_arrays([none] * (4 + PARITY_WORDS) + [pa.nulls(len(slot), pa.binary()), pa.array(slot), pa.array(counts[slot])], names)

    return run


def combination_classes(n: int) -> int:
    """g for sets of n shingles: the same for all sizes between two powers of two."""
    return max(1, (1 << (n.bit_length() - 1)) >> 4)


def signatures(s: np.ndarray, frequent: np.ndarray, percent: int = SIMILAR_PERCENT) -> np.ndarray:
    """Index keys of a sorted set. frequent: flags by the low bits of a shingle. Sets too small to be similar to a
    different one have none. Two sets whose similarity is at least percent / 100 share a key."""
    n = len(s)
    spare = n - -(-percent * n // 100)
    if 100 * n < percent * (n + 1):
        return np.zeros(0, np.uint64)
    often = frequent[(s & np.uint64(len(frequent) - 1)).astype(np.int64)]
    rare = s[~often]
    if len(rare) > spare:
        return mix64(rare[: spare + 1])
    out, common = [mix64(rare)], s[often]
    near = {combination_classes(max(1, -(-percent * n // 100))), combination_classes(n), combination_classes(100 * n // percent)}
    for g in near:
        some = common[: max(0, spare + 1 + g - len(rare))]
        cls = ((some >> np.uint64(20)) % np.uint64(g)).astype(np.int64)
        order = np.argsort(cls, kind="stable")
        some, cls = some[order], cls[order]
        for part in np.split(some, np.flatnonzero(np.diff(cls)) + 1):
            if len(part) > 1:
                a, b = np.triu_indices(len(part), 1)
                out.append(mix64(mix64(part[a] + np.uint64(g)) + part[b]))
    return np.concatenate(out)


def _index(flags: bytes, words: int, percent: int):
    def run(batches):
        frequent = np.unpackbits(np.frombuffer(flags, np.uint8)).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            keys, nodes = [], []
            for s in shingle_sets(batch.column(0), words):
                node = node_id(s)
                if not len(s) or node in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(node)
                k = np.unique(signatures(s, frequent, percent))
                keys.append(k)
                nodes.append(np.full(len(k), node, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], ["sig", "node"])
        seen.clear()
        give_back()

    return run


def _sets(words: int):
    """(node, shingles) of documents that have the wanted node."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            found = []
            for s, node in zip(shingle_sets(batch.column(0), words), batch.column(1).to_pylist(), strict=True):
                if node not in seen and node_id(s) == node:
                    found.append((node, pack_set(s)))
                    if len(seen) < 500_000:
                        seen.add(node)  # rows that repeat id and text
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["node", "shingles"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                a, b = unpack_set(x), unpack_set(y)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([u[k] for k in keep], pa.int64()), pa.array([v[k] for k in keep], pa.int64())], ["u", "v"])
        give_back()

    return run


def _plausible(percent: int):
    """Pairs whose coarse sketches allow the similarity."""

    def run(batches):
        for batch in batches:
            bounds = [coarse_difference(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = pa.array([differ * (100 + percent) <= (100 - percent) * sizes for differ, sizes in bounds], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return run


def _may_link(a: str, b: str, percent: int) -> Column:
    """Sizes and parity sketches allow the similarity: |A xor B| <= (100 - p) / (100 + p) * (|A| + |B|)."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in _PARITY), F.lit(0))
    return (100 * n >= percent * m) & (100 * m >= percent * n) & (differ * (100 + percent) <= (100 - percent) * (n + m))


def _candidates(members: DataFrame, slim_nodes: DataFrame, percent: int) -> DataFrame:
    """All pairs (u, v) that share a bucket and that sizes and sketches allow. A bucket is dealt in blocks of about
    BLOCK_NODES nodes, and each pair of blocks is a key of its own, so that no task holds all pairs of a large bucket."""
    m = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK_NODES).cast("int"))
    m = m.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(slim_nodes, "node")
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    a, b = m.filter("block = low").alias("a"), m.filter("block = high").alias("b")
    same = (F.col("a.sig") == F.col("b.sig")) & (F.col("a.low") == F.col("b.low")) & (F.col("a.high") == F.col("b.high"))
    met = a.join(b, same & ((F.col("a.low") != F.col("a.high")) | (F.col("a.node") > F.col("b.node"))) & _may_link("a", "b", percent))
    return met.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()


def jaccard_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = SIMILAR_PERCENT, count_links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least id that links reach, itself included).

    count_links verifies every candidate pair of different sets, not only as many as the components need, and appends
    n_links: how many other sets are similar to the document's own; documents with equal sets count as one. The pairs of
    a group then grow with the square of its different sets. Documents without
    words (null, empty, blank) have no shingles and link with nothing. Documents with equal sets are linked. Repeated rows
    are each returned; rows that repeat an id with other texts are nodes of their own. A row with a null id links by its
    text like any other; its component is null where no row that links reach has an id. Other columns are ignored. An empty table
    gives no rows.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    described = materialize(slim.mapInArrow(_describe(words), ", ".join(f"{c} long" for c in ["doc_id", "text_key", "n", "node", *_PARITY]) + ", coarse binary, slot long, count long"), "shingle-docs")
    sketch = described.filter("slot is not null").groupBy("slot").agg(F.sum("count").alias("count"))
    shingles = sketch.agg(F.sum("count")).first()[0] or 0
    mean = shingles / (1 << SKETCH_BITS)
    flags = np.zeros(1 << SKETCH_BITS, bool)
    often = sketch.filter(F.col("count") > mean + 8 * mean**0.5 + 16).select("slot").toPandas()["slot"].to_numpy()  # at most 2**SKETCH_BITS
    flags[often] = True

    rows = described.filter("slot is null").select("doc_id", "text_key", "n", "node", *_PARITY, "coarse")
    nodes = materialize(rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.min("text_key").alias("text_key"), F.first("n").alias("n"), *[F.first(p).alias(p) for p in [*_PARITY, "coarse"]]), "nodes")
    slim_nodes = nodes.drop("coarse", "text_key")

    sigs = materialize(slim.select("text").mapInArrow(_index(np.packbits(flags).tobytes(), words, percent), "sig long, node long"), "signatures")
    pivots = [f"p{k}" for k in range(len(PIVOT_SEEDS))]
    ends = sigs.groupBy("sig").agg(F.max("node").alias("top"), F.min("node").alias("p0"), *[F.min(F.col("node").bitwiseXOR(F.lit(s))).alias(f"p{k}") for k, s in enumerate(PIVOT_SEEDS) if s])
    if count_links:
        ends = ends.join(sigs.groupBy("sig").agg(F.count("*").alias("size")), "sig")
    ends = ends.filter("top != p0").select("sig", *(["size"] if count_links else []), *[F.col(f"p{k}").bitwiseXOR(F.lit(s)).alias(f"p{k}") for k, s in enumerate(PIVOT_SEEDS)])
    members = materialize(sigs.join(ends, "sig").distinct(), "bucket-members")
    discard(sigs)

    def plausible(pairs: DataFrame, name: str) -> DataFrame:
        a, b = nodes.select(F.col("node").alias("u"), F.col("coarse").alias("x")), nodes.select(F.col("node").alias("v"), F.col("coarse").alias("y"))
        return materialize(pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(_plausible(percent), "u long, v long"), name)

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct().join(nodes.select("node", "first_doc", F.col("text_key").alias("key")), "node")
        named = slim.join(wanted.filter("first_doc is not null"), F.col("doc_id") == F.col("first_doc")).select("text", "node")
        unnamed = slim.filter("doc_id is null").join(wanted.filter("first_doc is null"), F.col("text_key") == F.col("key")).dropDuplicates(["node"]).select("text", "node")
        sets = named.union(unnamed)
        sets = materialize(sets.mapInArrow(_sets(words), "node long, shingles binary"), "shingle-sets")
        a, b = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
        links = materialize(pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(_verify(percent), "u long, v long").distinct(), "links")
        discard(sets)
        return links

    if count_links:
        links = verified(plausible(_candidates(members.select("sig", "node", "size"), slim_nodes, percent), "all-pairs"))
        discard(members)
        found = connected_components(links)
    else:
        first = members.select(F.explode(F.array_distinct(F.array(*pivots))).alias("v"), F.col("node").alias("u")).filter("u != v")
        first = first.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        met = materialize(first.join(slim_nodes.alias("a"), F.col("u") == F.col("a.node")).join(slim_nodes.alias("b"), F.col("v") == F.col("b.node")).filter(_may_link("a", "b", percent)).select("u", "v"), "pivot-pairs")
        first = plausible(met, "plausible-pairs")

        # a pair for each node spans most groups; of the others only those between different components are left to verify
        spanning = materialize(first.groupBy("u").agg(F.min("v").alias("v")), "spanning-pairs")
        links = verified(spanning)
        found = connected_components(links)
        roots = nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        a, b = roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        apart = materialize(first.join(spanning, ["u", "v"], "left_anti").join(a, "u").join(b, "v").filter("ru != rv").select("u", "v"), "pairs-apart")
        if not apart.isEmpty():
            links = links.union(more := verified(apart))
            found = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))

        wide = slim_nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = members.select("sig", "node").join(wide, "node")
        torn = open_.groupBy("sig").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).filter("size > 2 and low != high").select("sig")
        open_ = open_.join(torn, "sig")
        a, b = open_.alias("a"), open_.alias("b")
        rest = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.node") > F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & _may_link("a", "b", percent))
        rest = rest.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
        rest = plausible(rest.join(met, ["u", "v"], "left_anti"), "rest-pairs")
        discard(members)
        if not rest.isEmpty():
            links = links.union(more := verified(rest))
            found = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))

    labels = nodes.select("node", "first_doc").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labels.groupBy("root").agg(F.min("first_doc").alias("component"))
    labels = labels.join(least, "root").select("node", "component")
    out = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")]
    if count_links:
        degree = links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
        labels = labels.join(degree, "node", "left")
        out.append(F.coalesce("links", F.lit(0)).alias("n_links"))
    return rows.select("doc_id", "n", "node").join(labels, "node", "left").select(*out)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
ORACLE = {
    "op3_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) END AS s FROM w),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT list_sort(s) AS s, doc_id FROM s) WHERE len(s) > 0 GROUP BY s),
e AS (SELECT rep, n, unnest(s) AS g FROM c),
l AS (SELECT a.rep AS u, b.rep AS v FROM e a JOIN e b ON a.g = b.g AND a.rep <> b.rep AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT rep AS u, rep AS root FROM c UNION SELECT l.v, r.root FROM r JOIN l ON r.u = l.u),
k AS (SELECT u, min(root) AS root FROM r GROUP BY u),
d AS (SELECT s.doc_id, len(s.s) AS n, c.rep FROM s LEFT JOIN c ON list_sort(s.s) = c.s)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(k.root, d.doc_id) AS component_id FROM d LEFT JOIN k ON d.rep = k.u
"""
}
