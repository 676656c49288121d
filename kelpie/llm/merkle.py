"""Merkle manifest of a corpus: every document is a leaf, every source a tree, the sources' roots a tree above them.

Leaves get their place in their tree from a range sort and one count a range. A task then appends the nodes of aligned blocks
of 16 ** 3 leaves in a stream: every appended node carries the witnesses of the leaves below it, a witness holds the still
open runs it stands in, and each sibling that joins such a run extends it. What a block comes to, its root, is a further
append one round up, where blocks of 16 ** 3 roots are streamed likewise, until each tree has one node; so no source, however
large, is ever in one task. Witnesses go down the same rounds: those of a block's root complete those of its leaves.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.llm.common import crc_mod, discard, materialize, table

ARITY = 16
#: Levels that one stream of appends covers.
LEVELS = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def levels_of(n: int, most: int = LEVELS) -> int:
    """Levels of a tree of n nodes, at most those of a block."""
    out = 0
    while n > 1 and out < most:
        n, out = -(-n // ARITY), out + 1
    return out


class Run:
    """Consecutive nodes that become one. Witnesses hold the run itself, so every later sibling extends them."""

    __slots__ = ("joined", "nodes")

    def __init__(self):
        self.nodes: list[str] = []
        self.joined = ""

    def close(self) -> str:
        self.joined = "".join(self.nodes)
        return digest(self.joined)


class Appender:
    """A tree of `levels` levels to which nodes are appended from the left.

    append() gives the witness of the node: a list of (run, place), which grows as the runs above it open. It is whole once
    finish() has closed the last runs; resolve() then turns it into the siblings to the left and right, level by level.
    """

    def __init__(self, levels: int):
        self.open = [Run() for _ in range(levels)]
        self.below: list[list[list]] = [[] for _ in range(levels)]  # the witnesses under each level's open run
        self.root: str | None = None

    def append(self, node: str) -> list:
        witness: list = []
        self._append(0, node, [witness])
        return witness

    def _append(self, level: int, node: str, witnesses: list[list]) -> None:
        if level == len(self.open):
            self.root = node
            return
        run = self.open[level]
        step = (run, len(run.nodes))
        for w in witnesses:
            w.append(step)
        run.nodes.append(node)
        self.below[level] += witnesses
        if len(run.nodes) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, witnesses = self.open[level], self.below[level]
        self.open[level], self.below[level] = Run(), []
        self._append(level + 1, run.close(), witnesses)

    def finish(self) -> str | None:
        for level in range(len(self.open)):
            if self.open[level].nodes:
                self._close(level)
        return self.root


def resolve(witness: list) -> list[str]:
    """left, right, left, right, ...: the joined siblings before and after the node, from its own run upwards."""
    out = []
    for run, k in witness:
        out += [run.joined[: k * _HEX], run.joined[(k + 1) * _HEX :]]
    return out


def fold(leaf: str, witness: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for k in range(0, len(witness), 2):
        leaf = digest(witness[k] + leaf + witness[k + 1])
    return leaf


def proof_digest(witness: list[str]) -> str:
    return digest("".join(witness))


# --- leaves and their places ---------------------------------------------------------------------------------------


def leaf_of(columns: dict[str, Column]) -> Column:
    """The leaf over some values in order: `-` for null, else the UTF-8 byte count, a colon and the value."""
    parts = []
    for value in columns.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _positions(nodes: DataFrame, order: list[Column], name: str) -> DataFrame:
    """nodes with pos, the place in the tree, and n, the tree's size. Equal rows lie in any order.

    A range sort over all trees, then one count for each tree and range: no tree is sorted in one task, nor is a heap of rows
    that are equal in all they are sorted by, since the place in the input breaks ties.
    """
    tied = nodes.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("tree"), *order, F.col("tie")]
    ranged = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged, f"{name}-ranged").withColumn("range", F.shiftright("at", 33))
    counts = ranged.groupBy("tree", "range").agg(F.min("at").alias("low"), F.count("*").alias("rows"))
    tree = W.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "range", (before - F.col("low")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    return ranged.join(counts, ["tree", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def _block(levels: int) -> Column:
    return F.shiftright("pos", 4 * levels)


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes dealt so that each aligned block of a tree lies in one task, in order."""
    return nodes.withColumn("block", _block(levels)).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _streams(batches, columns: list[str]):
    """(tree, block, rows) of each block in order; a row is a tuple of `columns`, which begin with tree, block, pos."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True):
            if row[:2] != key:
                if rows:
                    yield *key, rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield *key, rows


def _roots(levels: int):
    """One row per block: its root, a node of the next round."""
    names = ["tree", "pos", "node", "n"]

    def run(batches):
        out: list[tuple] = []
        for tree, block, rows in _streams(batches, ["tree", "block", "pos", "node", "n"]):
            n = rows[0][4]
            stream = Appender(levels_of(n, levels))
            for row in rows:
                stream.append(row[3])
            out.append((tree, block, stream.finish(), -(-n // ARITY**levels)))
            if len(out) >= 4096:
                yield _batch(out, names)
                out = []
        if out:
            yield _batch(out, names)

    return run


def _batch(rows: list[tuple], names: list[str], types: dict | None = None) -> pa.RecordBatch:
    kinds = {"tree": pa.string(), "block": pa.int64(), "pos": pa.int64(), "n": pa.int64(), "witness": pa.list_(pa.string()), "verified": pa.bool_()} | (types or {})
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.string())) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def _climb(nodes: DataFrame, levels: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The rounds of nodes of trees that still have several, and after each round the roots of the trees that are done."""
    rounds, tops = [nodes], []
    while True:
        slim = _blocks(rounds[-1].select("tree", "pos", "node", "n"), levels)
        up = materialize(slim.mapInArrow(_roots(levels), "tree string, pos long, node string, n long"), f"{name}-roots")
        tops.append(up.filter("n = 1").select("tree", "node"))
        more = up.filter("n > 1")
        if more.isEmpty():
            return rounds, tops
        rounds.append(more)


def _inner(levels: int):
    """The witness of every node: within its block, then that of the block's root, which the block's first row carries."""

    def run(batches):
        for tree, _, rows in _streams(batches, ["tree", "block", "pos", "node", "n", "witness"]):
            above, stream = rows[0][5], Appender(levels_of(rows[1][4], levels))
            witnesses = [stream.append(row[3]) for row in rows[1:]]
            stream.finish()
            for at in range(0, len(witnesses), 256):
                yield _batch([(tree, row[2], resolve(w) + above) for row, w in zip(rows[1 + at : 257 + at], witnesses[at : at + 256], strict=True)], ["tree", "block", "witness"])

    return run


def _with_uppers(nodes: DataFrame, uppers: DataFrame, levels: int) -> DataFrame:
    """nodes in blocks, each block led by a row (pos -1) with the witness of its root."""
    lead = uppers.withColumn("pos", F.lit(-1).cast("long"))
    both = nodes.withColumn("block", _block(levels)).unionByName(lead, allowMissingColumns=True)
    return both.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _descend(rounds: list[DataFrame], tops: list[DataFrame], witnesses: DataFrame, levels: int, name: str) -> DataFrame:
    """(tree, block, witness) of the blocks of the first round, where witnesses has (tree, witness) of each tree's root."""
    down = None
    for k in range(len(rounds) - 1, -1, -1):
        uppers = tops[k].select("tree").join(witnesses, "tree").select("tree", F.lit(0).cast("long").alias("block"), "witness")
        uppers = uppers if down is None else uppers.unionByName(down)
        if k == 0:
            return uppers
        nodes = _with_uppers(rounds[k].select("tree", "pos", "node", "n"), uppers, levels)
        down = materialize(nodes.mapInArrow(_inner(levels), "tree string, block long, witness array<string>"), f"{name}-witnesses")
    raise ValueError("no rounds")


def _proofs(root: str, full: bool, levels: int):
    """Per leaf: leaf, subroot, root, proof_sha256, folded_root, verified; and the witness itself if full."""
    columns = ["tree", "block", "pos", "node", "n", "witness", "doc_id", "seen"]
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["witness"] * full

    def run(batches):
        for _, _, rows in _streams(batches, columns):
            above, subroot, stream = rows[0][5], rows[0][3], Appender(levels_of(rows[1][4], levels))
            witnesses = [stream.append(row[3]) for row in rows[1:]]
            stream.finish()
            for at in range(0, len(witnesses), 512):
                out = []
                for row, partial in zip(rows[1 + at : 513 + at], witnesses[at : at + 512], strict=True):
                    w = resolve(partial) + above
                    folded = fold(row[7] or row[3], w)
                    out.append((row[6], row[3], subroot, root, proof_digest(w), folded, folded == root, *([w] if full else [])))
                yield _batch(out, names, {"doc_id": pa.int64()})

    return run


def manifest(docs: DataFrame, *, seen: Column | None = None, full: bool = False, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = COLUMNS, text_col: str = "text", levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; witness too if full.

    A leaf is the SHA-256 of `columns` in order. In each group leaves ascend by id (null first), rows of one id by leaf;
    every 16 consecutive nodes become one until a single one is left, the subroot. Subroots ascend by group (null first, then
    bytewise) and become the root likewise. seen is the text as it is found on verification (default: unchanged); the leaf it
    gives and the stored siblings are folded to folded_root, which verifies if it is the root. A null text stays null. Rows
    that repeat are leaves each on its own; other columns are ignored whatever their names; an empty table gives no rows.
    With full, witness lists the joined siblings to the left and right, level by level (fold() folds them).
    levels is how many levels one stream of appends covers; it changes no result.
    """
    values = {c: F.col(f"`{c}`") for c in columns}
    slim = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{group_col}`").cast("string")), F.lit("n")).alias("tree"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        leaf_of(values).alias("node"),
        (leaf_of(values | {text_col: seen}) if seen is not None else F.lit(None).cast("string")).alias("seen"),
    )
    leaves = materialize(slim.withColumn("seen", F.nullif("seen", "node")), "leaves")
    placed = _positions(leaves, [F.asc_nulls_first("doc_id"), F.col("node")], "leaves")
    rounds, tops = _climb(placed, levels, "leaf")
    subroots = materialize(reduce(DataFrame.unionByName, tops), "subroots")
    discard(leaves)

    above = _positions(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), [F.col("name")], "subroots")
    above_rounds, above_tops = _climb(above, levels, "subroot")
    top = reduce(DataFrame.unionByName, above_tops).first()
    root = top["node"] if top else ""
    none = docs.sparkSession.createDataFrame([("", [])], "tree string, witness array<string>")
    inner = _with_uppers(above.select("tree", "pos", "node", "n"), _descend(above_rounds, above_tops, none, levels, "subroot"), levels)
    by_place = inner.mapInArrow(_inner(levels), "tree string, block long, witness array<string>").select(F.col("block").alias("pos"), "witness")
    witnesses = materialize(above.join(by_place, "pos").select(F.col("name").alias("tree"), "witness"), "subroot-witnesses")

    uppers = _descend(rounds, tops, witnesses, levels, "leaf").join(subroots, "tree")
    ddl = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _with_uppers(placed, uppers, levels).mapInArrow(_proofs(root, full, levels), ddl + ", witness array<string>" * full)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; where 5 divides the id's CRC-32, the text is found with its A-Z lower-cased."""
    seen = F.when(crc_mod("doc_id", 5) == 0, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    return manifest(table(spark, sf_dir, "documents"), seen=seen)


# --- the same in SQL -----------------------------------------------------------------------------------------------


def _sql_levels(first: str, n: int = 6) -> str:
    """CTEs that reduce `first`_0 (g, pos, h, n) n times by sixteen; 16 ** 6 nodes are more than any test table has."""
    out = []
    for k in range(n):
        a, b, r = f"{first}_{k}", f"{first}_{k + 1}", f"{first}_run_{k}"
        out.append(f"{r} AS (SELECT g, pos // {ARITY} AS run, string_agg(h, '' ORDER BY pos) AS joined, any_value(n) AS n FROM {a} WHERE n > 1 GROUP BY g, pos // {ARITY})")
        out.append(f"{b} AS (SELECT g, run AS pos, sha256(joined) AS h, (n + {ARITY - 1}) // {ARITY} AS n FROM {r} UNION ALL SELECT g, pos, h, n FROM {a} WHERE n = 1)")
    return ",\n".join(out)


def _sql_folds(first: str, start: str, n: int = 6) -> str:
    """CTEs that carry each document's place, folded digest and siblings from `start` through the levels of `first`."""
    out = []
    for k in range(n):
        before = start if k == 0 else f"{first}_fold_{k - 1}"
        left, right = f"substr(joined, 1, {_HEX} * (pos % {ARITY}))", f"substr(joined, {_HEX} * (pos % {ARITY} + 1) + 1)"
        out.append(
            f"{first}_fold_{k} AS (SELECT d.* EXCLUDE (pos, folded, proof), d.pos // {ARITY} AS pos, coalesce(sha256({left} || d.folded || {right}), d.folded) AS folded, "
            f"d.proof || coalesce({left} || {right}, '') AS proof FROM {before} d LEFT JOIN {first}_run_{k} r ON r.g = d.g AND r.run = d.pos // {ARITY})"
        )
    return ",\n".join(out)


def _field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE = {
    "op12_merkle_manifest": f"""
WITH RECURSIVE bit(b, v, k) AS (SELECT range, CAST(range AS UINTEGER), 0 FROM range(256) UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UINTEGER)) ELSE v >> 1 END, k + 1 FROM bit WHERE k < 8),
crc AS (SELECT list(CAST(v AS UBIGINT) ORDER BY b) AS t FROM bit WHERE k = 8),
docs AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda y: CAST(ascii(y) AS UBIGINT))),
  lambda a, y: xor(a >> 8, t[CAST(xor(a, y) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 5 = 0 AS tampered FROM documents, crc),
leaves AS (SELECT doc_id, coalesce('s' || source, 'n') AS g, sha256({" || ".join(map(_field, COLUMNS))}) AS h,
  CASE WHEN tampered THEN sha256({" || ".join(map(_field, (*COLUMNS[:-1], f"translate(text, '{_UPPER}', '{_LOWER}')")))}) END AS seen FROM docs),
leaf_0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{_sql_levels("leaf").replace("FROM leaf_0 WHERE n = 1", "FROM (SELECT g, pos, h, n FROM leaf_0) WHERE n = 1")},
sub_0 AS (SELECT '' AS g, g AS name, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM leaf_6),
{_sql_levels("sub")},
leaf_start AS (SELECT doc_id, g, h AS leaf, pos, coalesce(seen, h) AS folded, '' AS proof FROM leaf_0),
{_sql_folds("leaf", "leaf_start")},
sub_start AS (SELECT f.doc_id, '' AS g, f.leaf, s.h AS subroot, s.pos, f.folded, f.proof FROM leaf_fold_5 f JOIN sub_0 s ON s.name = f.g),
{_sql_folds("sub", "sub_start")}
SELECT f.doc_id, f.leaf, f.subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = r.h AS verified FROM sub_fold_5 f, sub_6 r
"""
}
