"""A stored index for substring search: three characters and their places in blocks of texts, so that a query reads postings only.

A folder holds segments. add() writes one: postings in BUCKETS parts by gram, sorted by it, and then the list of its texts,
which makes it visible; a text in a later segment replaces that of its id, remove() writes a list without postings. So adding
costs no more than what is added, and a failed or repeated attempt leaves nothing visible twice. merge() puts all that is
live into a new folder. Grams are numbers, of which a file's row groups keep the least and largest.

Texts are joined to blocks where they lie, so nothing is sent to write them. A posting is a gram's places in a block, each as
its distance from the one before; a block has a row more, with its ids, where their texts begin and where words do. Texts are
kept without their blanks: a string with blanks is found without them, and then holds if words begin where it says.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from kelpie.functions.text import folded_words, spaced

BUCKETS = 16
#: Characters of texts in a block; a longer text is a block of its own.
BLOCK = 1 << 22
#: Bits of a code point; a gram is three of them in a long.
BITS = 21
#: The bucket of the blocks' own rows.
BLOCKS = -1
TIGHT, WIDE = 0, 1


def grams(points: np.ndarray) -> np.ndarray:
    """The gram at each place: the code points of a character and the next two. The last two places have none."""
    points = points.astype(np.int64)
    return (points[:-2] << (2 * BITS)) | (points[1:-1] << BITS) | points[2:]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def packed(places: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of rising places, which begin at first, each as its distances of seven bits a byte, the low ones first."""
    gaps = np.diff(places, prepend=0)
    gaps[first] = places[first]
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 5):
        size += gaps >= 1 << (7 * k)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        more = size > k
        out[(end - size)[more] + k] = (gaps[more] >> (7 * k) & 127) | np.where(size[more] > k + 1, 128, 0)
    offsets = np.append((end - size)[first], len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(data: bytes) -> np.ndarray:
    """The places of one run."""
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    begin = np.append(0, last[:-1] + 1)[: len(last)]
    gaps = np.zeros(len(last), np.int64)
    for k in range(int((last - begin).max(initial=-1)) + 1):
        more = begin + k <= last
        gaps[more] |= (raw[begin[more] + k] & 127).astype(np.int64) << (7 * k)
    return np.cumsum(gaps)


def _block(number: int, ids: pa.Array, texts: list[str]):
    """Batches (block, gram, data, ids, starts, words): the block's own row, and its postings by gram. Texts are in their
    spaced form; in the block two characters 0 follow each. words: where a word or a gap between texts begins."""
    points = _points("".join(f"{t}\0\0" for t in texts))
    blank = points == ord(" ")
    begins = np.flatnonzero(blank) + 1
    begins -= np.arange(1, len(begins) + 1)  # as many blanks are gone before each
    points = points[~blank]
    ends = np.flatnonzero(points == 0)[::2]
    starts = np.append(0, ends[:-1] + 2)
    words = packed(np.unique(np.concatenate([begins, starts, ends])), np.zeros(1, np.int64))
    names = ["block", "gram", "data", "ids", "starts", "words"]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), x) for x in (ids, pa.array(starts, pa.int32()))]
    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *lists, words], names)
    places = np.flatnonzero(points[:-2])
    found = grams(points)[places]
    order = np.argsort(found, kind="stable")
    found = found[order]
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])
    n = len(first)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(found[first]), packed(places[order], first), *(pa.nulls(n, x.type) for x in lists), pa.nulls(n, pa.binary())], names)


def _blocks(most: int):
    """(id, text) to the rows of blocks, which are numbered within their partition."""

    def run(batches):
        number, ids, texts, size = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in batches:
            some, at = batch.column(1).to_pylist(), 0
            for k, text in enumerate(some):
                size += len(text) + 2
                if size >= most:
                    yield from _block(number, pa.concat_arrays([*ids, batch.column(0).slice(at, k + 1 - at)]), texts + some[at : k + 1])
                    number, ids, texts, size, at = number + 1, [], [], 0, k + 1
            ids.append(batch.column(0).slice(at))
            texts += some[at:]
        if texts:
            yield from _block(number, pa.concat_arrays(ids), texts)

    return run


def _again(table: pa.Table) -> pa.Table:
    """Some blocks, with the places in `live` of their texts that count, as one block. A gram at a place tells the character."""
    number, ids, texts = table.column("into")[0].as_py(), [], []
    own = pc.is_valid(table.column("ids"))
    heads, postings = table.filter(own).to_pylist(), table.filter(pc.invert(own))
    for head in heads:
        words, starts = unpacked(head["words"]), np.array(head["starts"])
        points = np.zeros(int(words[-1]) + 2, np.uint32)
        mine = pc.and_(pc.equal(postings.column("segment"), head["segment"]), pc.equal(postings.column("block"), head["block"]))
        of = postings.filter(mine)
        for gram, data in zip(of.column("gram").to_pylist(), of.column("data").to_pylist(), strict=True):
            points[unpacked(data)] = gram >> (2 * BITS)
        whole, ends = points.tobytes().decode("utf-32-le"), np.append(starts[1:], len(points)) - 2
        for k in sorted(head["live"]):
            edges = [starts[k], *words[(words > starts[k]) & (words < ends[k])], ends[k]]
            ids.append(head["ids"][k])
            texts.append(" ".join(whole[a:b] for a, b in zip(edges, edges[1:], strict=False)))
    return pa.Table.from_batches(list(_block(number, pa.array(ids, table.schema.field("ids").type.value_type), texts)))


def _matches(strings: list[tuple[int, int, str]]):
    """(segment, number, parts, ids, starts, words) to (id, segment, word) of the texts that hold string number `number`."""

    def fits(begins: np.ndarray, string: str, words: np.ndarray) -> np.ndarray:
        """Which of the places where a string's characters stand have the string's blanks, and no others."""
        blanks, at = set(), 0
        for c in string:
            if c == " ":
                blanks.add(at)
            else:
                at += 1
        out = np.ones(len(begins), bool)
        for k in range(at + 1):
            if k in blanks:
                out &= np.isin(begins + k, words)
            elif 0 < k < at:
                out &= ~np.isin(begins + k, words)
        return out

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                segment, number, parts, starts, words = (batch.column(k)[i].as_py() for k in (0, 1, 2, 4, 5))
                word, form, string = strings[number]
                found = [unpacked(p["data"]) - p["k"] for p in parts]
                if len(string.replace(" ", "")) < 3:
                    begins = np.concatenate(found)
                else:
                    begins = reduce(lambda x, y: np.intersect1d(x, y, assume_unique=True), sorted(found, key=len))
                if form == WIDE:
                    begins = begins[fits(begins, string, unpacked(words))]
                texts = np.unique(np.searchsorted(starts, begins, "right") - 1)
                ids = batch.column(3)[i].values.take(pa.array(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array([segment] * len(texts), pa.int32()), pa.array([word] * len(texts), pa.int32())], ["id", "segment", "word"])

    return run


def _bucket(gram: Column) -> Column:
    """By the first two characters, so that all grams that begin with them share a file."""
    return F.pmod(F.xxhash64(F.shiftright(gram, BITS)), F.lit(BUCKETS)).cast("int")


class SearchIndex:
    """An index in a folder that driver and executors share. id_type is the DDL type of ids; ids are not null."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "long", block: int = BLOCK):
        self.spark, self.folder, self.id_type, self.block = spark, folder.rstrip("/"), id_type, block
        self.listed = f"id {id_type}, indexed boolean, segment int"
        self.rows = f"block long, gram long, data binary, ids array<{id_type}>, starts array<int>, words binary"

    def _read(self, name: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(StructType.fromDDL(ddl)).parquet(f"{self.folder}/{name}")
        except AnalysisException:  # nothing was added yet
            return self.spark.createDataFrame([], ddl)

    def _lists(self) -> DataFrame:
        return self._read("texts", self.listed)

    def _postings(self) -> DataFrame:
        return self._read("postings", f"{self.rows}, segment int, bucket int")

    def _next(self) -> int:
        return (self._lists().agg(F.max("segment")).first()[0] or 0) + 1

    def _list(self, ids: DataFrame, indexed: bool, segment: int) -> None:
        ids.select("id", F.lit(indexed).alias("indexed")).write.mode("overwrite").parquet(f"{self.folder}/texts/segment={segment}")

    def _write(self, rows: DataFrame, segment: int) -> None:
        """A segment: its postings, and then the list of the texts that these hold."""
        rows = rows.withColumn("bucket", F.when(F.col("gram").isNull(), BLOCKS).otherwise(_bucket(F.col("gram"))))
        rows.sortWithinPartitions("bucket", "gram", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/segment={segment}")
        own = self._postings().filter((F.col("segment") == segment) & (F.col("bucket") == BLOCKS))
        self._list(own.select(F.explode("ids").alias("id")), True, segment)

    def add(self, docs: DataFrame, id_: str, text: str) -> None:
        """Index the texts, in place of what their ids had before. Ids are unique in docs; a null text is empty."""
        forms = docs.select(F.col(id_).cast(self.id_type).alias("id"), F.coalesce(spaced(F.col(text)), F.lit("")).alias("text"))
        self._write(forms.mapInArrow(_blocks(self.block), self.rows), self._next())

    def remove(self, ids: DataFrame, id_: str) -> None:
        self._list(ids.select(F.col(id_).alias("id")), False, self._next())

    def live(self) -> DataFrame:
        """(id, segment) of the texts that count."""
        latest = self._lists().groupBy("id").agg(F.max(F.struct("segment", "indexed")).alias("l"))
        return latest.filter("l.indexed").select("id", "l.segment")

    def merge(self, folder: str) -> SearchIndex:
        """All that is live, as one segment of a new folder. Blocks below half their size are put together."""
        out = SearchIndex(self.spark, folder, self.id_type, self.block)
        at = ["segment", "block"]
        own = self._postings().filter(F.col("bucket") == BLOCKS)
        live = own.select(*at, F.posexplode("ids").alias("place", "id")).join(self.live(), ["id", "segment"], "left_semi")
        live = live.groupBy(*at).agg(F.collect_list("place").alias("live"))
        own = own.withColumn("size", F.coalesce(F.element_at("starts", -1), F.lit(0)))
        small = own.filter(F.col("size") < self.block // 2).agg(F.sum("size")).first()[0] or 0
        into = F.when(F.col("size") < self.block // 2, -1 - F.pmod(F.xxhash64(*at), F.lit(1 + small // self.block))).otherwise(F.xxhash64(*at) % (1 << 62) + (1 << 62))
        kept = own.join(live, at).withColumn("into", into)
        postings = self._postings().filter(F.col("bucket") != BLOCKS).join(F.broadcast(kept.select(*at, "into")), at)  # a row a block
        fields = ["into", *at, "gram", "data", "ids", "starts", "words", "live"]
        rows = kept.select(fields).unionByName(postings.withColumn("live", F.lit(None).cast("array<int>")).select(fields))
        out._write(rows.groupBy("into").applyInArrow(_again, self.rows), 1)
        return out

    def containing(self, strings: list[tuple[int, int, str]]) -> DataFrame:
        """(id, segment, word) where a string stands in a text's form, for (word, form, string); several strings may share a
        word. Postings of the strings' grams meet, block by block, at the place where the string would begin."""
        asked = []
        for number, (_, _, string) in enumerate(strings):
            string = string.replace(" ", "")
            codes = grams(_points(string + "\0\0")).tolist()
            if len(string) >= 3:
                asked += [(number, k, g, g, len(string) - 2) for k, g in enumerate(codes[: len(string) - 2])]
            else:  # all grams that begin with the string
                asked.append((number, 0, codes[0], codes[0] + (1 << (BITS * (3 - len(string)))) - 1, 1))
        wanted = self.spark.createDataFrame(asked, "number int, k int, low long, high long, n int")  # a query's own size
        postings = self._postings().filter(F.col("bucket") != BLOCKS)
        short = any(low != high for *_, low, high, _ in asked)
        ranges = reduce(lambda x, y: x | y, [F.col("gram").between(low, high) for *_, low, high, _ in asked])
        if not any(high - low >= (1 << (2 * BITS)) - 1 for *_, low, high, _ in asked):  # one character's grams are in all buckets
            buckets = self.spark.createDataFrame([(low,) for *_, low, _, _ in asked], "gram long").select(_bucket(F.col("gram"))).distinct().collect()
            postings = postings.filter(F.col("bucket").isin([r[0] for r in buckets]))
        meets = F.col("p.gram").between(F.col("w.low"), F.col("w.high")) if short else F.col("p.gram") == F.col("w.low")
        rows = postings.filter(ranges).select("segment", "block", "gram", "data").alias("p").join(F.broadcast(wanted).alias("w"), meets)
        parts = rows.groupBy("segment", "block", "number").agg(F.first("n").alias("n"), F.collect_list(F.struct("k", "data")).alias("parts"))
        parts = parts.filter((F.col("n") == 1) | (F.size("parts") == F.col("n"))).drop("n")
        words = F.col("words") if any(form == WIDE for _, form, _ in strings) else F.lit(None).cast("binary").alias("words")
        own = self._postings().filter(F.col("bucket") == BLOCKS).select("segment", "block", "ids", "starts", words)
        met = parts.join(own, ["segment", "block"]).select("segment", "number", "parts", "ids", "starts", "words")
        return met.mapInArrow(_matches(strings), f"id {self.id_type}, segment int, word int")

    def search(self, query: str, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
        """Ids of the texts that hold every word of the query, as search_match() finds them, without reading a text.

        A typed word may stand anywhere in the text without its blanks; an ASCII synonym stands between blanks of the spaced
        form, another one anywhere in it. A blank query gives all texts.
        """
        words = folded_words(query)
        strings = []
        for k, word in enumerate(words):
            strings.append((k, TIGHT, word))
            for s in (synonyms or {}).get(word, []):
                part = " ".join(folded_words(s))
                if part:
                    strings.append((k, WIDE, f" {part} " if part.isascii() else part))
        if not strings:
            return self.live().select("id")
        hits = self.containing(strings).groupBy("id", "segment").agg(F.countDistinct("word").alias("words")).filter(F.col("words") == len(words))
        return hits.join(self.live(), ["id", "segment"], "left_semi").select("id")
