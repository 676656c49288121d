"""Which of many known strings stand in a text: each text is read once by an automaton, whatever the number of strings.

Strings are dealt to blocks of about BLOCK_BYTES; a task builds a block's automaton as arrays (a row of next states for every
state), so the driver never sees the strings. Texts are cut into segments that overlap by the longest string, and all segments
of a batch take a step at once. A pass over the texts carries PASS_BLOCKS blocks, which bounds what is broadcast at about
PASS_BLOCKS * BLOCK_BYTES * 256 bytes.

More strings than one pass carries are looked up by length instead: of every window of a text that has the length of some
string, those that pass a Bloom filter of all strings meet the strings themselves in a join. So a text is read once for each
length, whatever the number of strings. Only where strings have over LENGTHS lengths, further blocks are further passes.
"""

from __future__ import annotations

import io
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions.text import key_fold
from kelpie.session import stored

BLOCK_BYTES = 24 << 10
PASS_BLOCKS = 8
#: A longer string is found by so many of its bytes, then compared.
HEAD = 256
SEGMENT = 1024
BATCH_BYTES = 4 << 20
#: Lengths of strings for which texts are read by windows, and bytes of texts that are read so at once.
LENGTHS = 64
WINDOW_BYTES = 1 << 20
#: Bits of the filter for each string, its probes, bits of a part of it and of all parts at most; a fuller one lets more pass.
FILTER_BITS, PROBES, PART_BITS, MOST_BITS = 16, 3, 1 << 22, 1 << 29
_BUILT = "block int, k int, string_ string, automaton binary"


class Automaton:
    """Aho-Corasick over bytes: next states, the strings that end in a state and the next shorter state where one ends."""

    FIELDS = ("next", "classes", "first", "ends", "shorter", "tails", "tail_at", "depth")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for f in self.FIELDS:
            setattr(self, f, arrays[f])
        self.width = self.next.shape[1]
        self.flat = self.next.ravel()
        own = np.diff(self.first) > 0
        self.hit = own | (self.shorter > 0)
        self.long = np.diff(self.tail_at)[self.ends] > 0 if len(self.ends) else np.zeros(0, bool)

    @classmethod
    def of(cls, strings: list[bytes]) -> Automaton:
        """strings: different and none empty."""
        used = np.unique(np.frombuffer(b"".join(s[:HEAD] for s in strings), np.uint8))
        classes = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
        classes[used] = np.arange(1, len(used) + 1)
        table = classes.tolist()
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, string in enumerate(strings):
            state = 0
            for byte in string[:HEAD]:
                c = table[byte]
                if (after := children[state].get(c)) is None:
                    children[state][c] = after = len(children)
                    children.append({})
                    ends.append([])
                state = after
            ends[state].append(k)
        n = len(children)
        next_ = np.zeros((n, len(used) + 1), np.uint16 if n < 1 << 16 else np.int32)
        fail, shorter, has = np.zeros(n, np.int64), np.zeros(n, np.int64), np.array([bool(e) for e in ends])
        level = np.zeros(1, np.int64)
        while len(level):  # states of one depth at a time; their fallbacks are less deep
            next_[level] = next_[fail[level]]
            shorter[level] = np.where(has[fail[level]] & (fail[level] > 0), fail[level], shorter[fail[level]])
            edges = [(s, c, t) for s in level.tolist() for c, t in children[s].items()]
            if not edges:
                break
            s, c, t = (np.array(x, np.int64) for x in zip(*edges, strict=True))
            fail[t] = np.where(s > 0, next_[s, c], 0)
            next_[s, c] = t
            level = t
        tails = [s[HEAD:] for s in strings]
        return cls(
            {
                "next": next_, "classes": classes, "first": np.concatenate([[0], np.cumsum([len(e) for e in ends])]), "ends": np.array([k for e in ends for k in e], np.int64),
                "shorter": shorter, "tails": np.frombuffer(b"".join(tails), np.uint8), "tail_at": np.concatenate([[0], np.cumsum([len(x) for x in tails])]),
                "depth": np.array(max(len(s[:HEAD]) for s in strings)),
            }
        )

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Automaton:
        with np.load(io.BytesIO(data)) as arrays:
            return cls(dict(arrays))

    def found(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, string) for each string that stands in a text, each pair once."""
        text, at, state = self._hits(raw, offsets)
        pairs, n = [], len(self.hit)
        if self.long.any():
            pairs.append(self._compared(raw, offsets, text, at, state))
        left = np.unique(text * n + state)
        while len(left):
            text, state = np.divmod(left, n)
            for k in range(int(np.diff(self.first)[state].max(initial=0))):  # strings of one head share a state
                has = self.first[state] + k < self.first[state + 1]
                string = self.ends[self.first[state[has]] + k]
                short = ~self.long[self.first[state[has]] + k]
                pairs.append((text[has][short], string[short]))
            after = self.shorter[state]
            left = np.unique(text[after > 0] * n + after[after > 0])
        text, string = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        n = len(self.tail_at)
        return np.divmod(np.unique(text * n + string), n)

    def _hits(self, raw, offsets):
        """(text, place after, state) wherever some string ends."""
        length = np.diff(offsets)
        count = -(-length // SEGMENT)
        text = np.repeat(np.arange(len(length)), count)
        start = offsets[text] + SEGMENT * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
        begin = np.maximum(start - int(self.depth) + 1, offsets[text])
        steps = np.minimum(start + SEGMENT, offsets[text + 1]) - begin
        order = np.argsort(-steps, kind="stable")
        text, begin, steps = text[order], begin[order], steps[order]
        classes, state = self.classes[raw], np.zeros(len(text), np.int64)
        active = np.searchsorted(-steps, -np.arange(int(steps.max(initial=0))), "left")
        found = []
        for k, m in enumerate(active.tolist()):
            at = begin[:m] + k
            state[:m] = now = self.flat[state[:m] * self.width + classes[at]]
            if len(hit := np.flatnonzero(self.hit[now])):
                found.append((text[hit], at[hit] + 1, now[hit].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def _compared(self, raw, offsets, text, at, state):
        """Strings beyond HEAD: what follows the head is compared at every place."""
        data, tails, out = memoryview(np.ascontiguousarray(raw)), memoryview(self.tails), set()
        for t, a, s in zip(text.tolist(), at.tolist(), state.tolist(), strict=True):
            end = int(offsets[t + 1])
            while s > 0:
                for i in range(int(self.first[s]), int(self.first[s + 1])):
                    k = int(self.ends[i])
                    low, high = int(self.tail_at[k]), int(self.tail_at[k + 1])
                    if high > low and a + high - low <= end and data[a : a + high - low] == tails[low:high]:
                        out.add((t, k))
                s = int(self.shorter[s])
        pairs = np.array(sorted(out), np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def _built(strings: pa.Table) -> pa.Table:
    of = sorted(set(strings["string_"].to_pylist()), key=str.encode)
    n = len(of)
    data = Automaton.of([s.encode() for s in of]).dumped()
    return pa.table({"block": pa.array([strings["block"][0].as_py()] * n, pa.int32()), "k": pa.array(range(n), pa.int32()), "string_": pa.array(of), "automaton": pa.array([data] + [None] * (n - 1), pa.binary())})


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _scan(blocks, names: list[str]):
    """Rows (keys, text) to (keys, number) of every string found; number is the block's, then the string's in it."""

    def run(batches):
        automata = [(block, Automaton.loaded(data)) for block, data in blocks.value]
        for batch in batches:
            raw, off = _utf8(batch.column(len(names)))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(off, off[i] + BATCH_BYTES, "right")) - 1)
                part, local = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                for block, automaton in automata:
                    text, string = automaton.found(part, local)
                    if len(text):
                        rows = batch.take(pa.array(text + i))
                        yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], pa.array((block << 32) + string)], [*names, "number_"])
                i = j

    return run


_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256).astype(np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


class _Spans:
    """Hashes of spans of some bytes, each by two places of a running sum."""

    def __init__(self, raw: np.ndarray):
        powers = [np.full(len(raw) + 1, x, np.uint64) for x in (_STEP, _BACK)]
        for p in powers:
            p[0] = 1
        up, self.down = (np.multiply.accumulate(p) for p in powers)
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[raw] * up[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sum[end] - self.sum[start]) * self.down[start] + (end - start).astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of a filter that strings of these hashes set."""
    return ((h + np.uint64(k) * ((h >> np.uint64(32)) | np.uint64(1))) % np.uint64(bits)).astype(np.int64)


def _places(bits: int):
    def run(batches):
        for batch in batches:
            raw, off = _utf8(batch.column(0))
            h = _Spans(raw).of(off[:-1], off[1:])
            at = np.concatenate([_probe(h, k, bits) for k in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array((at // PART_BITS).astype(np.int32)), pa.array((at % PART_BITS).astype(np.int32))], ["part", "at"])

    return run


def _part(rows: pa.Table) -> pa.Table:
    flag = np.zeros(PART_BITS, np.uint8)
    flag[rows["at"].to_numpy()] = 1
    return pa.table({"part": rows["part"].slice(0, 1), "bits": pa.array([np.packbits(flag, bitorder="little").tobytes()], pa.binary())})


def _passing(raw: np.ndarray, off: np.ndarray, lengths: list[int], bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, end) of the windows that may be known strings, each string once a text."""
    spans, lead = _Spans(raw), np.append((raw & 0xC0) != 0x80, True)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(raw))  # bytes from a place to the end of its text
    starts, ends, hashes = [], [], []
    for n in lengths:
        start = np.flatnonzero((left >= n) & lead[:-1])
        start = start[lead[start + n]]
        h = spans.of(start, start + n)
        for k in range(PROBES):
            at = _probe(h, k, 8 * len(bits))
            ok = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            start, h = start[ok], h[ok]
        starts.append(start)
        ends.append(start + n)
        hashes.append(h)
    start, end, h = (np.concatenate(x) for x in (starts, ends, hashes))
    text = np.searchsorted(off, start, "right") - 1
    order = np.lexsort((h, text))
    text, start, end, h = text[order], start[order], end[order], h[order]
    again = np.zeros(len(text), bool)
    again[1:] = (text[1:] == text[:-1]) & (h[1:] == h[:-1])
    if again.any():  # equal hashes are compared byte for byte
        group = np.cumsum(~again)
        twins = np.isin(group, group[again])
        seen: set[tuple[int, bytes]] = set()
        for k in np.flatnonzero(twins).tolist():
            key = (int(text[k]), raw[start[k] : end[k]].tobytes())
            again[k] = key in seen
            seen.add(key)
    return text[~again], start[~again], end[~again]


def _windows(filter_, lengths: list[int], names: list[str]):
    """Rows (keys, text) to (keys, string) of the windows that pass the filter."""

    def run(batches):
        bits = np.concatenate([np.frombuffer(x, np.uint8) for x in filter_.value])
        for batch in batches:
            raw, off = _utf8(batch.column(len(names)))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(off, off[i] + WINDOW_BYTES, "right")) - 1)
                part = raw[off[i] : off[j]]
                text, start, end = _passing(part, off[i : j + 1] - off[i], lengths, bits)
                if len(text):
                    size = end - start
                    upto = np.cumsum(size)
                    data = part[np.arange(upto[-1]) + np.repeat(start - upto + size, size)]
                    strings = pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer(np.append(0, upto).tobytes()), pa.py_buffer(data.tobytes())])
                    rows = batch.take(pa.array(text + i))
                    yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], strings.cast(pa.string())], [*names, "string_"])
                i = j

    return run


def _by_windows(out: DataFrame, keys: list[str], wanted: DataFrame, lengths: list[int]) -> DataFrame:
    spark, distinct = out.sparkSession, wanted.select("string_").distinct()
    parts = max(1, min(MOST_BITS, distinct.count() * FILTER_BITS) // PART_BITS + 1)
    places = distinct.mapInArrow(_places(parts * PART_BITS), "part int, at int").distinct()
    empty = bytes(PART_BITS // 8)
    built = {r["part"]: bytes(r["bits"]) for r in places.groupBy("part").applyInArrow(_part, "part int, bits binary").toLocalIterator()}
    filter_ = spark.sparkContext.broadcast([built.get(k, empty) for k in range(parts)])  # two bytes a string, MOST_BITS at most
    found = out.mapInArrow(_windows(filter_, lengths, keys), out.select(*keys).schema.add("string_", "string"))
    return found.join(wanted, "string_").drop("string_")


def contained(texts: DataFrame, keys: list[str], text: Column, known: DataFrame, string: Column, carry: list[Column]) -> DataFrame:
    """(keys, carry) for each row of texts and each row of known whose string stands in the text, byte for byte.

    Null and empty strings stand nowhere; null texts hold none. Rows that repeat in texts or known repeat in the result.
    Either side may be empty. The work is one pass over the texts, and one look at each place for every length of string where
    these are more than one pass carries; see the module.
    """
    wanted = known.select(*carry, string.cast("string").alias("string_")).filter("string_ <> ''")
    total = wanted.agg(F.sum(F.octet_length("string_"))).first()[0]
    out = texts.select(*keys, text.cast("string").alias("text_")).filter("text_ is not null")
    if total is None:
        return out.join(wanted, F.lit(False)).select(*keys, *[c for c in wanted.columns if c != "string_"])
    n = -(-total // BLOCK_BYTES)
    if n > PASS_BLOCKS:
        lengths = [r[0] for r in wanted.select(F.octet_length("string_")).distinct().limit(LENGTHS + 1).collect()]
        if len(lengths) <= LENGTHS:
            return _by_windows(out, keys, wanted, sorted(lengths))
    dealt = wanted.select(F.pmod(F.xxhash64("string_"), F.lit(n)).cast("int").alias("block"), "string_").distinct()
    built = stored(dealt.groupBy("block").applyInArrow(_built, _BUILT), "automata")
    spark, passes = texts.sparkSession, []
    ddl = out.select(*keys).schema.add("number_", "long")
    for at in range(0, n, PASS_BLOCKS):
        rows = built.filter(F.col("block").between(at, at + PASS_BLOCKS - 1) & F.col("automaton").isNotNull()).select("block", "automaton").collect()
        if rows:
            blocks = spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in rows])  # of bounded size: see the module
            passes.append(out.mapInArrow(_scan(blocks, keys), ddl))
    hits = reduce(DataFrame.unionByName, passes)
    number = (F.shiftleft(F.col("block").cast("long"), 32) + F.col("k")).alias("number_")
    named = built.select(number, "string_").join(wanted, "string_").drop("string_")
    return hits.join(named, "number_").drop("number_")


def longest_contained(texts: DataFrame, keys: list[str], text: Column, known: DataFrame, number: Column) -> DataFrame:
    """(keys, number, found): the longest of the known numbers in a text; number is null where several are longest, and found
    lists these in order. Rows without any are left out; length counts characters."""
    hits = contained(texts, keys, text, known.select(number.alias("n_")).distinct(), F.col("n_"), [F.col("n_").alias("number")])
    of_length = hits.groupBy(*keys, F.char_length("number").alias("n_")).agg(F.collect_set("number").alias("all_"))
    ties = of_length.groupBy(*keys).agg(F.array_sort(F.max_by("all_", "n_")).alias("found"))
    return ties.select(*keys, F.when(F.size("found") == 1, F.element_at("found", 1)).alias("number"), "found")


def outermost(all_: Column) -> Column:
    """The strings of an array that stand in no longer one of it."""
    return F.filter(all_, lambda n: ~F.exists(all_, lambda m: (F.length(m) > F.length(n)) & F.contains(m, n)))


def identified(files: DataFrame, keys: list[str], name: str, text: str, known: DataFrame, number: str, least: int = 12) -> DataFrame:
    """(keys, number, found, source): the known number that a file is about. keys are unique in files and not null.

    First the longest number that stands in the file's name, case aside; else the only one that stands there once separators
    are left out on both sides, if it keeps `least` letters and digits and is not part of another such one; else the longest
    in the text. Where a step finds several, number is null and found lists them; but several by the second step give way to
    the text first. Files without any number are left out.
    """
    numbers = known.select(F.upper(number).alias("n_")).filter("n_ <> ''").distinct()
    by_name = longest_contained(files, keys, F.upper(name), numbers, F.col("n_")).withColumn("source", F.lit("name"))
    by_name = stored(by_name, "numbers-in-names")
    folded = numbers.withColumn("f_", key_fold(F.col("n_"))).filter(F.char_length("f_") >= least)
    left = files.join(by_name, keys, "left_anti")
    squashed = contained(left, keys, key_fold(F.col(name)), folded, F.col("f_"), [F.col("n_"), F.col("f_")])
    squashed = squashed.groupBy(*keys).agg(F.collect_set(F.struct("f_", "n_")).alias("all_"))
    outer = F.filter("all_", lambda x: ~F.exists("all_", lambda y: (F.length(y["f_"]) > F.length(x["f_"])) & F.contains(y["f_"], x["f_"])))
    squashed = squashed.select(*keys, F.array_sort(F.transform(outer, lambda x: x["n_"])).alias("found"))
    squashed = squashed.select(*keys, F.when(F.size("found") == 1, F.element_at("found", 1)).alias("number"), "found", F.lit("squashed name").alias("source"))
    squashed = stored(squashed, "squashed-names")
    sure = squashed.filter("number is not null")
    by_text = longest_contained(left.join(sure, keys, "left_anti"), keys, F.upper(text), numbers, F.col("n_")).withColumn("source", F.lit("text"))
    by_text = stored(by_text, "numbers-in-texts")
    unsure = squashed.filter("number is null").join(by_text, keys, "left_anti")
    return by_name.unionByName(sure).unionByName(by_text).unionByName(unsure)
