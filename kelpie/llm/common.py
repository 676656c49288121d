"""Helpers that the training-data operators share: storage between jobs and word hashing in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SHARED_DIR = "/tmp/checkpoints/kelpie"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or f"file://{DEFAULT_SHARED_DIR}").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kelpie/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def finished_shuffles_go(spark: SparkSession):
    """Queries that run inside leave no shuffle files behind when they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: it cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with finished_shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once no later step reads it."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, by: int):
    """crc32 of the id as text, modulo `by`: the fold of a document."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


# --- text of an Arrow batch as bytes -------------------------------------------------------------------------------


def utf8_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int):
    """Ranges of rows whose bytes together stay under `most`; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start[i], start[i] + 1, ... of each range, count[i] of them, in a row."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - start, count)


# --- words and their hashes ----------------------------------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(keep) -> np.ndarray:
    """A table of 256 flags: is this byte part of a word?"""
    return np.array([bool(keep(b)) for b in range(256)])


#: Words between white space: the word pattern [^\x20\x09-\x0D]+ on UTF-8 bytes.
NON_SPACE = byte_class(lambda b: not (b == 0x20 or 9 <= b <= 13))
#: Letters, digits and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of words; first[i] is the number of words before row i. No word crosses a row."""
    flag = np.zeros(len(raw) + 2, np.int8)
    flag[1:-1] = keep[raw]
    step = np.diff(flag)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(raw))])
    cut = inner[keep[raw[inner - 1]] & keep[raw[inner]]] if len(inner) else inner
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, offsets)


def running_sums(raw: np.ndarray) -> np.ndarray:
    """The polynomial sum of the bytes before each place."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    terms = raw.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _power_tables(len(raw) + 1)[0][: len(raw)]
    np.cumsum(terms, out=sums[1:])
    return sums


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running polynomial sum over the buffer (`sums`, where it is there already)."""
    sums = running_sums(raw) if sums is None else sums
    return mix64((sums[end] - sums[start]) * _power_tables(len(raw) + 1)[1][start] + (end - start).astype(np.uint64))


def crc32(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def quiet_threads() -> None:
    """One thread a task: Spark gives each task one core."""
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(k, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def give_back() -> None:
    """Return freed memory to the system: Spark keeps worker processes, and what one task has used would stay with them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def annotate(docs: DataFrame, compute, fields: str, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Append what compute(text column of an Arrow batch) gives to each row; no shuffle, one pass.

    fields is the DDL of the appended columns; compute returns their Arrow arrays in order. carry lists the input columns
    to keep (default: all). An input column with the name of an appended one is replaced by it. A kept text goes to Python
    once.
    """
    added = docs.sparkSession.createDataFrame([], fields).schema
    names = [f.name for f in added]
    kept = [c for c in (docs.columns if carry is None else carry) if c not in names]
    schema = type(added)([docs.schema[c] for c in kept] + list(added))
    columns, at = [F.col(f"`{c}`") for c in kept], len(kept)
    if text_col in kept and docs.schema[text_col].dataType.simpleString() == "string":
        at = kept.index(text_col)
    else:
        columns.append(F.col(f"`{text_col}`").cast("string").alias("".join(kept) + "text"))  # a name that no other column has

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *compute(batch.column(at))], [*kept, *names])
        give_back()

    return docs.select(*columns).mapInArrow(run, schema)
