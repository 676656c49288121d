"""Token-id files: ORC with integer run-length encoding, row indexes and Bloom filters on document ids.

write_token_files range-partitions the documents by id, encodes each and writes one sorted ORC file a partition. ORC
run-length encodes the ids, keeps min/max statistics for every stripe and row group and a Bloom filter on the id column.
read_token_files reads stripes in parallel; lookup() prunes stripes and row groups by those statistics before it reads.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.llm.common import crc32, materialize, new_path, table
from kelpie.llm.tokens import END_ID, encoder, vocabulary_path

ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(8 << 20), "compression": "zstd"}
STORED = "doc_id long, at long, ids array<int>"
PARTITION_BYTES = 32 << 20


def _encode(path: str, end_id: int):
    def run(batches):
        enc = encoder(path)
        tail = end_id.to_bytes(4, "little")
        for batch in batches:
            ids, texts, at_ = batch.columns
            for i in range(0, len(texts), 256):
                each = [enc.encode(t) + tail for t in texts.slice(i, 256).to_pylist()]
                offsets, at = [0], 0
                for x in each:
                    at += len(x) // 4
                    offsets.append(at)
                values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(each))])
                yield pa.RecordBatch.from_arrays([ids.slice(i, 256), at_.slice(i, 256), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], ["doc_id", "at", "ids"])

    return run


def _partitions(docs: DataFrame) -> int:
    """Enough range partitions for about PARTITION_BYTES of text each, and at least the session's cores."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // PARTITION_BYTES)))


def write_token_files(docs: DataFrame, path: str, *, vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append end_id and write ORC files in ascending order of document ids.

    A null or empty text becomes the end id alone. Repeated ids are kept, each as a row; where
    one id, or no id, has very many rows, their texts' hashes deal them to several files. Rows whose id is null come first. Other columns are ignored, whatever their names. An empty table gives files without rows.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ordered = slim.repartitionByRange(_partitions(slim), F.asc_nulls_first("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    ordered = ordered.withColumn("at", F.monotonically_increasing_id())  # the row's place in the order of all files
    encoded = ordered.mapInArrow(_encode(vocabulary or vocabulary_path(), end_id), STORED)
    encoded.write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; the id filter is pushed to ORC, which skips stripes by statistics and Bloom filters."""
    return read_token_files(spark, path).filter(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _digest(batches):
    for batch in batches:
        ids, at, lists, file = batch.columns
        values, off = memoryview(lists.values.buffers()[1] or b""), (lists.offsets.to_numpy() + lists.values.offset) * 4
        spans = list(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays(
            [ids, at, file, pa.array([(b - a) // 4 for a, b in spans], pa.int64()), pa.array([crc32(values[a:b]) for a, b in spans], pa.int64())],
            ["doc_id", "at", "file", "n_tokens", "ids_crc32"],
        )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document as the files hold it: doc_id, start (ids before it in the whole), n_tokens, ids_crc32.

    Every row has its place in the order of all files, so rows that share an id start where the files hold them. A running sum
    inside each file, plus the totals of the files before it, gives the global start; nothing but one total a file is gathered.
    """
    rows = read_token_files(spark, path).select("doc_id", "at", "ids", F.input_file_name().alias("file"))
    rows = materialize(rows.mapInArrow(_digest, "doc_id long, at long, file string, n_tokens long, ids_crc32 long"), "token-index")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("at").alias("low"))
    before = W.orderBy("low").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(files, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_index(spark, path)


QUERIES = {"op9_token_files": op9_token_files}
ORACLE: dict[str, str] = {}
