"""Readers of loosely written files. Each gives rows as Spark reads them, in parallel, with bad records kept apart."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

MALFORMED = "malformed"


def delimited(spark: SparkSession, path: str, schema: StructType, sep: str = ",") -> DataFrame:
    """Rows of a file with a header, and the column `malformed`: the text of a short or unreadable line, else null.

    Inner quotes need no escape. An empty file, or a header alone, gives no rows. Spark reads no file for `malformed`
    alone, so select it with another column, or materialize the rows first.
    """
    wide = StructType(list(schema)).add(MALFORMED, StringType())
    return spark.read.schema(wide).csv(path, sep=sep, header=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED, enforceSchema=True)


def records(spark: SparkSession, path: str, schema: StructType, field: str | None = None) -> DataFrame:
    """JSON documents under an explicit schema; `field` names an array whose elements are the rows."""
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select(F.explode(field).alias("row")).select("row.*") if field else raw


def blocks(df: DataFrame, text: str, starts: str) -> DataFrame:
    """(input columns, position, block): pasted text cut before each line that matches `starts`; text before the first
    such line is no block. Null and empty texts give no rows."""
    mark = "\x1e"
    cut = F.split(F.regexp_replace(F.col(text), f"(?m)^(?={starts})", mark), mark)
    return df.select(*[c for c in df.columns if c != text], F.posexplode(cut).alias("position", "block")).filter("position > 0")


def fields(df: DataFrame, block: str, labels: dict[str, str]) -> DataFrame:
    """Append a column for each label of a pasted block: what follows the label and a colon or tab on its line, trimmed; null
    where the label does not occur. labels: new column -> the label's pattern."""
    found = {c: F.nullif(F.trim(F.regexp_extract(block, rf"(?im)^[ \t]*(?:{p})[ \t]*[:\t][ \t]*([^\r\n]*)", 1)), F.lit("")) for c, p in labels.items()}
    return df.withColumns(found)


def packages(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """(path, member, content) of ZIP files; one task holds one member at a time. A broken archive fails the job."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for member in z.infolist():
                        if not member.is_dir():
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member.filename]), pa.array([z.read(member)], pa.binary())], ["path", "member", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, member string, content binary")


def distinct_files(files: DataFrame) -> DataFrame:
    """One row for each content of a binaryFile scan: the least path, with the content's hash."""
    hashed = files.select("path", F.sha2("content", 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.min("path").alias("path"), F.count("*").alias("copies"))
