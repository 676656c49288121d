"""Writers of reports. A folder of part files is what a cluster writes; each part has a header of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV as RFC 4180 has it: fields with quotes, commas or line breaks are quoted, quotes are doubled. Nulls are empty."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, null fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def document(df: DataFrame, name: str) -> DataFrame:
    """One row with all rows as one JSON document: for reports, whose size is that of a page."""
    return df.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))).alias("document"))
