"""Rows from XML files, feeds and the tables, lists and data of web pages. What cannot be read is kept apart, not lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from kelpie.functions.text import html_text, read_text, untagged

MALFORMED = "malformed"
_LINK = "struct<_href:string,_rel:string,_VALUE:string>"
_ITEM = "title string, link string, guid string, pubDate string, description string"
_ENTRY = f"title string, link array<{_LINK}>, id string, updated string, summary string"


def xml_records(spark: SparkSession, path: str, row_tag: str, schema: StructType) -> DataFrame:
    """A row for each element `row_tag` of XML files, and `malformed`: the element's text where it is broken, else null.

    Attributes are fields that begin with an underscore. Large files are split, so no task reads more than its share; the
    parser chosen goes on after a broken element.
    """
    wide = StructType(list(schema)).add(MALFORMED, StringType())
    return spark.read.schema(wide).format("xml").options(rowTag=row_tag, mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED, useLegacyXMLParser=True).load(path)


def parsed_xml(df: DataFrame, column: str, ddl: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose column is an XML document, with its fields as the struct `name`; and the rows where it is not.
    A null is neither."""
    schema = f"{ddl}, {MALFORMED} string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}
    read = df.filter(F.col(column).isNotNull()).withColumn(name, F.from_xml(F.col(column), schema, options))
    broken = F.col(f"{name}.{MALFORMED}").isNotNull() | F.col(name).isNull()
    return read.filter(~broken).withColumn(name, F.col(name).dropFields(MALFORMED)), read.filter(broken).drop(name)


def feed_items(df: DataFrame, keys: list[str], column: str) -> tuple[DataFrame, DataFrame]:
    """(items, bad): a row (keys, position, title, link, id, published, summary) for each item of RSS and Atom documents, and
    the rows whose document is broken. Dates stay as they are written; an item without an id has its link."""
    good, bad = parsed_xml(df, column, f"channel struct<item:array<struct<{_ddl(_ITEM)}>>>, entry array<struct<{_ddl(_ENTRY)}>>", "feed_")
    rss = F.transform(
        "feed_.channel.item",
        lambda x: F.struct(x["title"].alias("title"), x["link"].alias("link"), F.coalesce(x["guid"], x["link"]).alias("id"), x["pubDate"].alias("published"), x["description"].alias("summary")),
    )

    def entry(x):
        own = F.filter(x["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
        link = F.try_element_at(F.transform(own, lambda k: k["_href"]), F.lit(1))
        return F.struct(x["title"].alias("title"), link.alias("link"), F.coalesce(x["id"], link).alias("id"), x["updated"].alias("published"), x["summary"].alias("summary"))

    items = F.coalesce(rss, F.transform("feed_.entry", entry))
    return good.select(*keys, F.posexplode(items).alias("position", "item_")).select(*keys, "position", "item_.*"), bad


def _ddl(fields: str) -> str:
    return ",".join(":".join(f.split(" ", 1)) for f in fields.split(", "))


def _parts(text: Column, tag: str) -> Column:
    """Each such tag with all up to the next one or its end; what follows is looked at where a tag may begin."""
    return F.regexp_extract_all(text, F.lit(rf"(?is)(<{tag}\b[^>]*+>[^<]*+(?:<(?!{tag}\b|/{tag})[^<]*+)*+)"), F.lit(1))


def _tables(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, grid, rows_): the rows of each table, as they are written."""
    tables = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(column), F.lit(r"(?is)<table\b[^>]*+>([^<]*+(?:<(?!/table)[^<]*+)*+)"), F.lit(1))).alias("grid", "t_"))
    return tables.select(*keys, "grid", _parts(F.col("t_"), "tr").alias("rows_"))


def _cells(row: Column) -> Column:
    return _parts(row, "t[dh]")


def grid(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, grid, row, cell, header, text) of the tables of HTML pages, which need not be well formed: rows and cells end
    where the next one begins. Numbers begin at 0; tables inside tables are read as rows of the outer one."""
    rows = _tables(df, keys, column).select(*keys, "grid", F.posexplode("rows_").alias("row", "r_"))
    cells = rows.select(*keys, "grid", "row", F.posexplode(_cells(F.col("r_"))).alias("cell", "c_"))
    return cells.select(*keys, "grid", "row", "cell", F.col("c_").rlike("(?i)^<th").alias("header"), html_text(F.col("c_")).alias("text"))


def named_rows(cells: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """(keys, grid, row, names): a table's rows by the headers of its first row. names: new column -> the header's pattern; of
    several headers that match, the first; a missing cell is null."""
    by_row = cells.groupBy(*keys, "grid", "row").agg(F.map_from_entries(F.collect_list(F.struct("cell", "text"))).alias("cells_"), F.bool_and("header").alias("head_"))
    head = by_row.filter("row = 0 and head_").select(*keys, "grid", F.array_sort(F.map_entries("cells_")).alias("h_"))

    def place(pattern: str) -> Column:
        return F.try_element_at(F.filter("h_", lambda x: x["value"].rlike(f"(?i){pattern}")), F.lit(1))["key"]

    body = by_row.filter("row > 0").join(head, [*keys, "grid"])
    return body.select(*keys, "grid", "row", *[F.try_element_at(F.col("cells_"), place(p)).alias(n) for n, p in names.items()])


def table_rows(df: DataFrame, keys: list[str], column: str, names: dict[str, str]) -> DataFrame:
    """The same as named_rows() of grid(), but where the pages lie: no cell is sent, and only cells that are named are read."""
    headed = _tables(df, keys, column).withColumn("head_", _cells(F.get("rows_", F.lit(0))))
    plain = (F.size("head_") > 0) & F.forall("head_", lambda c: c.rlike("(?i)^<th"))
    read = headed.select(*keys, "grid", F.when(plain, F.col("rows_")).alias("rows_"), F.when(plain, F.transform(F.transform("head_", untagged), read_text)).alias("h_"))

    def place(pattern: str) -> Column:
        first = F.filter(F.transform("h_", lambda x, k: F.when(x.rlike(f"(?i){pattern}"), k)), lambda k: k.isNotNull())
        return F.get(first, F.lit(0))

    found = read.select(*keys, "grid", "rows_", *[place(p).alias(f"p{k}_") for k, p in enumerate(names.values())])
    rows = found.select(*keys, "grid", F.posexplode("rows_").alias("row", "r_"), *[f"p{k}_" for k in range(len(names))]).filter("row > 0")
    rows = rows.withColumn("c_", _cells(F.col("r_"))).filter(F.size("c_") > 0)
    return rows.select(*keys, "grid", "row", *[html_text(F.get("c_", F.col(f"p{k}_"))).alias(n) for k, n in enumerate(names)])


def embedded_json(df: DataFrame, column: str, ddl: str, name: str, kind: str = "application/(?:ld\\+)?json") -> DataFrame:
    """df with `name`: the documents of a page's data scripts, an array of structs; null where one does not parse."""
    scripts = F.regexp_extract_all(F.col(column), F.lit(rf"(?is)<script\b[^>]*type=[\x22']{kind}[\x22'][^>]*+>((?:(?!</script).)*+)"), F.lit(1))
    return df.withColumn(name, F.transform(scripts, lambda s: F.from_json(s, ddl)))
