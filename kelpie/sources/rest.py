"""Data sources of paged JSON services. Simple comparisons go to the server; every row that the server has is read.

    spark.dataSource.register(PagedRest)
    spark.read.format("paged_rest").schema(ddl).option("url", u).option("pages", 20).load().filter("day >= '2026-01-01'")

Options of paged_rest: url; rows (a page's size, default 1000); pages (how many page windows are read side by side, default
1; the last one reads on until a page is short, so the number is no limit); order; timeout (seconds); stop_before with
stop_column (a walk in descending order ends at the first row below this value, and rows below it are left out); keys with
key_column (comma-separated references, asked for in batches of key_batch, default 50). The server takes `$limit`,
`$offset`, `$order` and `$where`.

Options of ckan: url; resource; rows; timeout. The number of rows that the service tells gives the partitions.

Both need spark.sql.python.filterPushdown.enabled for pushed filters.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _quoted(value: str | float) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def condition(f: Filter) -> str | None:
    """The server's form of a filter on a plain column with a text or number, or None."""
    sign = _SIGNS.get(type(f))
    if sign is None or len(f.attribute) != 1 or isinstance(f.value, bool) or not isinstance(f.value, (str, int, float)):
        return None
    return f"{f.attribute[0]} {sign} {_quoted(f.value)}"


def ask(url: str, timeout: float, **asked):
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(asked)}", timeout=timeout) as answer:
        return json.load(answer)


def latest(url: str, column: str, timeout: float = 30.0):
    """The server's own max(column): nothing else is read."""
    rows = ask(url, timeout, **{"$select": f"max({column}) as latest"})
    return rows[0].get("latest") if rows else None


class PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.url, self.order = options["url"], options.get("order", schema.names[0])
        self.pages, self.rows, self.timeout = int(options.get("pages", 1)), int(options.get("rows", 1000)), float(options.get("timeout", 30))
        self.stop_column, self.stop_before = options.get("stop_column"), options.get("stop_before")
        keys, size = [k for k in options.get("keys", "").split(",") if k], int(options.get("key_batch", 50))
        self.batches = [keys[k : k + size] for k in range(0, len(keys), size)]
        self.key_column = options.get("key_column")
        self.where: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if (c := condition(f)) is not None:
                self.where.append(c)
            else:
                yield f

    def partitions(self):
        if self.key_column:
            return [InputPartition((0, tuple(b))) for b in self.batches]
        return [InputPartition((k, None)) for k in range(1 if self.stop_before else self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, keys = partition.value
        last = keys is not None or self.stop_before or page == self.pages - 1
        where = list(self.where)
        if keys is not None:
            where.append(f"{self.key_column} in ({', '.join(_quoted(k) for k in keys)})")
        while True:
            asked = {"$limit": self.rows, "$offset": page * self.rows, "$order": self.order}
            if where:
                asked["$where"] = " AND ".join(where)
            rows = ask(self.url, self.timeout, **asked)
            for row in rows:
                if self.stop_before and str(row.get(self.stop_column) or "") < self.stop_before:
                    return
                yield tuple(row.get(n) for n in self.names)
            page += 1
            if len(rows) < self.rows or not last:
                return


class PagedRest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, dict(self.options))


class CkanReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.url, self.resource = schema.names, options["url"].rstrip("/"), options["resource"]
        self.rows, self.timeout = int(options.get("rows", 1000)), float(options.get("timeout", 30))

    def _records(self, offset: int, limit: int) -> dict:
        answer = ask(f"{self.url}/api/3/action/datastore_search", self.timeout, resource_id=self.resource, limit=limit, offset=offset)
        if not answer.get("success"):
            raise RuntimeError(f"the service refused: {answer.get('error')}")
        return answer["result"]

    def partitions(self):
        total = int(self._records(0, 0).get("total", 0))
        return [InputPartition(k) for k in range(0, max(total, 1), self.rows)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in self._records(partition.value, self.rows).get("records", []):
            yield tuple(row.get(n) for n in self.names)


class Ckan(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ckan"

    def reader(self, schema: StructType) -> CkanReader:
        return CkanReader(schema, dict(self.options))
