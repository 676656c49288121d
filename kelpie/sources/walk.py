"""A walk over a service's listing that goes on where it stopped, and a sink that upserts rows in batches.

    spark.dataSource.register(PortalWalk)
    spark.readStream.format("portal_walk").schema(ddl).option("url", u).option("cursor", "updated").option("key", "id").load()
    spark.dataSource.register(UpsertRest)
    latest(df, ["id"], "updated").write.format("upsert_rest").option("url", u).option("key", "id").mode("append").save()

The walk's offset is the last row taken, by cursor column and key, not a page number: rows that appear or move between two
visits neither shift a page nor are read twice, and a row that changes again comes again with its later cursor. Options of
portal_walk: url, cursor, key, rows (a request's size, default 500), share (rows of a partition, default 5000), tries (default
4), wait (seconds before the second try, doubled each time), timeout, start (a JSON offset to begin after).

Options of upsert_rest: url, key, rows (default 500), tries, wait, timeout. A batch is one request, so the service takes it
whole or not at all; it carries the hash of its rows, and sending it again changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from kelpie.sources.rest import _quoted, ask

BUSY = (408, 425, 429, 500, 502, 503, 504)


def patient(call, tries: int, wait: float):
    """call(), again after a pause where the service is busy or the line drops; other refusals are not repeated."""
    for k in range(tries):
        try:
            return call()
        except urllib.error.HTTPError as error:
            if error.code not in BUSY or k == tries - 1:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if k == tries - 1:
                raise
        time.sleep(wait * 2**k)


class WalkReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.url = schema.names, options["url"]
        self.cursor, self.key = options["cursor"], options["key"]
        self.rows, self.share = int(options.get("rows", 500)), int(options.get("share", 5000))
        self.tries, self.wait, self.timeout = int(options.get("tries", 4)), float(options.get("wait", 1)), float(options.get("timeout", 30))
        self.start = json.loads(options.get("start", "{}"))

    def _ask(self, after: dict, upto: dict, limit: int, skip: int = 0, falling: bool = False) -> list[dict]:
        def side(at: dict, sign: str, equal: str) -> str:
            c, k = _quoted(at["cursor"]), _quoted(at["key"])
            return f"({self.cursor} {sign} {c} OR ({self.cursor} = {c} AND {self.key} {equal} {k}))"

        where = [side(after, ">", ">")] if after else []
        where += [side(upto, "<", "<=")] if upto else []
        order = ", ".join(f"{c} DESC" if falling else c for c in (self.cursor, self.key))
        asked = {"$limit": limit, "$offset": skip, "$order": order} | ({"$where": " AND ".join(where)} if where else {})
        return patient(lambda: ask(self.url, self.timeout, **asked), self.tries, self.wait)

    def _offset(self, row: dict) -> dict:
        return {"cursor": row[self.cursor], "key": row[self.key]}

    def initialOffset(self) -> dict:
        return self.start

    def latestOffset(self) -> dict:
        last = self._ask({}, {}, 1, falling=True)
        return self._offset(last[0]) if last else self.start

    def partitions(self, start: dict, end: dict):
        """Borders every `share` rows; they are found by asking for single rows."""
        out = []
        while end and start != end:
            border = self._ask(start, end, 1, self.share - 1)
            upto = self._offset(border[0]) if border else end
            out.append(InputPartition((start, upto)))
            start = upto
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        after, upto = partition.value
        while rows := self._ask(after, upto, self.rows):
            for row in rows:
                yield tuple(row.get(n) for n in self.names)
            after = self._offset(rows[-1])
            if len(rows) < self.rows:
                return

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch that is done."""


class PortalWalk(DataSource):
    @classmethod
    def name(cls) -> str:
        return "portal_walk"

    def streamReader(self, schema: StructType) -> WalkReader:
        return WalkReader(schema, dict(self.options))


@dataclass
class Sent(WriterCommitMessage):
    batches: int
    rows: int


class _Upserts:
    def __init__(self, schema: StructType, options: dict):
        self.names, self.url, self.key = schema.names, options["url"], options["key"]
        self.size, self.tries = int(options.get("rows", 500)), int(options.get("tries", 4))
        self.pause, self.timeout = float(options.get("wait", 1)), float(options.get("timeout", 30))
        if self.key not in self.names:
            raise ValueError(f"no column {self.key}")

    def _send(self, rows: list[dict]) -> None:
        body = json.dumps(rows, default=str, sort_keys=True).encode()
        head = {"Content-Type": "application/json", "Idempotency-Key": hashlib.sha256(body).hexdigest(), "On-Conflict": self.key}

        def call():
            with urllib.request.urlopen(urllib.request.Request(self.url, body, head, method="POST"), timeout=self.timeout) as answer:
                answer.read()

        patient(call, self.tries, self.pause)

    def write(self, iterator) -> Sent:
        batch, batches, rows = [], 0, 0
        for row in iterator:
            batch.append(row.asDict(recursive=True))
            if len(batch) == self.size:
                self._send(batch)
                batch, batches, rows = [], batches + 1, rows + len(batch)
        if batch:
            self._send(batch)
            batches, rows = batches + 1, rows + len(batch)
        return Sent(batches, rows)


class UpsertWriter(_Upserts, DataSourceWriter):
    def commit(self, messages) -> None:
        """All tasks are done; what they sent stands."""

    def abort(self, messages) -> None:
        """Batches that were sent stand whole; the next run sends them again, to the same effect."""


class UpsertStreamWriter(_Upserts, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:
        """As for a table."""

    def abort(self, messages, batchId: int) -> None:
        """As for a table."""


class UpsertRest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "upsert_rest"

    def writer(self, schema: StructType, overwrite: bool) -> UpsertWriter:
        if overwrite:
            raise ValueError("rows are upserted: use append")
        return UpsertWriter(schema, dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> UpsertStreamWriter:
        return UpsertStreamWriter(schema, dict(self.options))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key, all of a key in one task, so that two batches never write one key in either order."""
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(order, *df.columns)).alias("row_"))
    return newest.select("row_.*")
