"""A walk that is stopped and goes on, and upserts that fail midway, against a small service."""

from __future__ import annotations

import json
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from kelpie.sources.walk import PortalWalk, UpsertRest, latest


class Service:
    """Rows in SQLite behind GET with $where, $order, $limit, $offset, and POST that upserts a batch in one transaction."""

    def __init__(self):
        self.db = sqlite3.connect(":memory:", check_same_thread=False)
        self.db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, updated TEXT, v TEXT)")
        self.lock, self.asked, self.refuse, self.batches = threading.Lock(), 0, [], []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *a):
                pass

            def answer(self, code, value):
                body = json.dumps(value).encode()
                self.send_response(code)
                self.end_headers()
                self.wfile.write(body)

            def do_GET(self):
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                with outer.lock:
                    outer.asked += 1
                    if outer.refuse and outer.asked in outer.refuse:
                        return self.answer(429, {})
                    rows = outer.db.execute(f"SELECT id, updated, v FROM t WHERE {q.get('$where', '1')} ORDER BY {q['$order']} LIMIT {q['$limit']} OFFSET {q['$offset']}").fetchall()
                return self.answer(200, [{"id": a, "updated": b, "v": c} for a, b, c in rows])

            def do_POST(self):
                rows = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with outer.lock:
                    outer.asked += 1
                    if outer.asked in outer.refuse:
                        return self.answer(400 if -1 in outer.refuse else 503, {})
                    outer.batches.append((len(rows), self.headers["Idempotency-Key"]))
                    outer.put([(r["id"], r["updated"], r["v"]) for r in rows])
                return self.answer(200, {})

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}/t"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def put(self, rows):
        with self.db:
            self.db.executemany("INSERT INTO t VALUES (?, ?, ?) ON CONFLICT (id) DO UPDATE SET updated = excluded.updated, v = excluded.v", rows)


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def test_walk_goes_on(spark, service, tmp_path):
    spark.dataSource.register(PortalWalk)
    service.put([(k, f"2026-01-{1 + k % 3:02d}", f"a{k}") for k in range(57)])
    service.refuse = [3, 4, 9]  # busy now and then

    def visit():
        stream = spark.readStream.format("portal_walk").schema("id long, updated string, v string").options(url=service.url, cursor="updated", key="id", rows=4, share=10, wait=0.01).load()
        job = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        job.awaitTermination()
        return sorted((r.id, r.updated, r.v) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    first = [(k, f"2026-01-{1 + k % 3:02d}", f"a{k}") for k in range(57)]
    assert visit() == sorted(first)
    assert visit() == sorted(first)  # nothing new
    changed = [(5, "2026-01-04", "moved"), (100, "2026-01-03", "new")]  # a row moves to the end, one appears
    service.put(changed)
    assert visit() == sorted(first + changed)


def test_empty_service(spark, service, tmp_path):
    spark.dataSource.register(PortalWalk)
    stream = spark.readStream.format("portal_walk").schema("id long, updated string, v string").options(url=service.url, cursor="updated", key="id").load()
    job = stream.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    assert job.exception() is None


def rows_of(spark, n):
    frame = spark.range(n).select("id", F.lit("2026-01-01").alias("updated"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    return frame.unionByName(frame.withColumn("updated", F.lit("2025-01-01")).withColumn("v", F.lit("old"))).repartition(3)


def stored(service):
    return dict(service.db.execute("SELECT id, v FROM t").fetchall())


def test_upserts_in_batches(spark, service):
    spark.dataSource.register(UpsertRest)
    service.refuse = [2]  # one batch is sent again
    save = lambda: latest(rows_of(spark, 103), ["id"], "updated").write.format("upsert_rest").options(url=service.url, key="id", rows=10, wait=0.01).mode("append").save()
    save()
    assert stored(service) == {k: f"v{k}" for k in range(103)}
    assert all(n <= 10 for n, _ in service.batches)
    save()
    assert stored(service) == {k: f"v{k}" for k in range(103)}


def test_a_task_that_dies_leaves_whole_batches(spark, service):
    spark.dataSource.register(UpsertRest)
    service.refuse = [3, -1]  # refused for good: the job fails midway
    with pytest.raises(Exception, match="400|Bad"):
        latest(rows_of(spark, 100), ["id"], "updated").coalesce(1).write.format("upsert_rest").options(url=service.url, key="id", rows=10, wait=0.01).mode("append").save()
    assert len(stored(service)) == 20
    service.refuse = []
    latest(rows_of(spark, 100), ["id"], "updated").write.format("upsert_rest").options(url=service.url, key="id", rows=10).mode("append").save()
    assert stored(service) == {k: f"v{k}" for k in range(100)}


def test_upserts_of_a_stream(spark, service, tmp_path):
    spark.dataSource.register(UpsertRest)
    rows_of(spark, 25).filter("v <> 'old'").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id long, updated string, v string").parquet(f"file://{tmp_path}/in")
    job = stream.writeStream.format("upsert_rest").options(url=service.url, key="id", rows=10).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    assert stored(service) == {k: f"v{k}" for k in range(25)}
