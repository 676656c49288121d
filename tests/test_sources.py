"""Readers of loose files, the paged source and streams across restarts."""

from __future__ import annotations

import json
import threading
import zipfile
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql.types import StructType

from kelpie.sources import files, office, sinks
from kelpie.sources.rest import Ckan, PagedRest, latest
from kelpie.streaming import events as streams


def test_delimited_keeps_bad_lines_apart(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id;name;value\n1;plain;3\n2;"a ""quoted"" one";4\n3\nx;bad number;5\n')
    rows = files.delimited(spark, f"file://{p}", StructType().add("id", "integer").add("name", "string").add("value", "integer"), ";")
    rows = rows.collect()
    assert sorted(tuple(r)[:3] for r in rows if r.malformed is None) == [(1, "plain", 3), (2, 'a "quoted" one', 4)]
    assert sorted(r.malformed for r in rows if r.malformed) == ["3", "x;bad number;5"]
    p.write_text("id;name;value\n")
    assert files.delimited(spark, f"file://{p}", StructType().add("id", "integer"), ";").isEmpty()


def test_records_blocks_and_packages(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"rows": [{"a": 1, "b": "x"}, {"a": 2}]}))
    rows = files.records(spark, f"file://{tmp_path}/r.json", "rows array<struct<a:int,b:string>>", "rows")
    assert [tuple(r) for r in rows.orderBy("a").collect()] == [(1, "x"), (2, None)]
    df = spark.createDataFrame([(1, "head\nNo. 1 one\nmore\nNo. 2 two"), (2, None), (3, "")], "k int, text string")
    assert [tuple(r) for r in files.blocks(df, "text", r"No\. ").orderBy("position").collect()] == [(1, 1, "No. 1 one\nmore\n"), (1, 2, "No. 2 two")]
    for name in ("x.zip", "y.zip"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(zipfile.ZipInfo("in/a.txt"), "A")
            z.writestr(zipfile.ZipInfo("b.txt"), "")
    out = files.packages(spark, f"file://{tmp_path}")
    assert sorted((r.member, bytes(r.content)) for r in out.collect()) == [("b.txt", b""), ("b.txt", b""), ("in/a.txt", b"A"), ("in/a.txt", b"A")]
    found = files.distinct_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(f"file://{tmp_path}"))
    assert [r.copies for r in found.collect()] == [2]


class Service(BaseHTTPRequestHandler):
    asked: list[dict] = []

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Service.asked.append(q)
        if "$select" in q:
            return self.answer([{"latest": 24}])
        if "resource_id" in q:
            some = [{"id": i, "name": f"n{i}"} for i in range(25)][int(q["offset"]) :][: int(q["limit"])]
            return self.answer({"success": True, "result": {"total": 25, "records": some}})
        where, rows = q.get("$where", ""), [{"id": i, "name": f"n{i}"} for i in range(25)]
        if " in (" in where:
            wanted = where[where.index("(") :]
            rows = [r for r in rows if f"'{r['name']}'" in wanted]
        elif where:
            rows = [r for r in rows if r["id"] >= int(where.rsplit(" ", 1)[1])]
        if q.get("$order", "").endswith("DESC"):
            rows.reverse()
        self.answer(rows[int(q["$offset"]) :][: int(q["$limit"])])

    def answer(self, rows):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(rows).encode())

    def log_message(self, *_):
        pass


def test_paged_source_pushes_filters(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedRest)
    df = spark.read.format("paged_rest").schema("id int, name string").options(url=f"http://127.0.0.1:{server.server_port}/", pages=3, rows=10).load()
    assert sorted(r.id for r in df.collect()) == list(range(25))
    Service.asked.clear()
    assert sorted(r.id for r in df.filter("id >= 20 and length(name) > 1").collect()) == list(range(20, 25))
    assert {q.get("$where") for q in Service.asked} == {"id >= 20"}
    url = f"http://127.0.0.1:{server.server_port}/"

    def read(**options):
        return sorted(r.id for r in spark.read.format("paged_rest").schema("id int, name string").options(url=url, **options).load().collect())

    assert read() == list(range(25)) and read(rows=4) == list(range(25)) and read(rows=5, pages=2) == list(range(25))
    Service.asked.clear()
    assert read(rows=5, order="name DESC", stop_column="name", stop_before="n18", pages=9) == [18, 19, 20, 21, 22, 23, 24]
    assert len(Service.asked) <= 3  # the walk ends early
    assert read(keys=",".join(f"n{k}" for k in (3, 5, 7, 90)), key_column="name", key_batch=2) == [3, 5, 7]
    assert latest(url, "id") == 24
    spark.dataSource.register(Ckan)
    rows = spark.read.format("ckan").schema("id int, name string").options(url=url, resource="r", rows=10).load()
    assert sorted(r.id for r in rows.collect()) == list(range(25)) and rows.rdd.getNumPartitions() == 3
    server.shutdown()


def test_office_files(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7.5</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c><c r="AA3" t="inlineStr"><is><t>far</t></is></c></row></sheetData></worksheet>')
    got = sorted((r.sheet, r.row, r.cells) for r in office.workbooks(spark, f"file://{tmp_path}").collect())
    assert got[0] == ("sheet1", 1, ["name", None, "7.5"])
    assert got[1][:2] == ("sheet1", 3) and got[1][2][1] == "ab" and got[1][2][26] == "far" and len(got[1][2]) == 27
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:body></w:document>')
    assert [(r.position, r.text) for r in office.documents(spark, f"file://{tmp_path}").orderBy("position").collect()] == [(0, "One line"), (1, "a\tb")]


def test_reports_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "yes", now'), (2, "two\nlines"), (3, None), (4, "plain")], "k int, t string")
    sinks.write_csv(df.coalesce(1), f"file://{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text == 'k,t\n1,"say ""yes"", now"\n2,"two\nlines"\n3,\n4,plain\n'
    sinks.write_json(df, f"file://{tmp_path}/json")
    assert sorted(tuple(r) for r in spark.read.schema("k int, t string").json(f"file://{tmp_path}/json").collect()) == sorted((tuple(r) for r in df.collect()))
    assert json.loads(sinks.document(df.filter("k > 2"), "rows").first()[0]) == {"rows": [{"k": 3}, {"k": 4, "t": "plain"}]}


def test_labelled_fields(spark):
    df = spark.createDataFrame([(1, "Name: A one\n  Amount\t12,5\nOther: x"), (2, "nothing here"), (3, None)], "k int, block string")
    got = {r.k: (r.name, r.amount) for r in files.fields(df, "block", {"name": "name|title", "amount": "amount"}).collect()}
    assert got == {1: ("A one", "12,5"), 2: (None, None), 3: (None, None)}


def test_rate_limit_over_batches(spark, tmp_path):
    log, job = f"file://{tmp_path}/log", f"file://{tmp_path}/job"

    def add(rows):
        spark.createDataFrame([(i, datetime(2026, 1, 1, 0, 0, s), u, "view", None) for i, s, u in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, props string").coalesce(1).write.mode("append").parquet(log)
        return streams.run_once(streams.rate_limited(streams.event_stream(spark, log), 10, 2), job, "append")

    add([(1, 1, 7), (2, 2, 7), (3, 3, 7), (4, 3, 8), (5, 3, None)])
    out = add([(6, 10, 7), (7, 11, 7), (8, 12, 7), (9, 12, 8)])
    assert {r.event_id: r.allowed for r in out.collect()} == {1: True, 2: True, 3: False, 4: True, 6: False, 7: True, 8: True, 9: True}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    log, job = f"file://{tmp_path}/log", f"file://{tmp_path}/job"

    def add(rows):
        spark.createDataFrame([(i, datetime(2026, 1, 1, 0, m), 1, t, None) for i, m, t in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, props string").coalesce(1).write.mode("append").parquet(log)

    add([(1, 1, "view"), (2, 2, "view"), (3, 3, "click")])
    assert [tuple(r)[1:4] for r in streams.run_once(streams.state_changes(streams.event_stream(spark, log)), job, "append").collect()] == [(3, "view", "click")]
    add([(4, 4, "click"), (5, 5, "view")])
    out = streams.run_once(streams.state_changes(streams.event_stream(spark, log)), job, "append")
    assert sorted(tuple(r)[1:4] for r in out.collect()) == [(3, "view", "click"), (5, "click", "view")]


def test_repeated_ids_count_once(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    rows = [(1, datetime(2026, 1, 1), 1, "view", None)] * 3 + [(2, datetime(2026, 1, 1), None, "view", None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, props string").write.parquet(log)
    once = streams.once_per_id(streams.accepted(streams.event_stream(spark, log), ["view"]))
    assert streams.run_once(once, f"file://{tmp_path}/job", "append").count() == 1
