"""XML, feeds, tables and embedded data, with broken records."""

from __future__ import annotations

from pyspark.sql.types import StructType

from kelpie.sources import markup

RSS = "<rss><channel><title>t</title><item><title>A &amp; B</title><link>http://x/1</link><guid>g1</guid><pubDate>Mon</pubDate></item><item><title>C</title><link>http://x/2</link></item></channel></rss>"
ATOM = '<feed><entry><title>E</title><link rel="self" href="http://x/s"/><link href="http://x/e"/><updated>2026</updated><summary>s</summary></entry></feed>'


def test_feeds(spark):
    rows = spark.createDataFrame([(1, RSS), (2, ATOM), (3, RSS[:-20]), (4, None), (5, "<rss><channel/></rss>"), (6, "no xml")], "id int, body string")
    items, bad = markup.feed_items(rows, ["id"], "body")
    got = sorted((r[0], r[1], r[2], r[3], r[4], r[5]) for r in items.collect())
    assert got == [(1, 0, "A & B", "http://x/1", "g1", "Mon"), (1, 1, "C", "http://x/2", "http://x/2", None), (2, 0, "E", "http://x/e", "http://x/e", "2026")]
    assert sorted(r.id for r in bad.collect()) == [3, 6]


def test_xml_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<all><n id="1"><v>x</v></n><n id="2"><v>y</n><n id="3"><v>z</v></n></all>')
    (tmp_path / "b.xml").write_text("<all></all>")
    rows = markup.xml_records(spark, f"file://{tmp_path}", "n", StructType.fromDDL("_id int, v string")).collect()
    assert sorted((r._id, r.v) for r in rows if r.malformed is None) == [(1, "x"), (3, "z")]
    assert ['<n id="2">' in r.malformed for r in rows if r.malformed is not None] == [True]


TABLE = """<TABLE class=a><tr><th>Nr<th>Due  date</th><th>Buyer</tr><tr><td>7<td><b>1 May</b></td><td>A &amp; B</td></tr>
<tr><td>8</td></tr></table> text <table><tr><td>only</td></tr></table><table></table>"""


def test_grids(spark):
    pages = spark.createDataFrame([(1, TABLE), (2, None), (3, "<table><tr><td>cut")], "id int, html string")
    cells = markup.grid(pages, ["id"], "html")
    assert sorted((r.id, r.grid, r.row, r.cell, r.header, r.text) for r in cells.collect()) == [
        (1, 0, 0, 0, True, "Nr"), (1, 0, 0, 1, True, "Due date"), (1, 0, 0, 2, True, "Buyer"),
        (1, 0, 1, 0, False, "7"), (1, 0, 1, 1, False, "1 May"), (1, 0, 1, 2, False, "A & B"), (1, 0, 2, 0, False, "8"),
        (1, 1, 0, 0, False, "only"), (3, 0, 0, 0, False, "cut"),
    ]
    named = markup.named_rows(cells, ["id"], {"number": "^nr", "due": "due", "none": "absent"}).collect()
    assert sorted((r.row, r.number, r.due, r.none) for r in named) == [(1, "7", "1 May", None), (2, "8", None, None)]


def test_table_rows_equal_named_rows(spark):
    """Rows by their headers, without a shuffle; odd tables: no header, a cell too few, rows without cells, scripts, tags cut off."""
    odd = "<table><tr></tr><tr><th>Nr</th></tr></table><TABLE><TR><TH>due <th>NR &amp; due<tr>no cell<tr><td>1 &lt; 2 &amp;amp;<td>&amp;&eacute;&#65;<tr><td><SCRIPT>x</SCRIPT>3<STYLE>s</style><<b>x<th>4</table>"
    mixed = "<table><tr><th>nr<td>due</tr><tr><td>1<td>2</tr></table><table x><thead><tr><th>nr</thead><tfoot><tr><td>5 <br>\t6&nbsp;</tfoot></table"
    pages = spark.createDataFrame([(1, TABLE), (2, None), (3, "<table><tr><td>cut"), (4, odd), (5, mixed), (6, "a < b <table"), (7, "")], "id int, html string")
    names = {"number": "^nr", "due": "due", "none": "absent"}
    found = markup.table_rows(pages, ["id"], "html", names)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    expected = markup.named_rows(markup.grid(pages, ["id"], "html"), ["id"], names)
    key = lambda r: (r.id, r.grid, r.row)
    assert sorted(found.collect(), key=key) == sorted(expected.collect(), key=key)
    assert [(r.number, r.due) for r in sorted(found.filter("id = 4").collect(), key=key)] == [("&éA", "1 < 2 &amp;"), ("4", "3 x")]


def test_long_page(spark):
    """A page of two million characters does not overflow the matcher."""
    html = "<table>" + "<tr><td>" + "x" * 2_000_000 + "</td></tr></table>"
    assert markup.grid(spark.createDataFrame([(1, html)], "id int, html string"), ["id"], "html").selectExpr("length(text)").first()[0] == 2_000_000


def test_long_page_of_tags(spark):
    tags = "<table>" + "<tr><td>" + "x<i>" * 500_000 + "</td></tr></table>"
    assert markup.grid(spark.createDataFrame([(1, tags)], "id int, html string"), ["id"], "html").selectExpr("length(text)").first()[0] == 999_999


def test_embedded_json(spark):
    html = '<script>var x=1</script><script type="application/ld+json">{"name":"n","n":3}</script><script type=\'application/json\'>{broken</script>'
    row = markup.embedded_json(spark.createDataFrame([(html,)], "h string"), "h", "name string, n int", "data").first()
    assert row.data[0].name == "n" and row.data[0].n == 3 and (row.data[1] is None or row.data[1].name is None)
