"""The stored index against reading every text, over additions, replacements, removals and merges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kelpie.functions.text import search_match
from kelpie.operators.search_index import SearchIndex

QUERIES = ["metro", "LINEA metro", "e-mail", "a", "li", "subway", "日本", "x𝒜", "", "--", "tro li", "zzz", "aaaa", "emailnow"]
SYNONYMS = {"subway": ["metro", "日本", "línea de"], "zzz": ["now"]}


def scanned(docs, query):
    return sorted(r.id for r in docs.filter(search_match(F.col("text"), query, SYNONYMS)).collect())


def texts(seed, n):
    r = random.Random(seed)
    words = ["Línea", "de", "Metro", "metropolis", "e-mail", "now", "日本語", "aaaa", "a", "x𝒜y", ",", "email", "now-metro"]
    return [r.choice([None, "", " ".join(r.choices(words, k=r.randint(1, 6)))]) if k % 9 == 0 else " ".join(r.choices(words, k=r.randint(1, 9))) for k in range(n)]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """(index, texts that it should hold) after each change."""
    folder = f"file://{tmp_path_factory.mktemp('index')}"
    index = SearchIndex(spark, f"{folder}/a", "int")
    now = {}

    def frame(rows):
        return spark.createDataFrame(rows, "id int, text string")

    first = list(enumerate(texts(1, 60)))
    index.add(frame(first), "id", "text")
    now |= dict(first)
    again = [(k, t) for k, t in zip(range(40, 80), texts(2, 40), strict=True)]  # some replace, some are new
    index.add(frame(again), "id", "text")
    now |= dict(again)
    index.remove(frame([(k, None) for k in range(0, 80, 7)]), "id")
    now = {k: t for k, t in now.items() if k % 7}
    back = [(7, "metro is back")]
    index.add(frame(back), "id", "text")
    now |= dict(back)
    return frame(sorted(now.items())).cache(), index, index.merge(f"{folder}/b")


@pytest.mark.parametrize("query", QUERIES)
def test_index_equals_reading(steps, query):
    docs, index, merged = steps
    expected = sorted(r.id for r in docs.collect()) if not query.strip("- ") else scanned(docs, query)
    assert sorted(r.id for r in index.search(query, SYNONYMS).collect()) == expected
    assert sorted(r.id for r in merged.search(query, SYNONYMS).collect()) == expected


def test_only_postings_are_read(steps):
    _, index, _ = steps
    plan = index.search("metro")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(gram" in plan and "text" not in [c for c in index.search("metro").columns]
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_index(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/none")
    assert index.search("metro").count() == index.search("").count() == 0


def test_an_attempt_that_failed_is_not_seen(spark, tmp_path):
    """Postings without their list of texts, as a job leaves them that dies in between."""
    index = SearchIndex(spark, f"file://{tmp_path}/index", "int")
    docs = spark.createDataFrame([(1, "metro")], "id int, text string")
    index.add(docs, "id", "text")
    kept, index._list = index._list, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        index.add(docs.withColumn("text", F.lit("tram")), "id", "text")
    index._list = kept
    assert [r.id for r in index.search("metro").collect()] == [1] and index.search("tram").count() == 0
    index.add(docs.withColumn("text", F.lit("tram")), "id", "text")
    assert index.search("metro").count() == 0 and [r.id for r in index.search("tram").collect()] == [1]


def test_a_segment_is_written_where_its_texts_lie(spark, tmp_path):
    """No row is sent, and a character costs a few bytes in memory as in files: a row for each text and gram cost over thirty."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(300)]
    docs = [(k, " ".join(r.choices(words, k=300))) for k in range(400)]
    index = SearchIndex(spark, f"file://{tmp_path}/index", "int")
    index.add(spark.createDataFrame(docs, "id int, text string").coalesce(1), "id", "text")
    kept = index._read("postings", "data binary, block long").filter("data is not null")
    assert kept.agg(F.sum(F.octet_length("data") + 24)).first()[0] < 3 * sum(len(t) for _, t in docs)
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert size < 3 * sum(len(t) for _, t in docs)


@pytest.mark.parametrize("block", [1, 12, 60])
def test_blocks_of_any_size(spark, tmp_path, block):
    """Strings do not reach from a text into the next, nor are lost where a block ends; merging keeps what is live."""
    docs = spark.createDataFrame(list(enumerate(["ab", "cd", "", None, "x ab cd", "abcd", "a-b", "metro", "m etro", "the metro line"] * 3)), "id int, text string").coalesce(2)
    index = SearchIndex(spark, f"file://{tmp_path}/a", "int", block)
    index.add(docs, "id", "text")
    index.remove(docs.filter("id % 4 = 1"), "id")
    left = docs.filter("id % 4 <> 1")
    merged = index.merge(f"file://{tmp_path}/b")
    said = {"bcd": ["metro", "x"], "ab": ["metro line"]}
    for query in ("abcd", "bcd", "ab", "b", "ro"):
        expected = sorted(x.id for x in left.filter(search_match(F.col("text"), query, said)).collect())
        assert expected == sorted(x.id for x in index.search(query, said).collect()) == sorted(x.id for x in merged.search(query, said).collect())
