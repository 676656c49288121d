"""Every beginning of JSON documents becomes readable and keeps what was whole."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from kelpie.functions.cut_json import closed_json, read_json

DOCUMENTS = [
    {"a": [1, -2.5e3, True, None, {"b": "x\"y\\z\né  "}], "long key": {"c": [], "d": {}}, "e": "日本 🙂", "": [[["deep"]]]},
    [0, "a,b]}", {"k": ":{["}, [False], 12.75],
    {"n": 10, "m": "tail"},
]


def test_every_prefix(spark):
    rows, k = [], 0
    for d in DOCUMENTS:
        for ascii_ in (True, False):
            for indent in (None, 1):
                text = json.dumps(d, ensure_ascii=ascii_, indent=indent)
                rows += [(k := k + 1, text[:n], n == len(text), json.dumps(d)) for n in range(1, len(text) + 1)]
    frame = spark.createDataFrame(rows, "k int, t string, whole boolean, d string").repartition(4)
    for r in frame.select("t", "whole", "d", closed_json(F.col("t")).alias("c"), read_json(F.col("t")).isNotNull().alias("read")).collect():
        assert r.read, (r.t, r.c)
        value = json.loads(r.c)
        assert contained(value, json.loads(r.d)), (r.t, r.c)
        if r.whole:
            assert value == json.loads(r.d)


def contained(part, whole):
    """Is part a beginning of whole?"""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and contained(v, whole[k]) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and len(part) <= len(whole) and all(map(contained, part, whole))
    if isinstance(part, str):
        return isinstance(whole, str) and (whole.startswith(part) or not part.isprintable() or "\ud83d" in part)
    return part == whole or isinstance(whole, (int, float)) and str(whole).startswith(str(part).rstrip("0").rstrip(".")) or part is None


def test_odd_texts(spark):
    texts = [None, "", "no json", '```json\n{"a": 1}\n``` done', '{"a": 1} {"b": 2}', '{"a": tru', '{"a": 1, b', '{"a": }', "{]", '[1, 2', '[1, 2,', '["x\\', '["\\u12', '{"a": 1.']
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(closed_json(F.col("t"))).collect()]
    assert got == [None, None, None, '{"a": 1}', '{"a": 1}', "{}", '{"a": 1}', "{}", "{}", "[1, 2]", "[1, 2]", '["x"]', '[""]', "{}"]
