"""Starts of token files where ids repeat: a running sum over the files as they are read in order."""

from __future__ import annotations


def test_starts_follow_the_files(spark, tmp_path):
    from kelpie.llm.token_files import read_token_files, token_index, write_token_files

    rows = [(1, "a b c d e"), (1, "z"), (1, "m n o"), (1, "z"), (None, "x y"), (None, None), (0, ""), *[(7, f"word {k} " * (k % 5)) for k in range(40)]]
    path = f"file://{tmp_path}/ids"
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path)
    stored = sorted(read_token_files(spark, path).collect(), key=lambda r: r.at)
    at, expected = 0, []
    for r in stored:
        expected.append((r.doc_id, at, len(r.ids)))
        at += len(r.ids)
    assert [r.doc_id is not None for r in stored] == sorted(r.doc_id is not None for r in stored)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_index(spark, path).collect())
    assert [(d, s, n) for s, d, n in got] == expected
