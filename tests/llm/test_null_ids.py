"""Rows without an id: links of the n-gram join, ranges and lookups of token files."""

from __future__ import annotations

from collections import Counter


def test_null_ids_link_like_others(spark):
    from kelpie.llm.ngram_join import jaccard_groups

    near = " ".join(f"w{k}" for k in range(400))
    rows = [(3, near), (None, near + " tail"), (None, near + " other tail"), (None, "alone " * 3), (None, " ".join(f"v{k}" for k in range(300))), (None, " ".join(f"v{k}" for k in range(300)) + " x"), (9, "")]
    got = Counter((r.doc_id, r.component_id) for r in jaccard_groups(spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(3)).collect())
    assert got == Counter({(3, 3): 2, (None, 3): 4, (None, None): 6, (9, 9): 2})


def test_token_files_of_repeated_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    from kelpie.llm import token_files
    from kelpie.llm.tokens import vocabulary_path

    rows = [(None, f"text number {k}") for k in range(50)] + [(7, f"seven {k}") for k in range(60)] + [(k, "x " * k) for k in range(100, 140)]
    path = f"file://{tmp_path}/ids"
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path)
    got = token_files.token_index(spark, path).collect()
    t = Tokenizer.from_file(vocabulary_path())
    sizes = Counter((i, len(t.encode(x, add_special_tokens=False).ids) + 1) for i, x in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == sizes
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_lookup_prunes_by_statistics_and_bloom_filters(spark, tmp_path):
    from kelpie.llm import token_files

    path = f"file://{tmp_path}/ids"
    token_files.write_token_files(spark.createDataFrame([(k * 2, f"word{k} " * 5) for k in range(5000)], "doc_id long, text string"), path)
    found = token_files.lookup(spark, path, [8, 4000, 4001])
    assert sorted(r.doc_id for r in found.collect()) == [8, 4000]
    assert all(r.ids[-1] == 2 for r in found.collect())
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan
    files = [f for f in (tmp_path / "ids").iterdir() if f.suffix == ".orc"]
    assert len(files) > 1 and any(b"doc_id" in f.read_bytes() for f in files)
    metrics = found.select("doc_id")
    metrics.collect()
    rows = {m: v for m, v in _scan_metrics(metrics).items()}
    assert rows["numOutputRows"] <= 2 * 1000  # row groups of 1,000 rows; the other stripes are not decoded


def _scan_metrics(df) -> dict:
    node = df._jdf.queryExecution().executedPlan()
    stack = [node.executedPlan() if node.getClass().getSimpleName().startswith("Adaptive") else node]
    while stack:
        n = stack.pop()
        if "Scan" in n.nodeName():
            it, out = n.metrics().iterator(), {}
            while it.hasNext():
                kv = it.next()
                out[kv._1()] = kv._2().value()
            return out
        children = n.children()
        stack += [children.apply(k) for k in range(children.size())]
    return {}
