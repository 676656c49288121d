"""Columns of the input keep their names and values through every stage, whatever the operators call their own."""

from __future__ import annotations

NAMES = ["toxicity_score", "text_key", "n_words", "n_hit", "contaminated", "item_ids", "spans", "pii_email", "pii_text", "pii_base", "pii_extra", "pii_spans", "column_0", "node", "n", "component_id", "ref"]


def test_names_that_operators_use(spark, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    texts = [" ".join(f"w{k}x{j}" for j in range(20 + k)) for k in range(30)] + ["write to a.b@c.org or 10.0.0.1 please", None, ""]
    rows = [(k, t, "en", None if t is None else len(t), *[f"{n} {k}" for n in NAMES]) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)
    docs = spark.createDataFrame(rows, schema).repartition(2)
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "no such passage in any of the texts at hand here for sure indeed yes")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) >= 25
        for r in got:
            assert [r[n] for n in NAMES] == [f"{n} {r.doc_id}" for n in NAMES]
    empty = docs.filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).collect() == []
