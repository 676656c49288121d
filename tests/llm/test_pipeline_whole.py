"""The whole pipeline against plain loops over what its first stage keeps."""

from __future__ import annotations

import re
from collections import defaultdict


def test_rows_of_the_whole_pipeline(spark, tmp_path):
    import corpus_pipeline
    from test_contracts import ITEMS, ROWS, components, lower
    from tokenizers import Tokenizer

    from kelpie.llm.tokens import vocabulary_path

    d = str(tmp_path)
    docs = [(i, t, None if t is None else len(t)) for i, t in ROWS]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i, _ in ROWS], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    source = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_toxic(spark, source, d).collect()}
    assert len(kept) >= len(ROWS) // 2
    first = [(i, t) for i, t in ROWS if i in kept]
    group = components(first)
    second = [(i, t) for i, t in first if group[i][1] == i]
    word, windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), set()
    for _, t in ITEMS:
        w = word.findall(lower(t))
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12) if w else 0)}
    third = []
    for i, t in second:
        w, hit = word.findall(lower(t)), set()
        for p in windows:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
        if not (hit and 20 * len(hit) >= len(w)):
            third.append((i, t))
    redacted = {r.doc_id: r.text for r in corpus_pipeline.replace_personal_data(spark, source.filter(source.doc_id.isin([i for i, _ in third])), d).collect()}
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert all(not email.search(t) for t in redacted.values() if t) and [t for i, t in third if t and not re.search(r"[@0-9]", t)] == [redacted[i] for i, t in third if t and not re.search(r"[@0-9]", t)]
    tokenizer = Tokenizer.from_file(vocabulary_path())
    want = {i: len(tokenizer.encode(redacted[i] or "", add_special_tokens=False).ids) + 1 for i, _ in third}
    pieces = defaultdict(int)
    for r in corpus_pipeline.run(spark, d).collect():
        pieces[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert dict(pieces) == want
