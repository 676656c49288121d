"""The number of links of the n-gram join against brute force over all pairs."""

from __future__ import annotations

from collections import Counter


def test_links_are_all_counted(spark, monkeypatch):
    from test_contracts import components, shingles

    from kelpie.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 7)  # several blocks for a small bucket
    rows, i = [], 0
    for size, copies in ((60, 4), (300, 40), (2000, 5)):
        base = [f"w{size}x{k}" for k in range(size)]
        for step in range(copies):
            i += 1
            words = list(base)
            for e in range(step * size // 4000 + 1):
                words[(e * 37 + step * 11) % size] = f"edit{step}e{e}"
            rows += [(i, " ".join(words)), (1000 + i, " ".join(words))] if step % 3 == 0 else [(i, " ".join(words))]
    rows += [(900, ""), (901, None), (902, "two words")]
    sets = {frozenset(s) for _, t in rows if (s := shingles(t))}
    links = Counter()
    for a in sets:
        links[a] = sum(a is not b and 100 * len(a & b) >= 90 * len(a | b) for b in sets)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.jaccard_groups(docs, count_links=True).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows)
    assert {r.doc_id: r.n_links for r in got} == {i: links[frozenset(shingles(t))] for i, t in rows}
    assert max(links.values()) > 20
    assert "n_links" not in ngram_join.jaccard_groups(docs).columns
