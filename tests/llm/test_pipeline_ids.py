"""Near-duplicate removal where ids repeat or are missing."""

from __future__ import annotations


def words(seed: int, n: int = 60) -> str:
    return " ".join(f"w{seed}x{k}" for k in range(n))


def test_ids_that_repeat_or_are_missing(spark, tmp_path):
    import corpus_pipeline

    near = words(3, 400)
    rows = [
        (3, words(1)), (7, words(1)), (7, words(2)),  # id 7: a copy of document 3 and an unrelated text
        (9, near), (9, near + " tail"),  # near copies that share an id
        (None, words(4)), (None, words(4)), (None, words(1)), (None, near + " other"),  # copies without an id
        (None, words(5, 400)), (None, words(5, 400) + " more"),  # near copies, none of which has an id
        (11, ""), (11, ""), (12, None), (None, " "), (None, " "),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert len([t for _, t in got if t and t.startswith("w5x0")]) == 1
    got = sorted(((i, (t or "")[:5]) for i, t in got if not (t and t.startswith("w5x0"))), key=str)
    assert got == sorted([(3, "w1x0 "), (7, "w2x0 "), (9, "w3x0 "), (None, "w4x0 "), (11, ""), (12, ""), (None, " "), (None, " ")], key=str)
