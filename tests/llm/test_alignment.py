"""Alignment of two tokenizers against plain loops over bytes, sparse products against dense ones."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

WORDS = ["the", "naïve", "12345", "don't", "…", "日本語", "foo_bar", "\t", "x" * 40, "Straße", "🙂", "<|endoftext|>", "</s>", "\n\n", "é", " ", "​", "K9"]


def brute(rows):
    from tokenizers import Tokenizer

    from kelpie.llm.alignment import A_FILE, B_FILE
    from kelpie.llm.tokens import vocabulary_path

    import sentencepiece

    a_tok = Tokenizer.from_file(vocabulary_path(A_FILE))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(B_FILE))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}

    def b_bytes(k):
        p = b_tok.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if b_tok.is_byte(k) else p.replace("▁", " ").encode()

    docs = []
    for doc_id, text in rows:
        data = b" " + (text or "").encode()
        a, b = (a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)) if text else ([], [])
        pa, pb = [bytes(byte_of[c] for c in a_tok.id_to_token(k)) for k in a], [b_bytes(k) for k in b]
        if not text or b"".join(pa) != data or b"".join(pb) != data:
            docs.append((doc_id, [], [], [], 0, ""))
            continue
        at_a, at_b = [k for k, p in enumerate(pa) for _ in p], [k for k, p in enumerate(pb) for _ in p]
        links = sorted(set(zip(at_a, at_b, strict=True)))
        end_a, end_b = {sum(map(len, pa[: k + 1])): k for k in range(len(pa))}, {sum(map(len, pb[: k + 1])): k for k in range(len(pb))}
        groups, i, j = [], 0, 0
        for e in sorted(end_a.keys() & end_b.keys()):
            groups.append((a[i : end_a[e] + 1], b[j : end_b[e] + 1]))
            i, j = end_a[e] + 1, end_b[e] + 1
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.append((doc_id, a, b, [(a[x], b[y]) for x, y in links], len(groups), hashlib.sha256(written.encode()).hexdigest()))
    held, best = Counter(p for d in docs for p in set(d[3])), defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(d[0], len(d[1]), len(d[2]), d[4], len(d[3]), sum(held[p] == best[p[0]] for p in d[3]), sum(held[p] for p in d[3]), d[5]) for d in docs]


def texts(n, seed):
    r = random.Random(seed)
    out = ["", None, " ", "  two  blanks ", "a▁b", "\x00", "x", "same text twice", "same text twice", "word " * 3000]
    for _ in range(n):
        out.append("".join(r.choice(WORDS) + r.choice(["", " ", " ", ", "]) for _ in range(r.randint(1, 60))))
    return out


def test_equal_to_plain_loops(spark, monkeypatch):
    from kelpie.llm import alignment

    rows = [(k % 90, t) for k, t in enumerate(texts(120, 4))] + [(None, "no id")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pairs string, chunk int").repartition(3)
    got = alignment.align(frame).drop("n_shared").collect()
    key = lambda x: (x[0] is None, *map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    assert alignment.align(frame.limit(0)).count() == 0


def test_chunks_and_steps_do_not_matter(monkeypatch):
    from kelpie.llm import alignment

    some = [t or "" for t in texts(30, 9)]
    whole = alignment.Aligned(some)
    links = [np.concatenate(x) for x in zip(*whole.links(), strict=True)]
    monkeypatch.setattr(alignment, "STEP", 7)
    again = [np.concatenate(x) for x in zip(*whole.links(), strict=True)]
    assert all(np.array_equal(x, y) for x, y in zip(links, again, strict=True))
    assert whole.group_texts() == [g for t in some for g in alignment.Aligned([t]).group_texts()]
    shared = [np.concatenate(x) for x in zip(*whole.shared(), strict=True)]
    assert len(shared[0]) == whole.shared_sizes().sum() >= len(links[0])


def test_long_texts_are_cut_where_no_piece_goes_on(monkeypatch):
    from kelpie.llm import alignment

    t = alignment.tokenizers()
    long = " ".join(texts(200, 2)[10:]) + "   end ▁ x  "
    whole = t.pieces.encode(long)
    monkeypatch.setattr(alignment, "LONG", 50)
    assert len(alignment._cut(long)) > 20
    assert t.b([long]) == [whole]


@pytest.mark.parametrize("seed", range(5))
def test_products_equal_dense_ones(seed):
    from kelpie.llm.alignment import Csr

    r = np.random.default_rng(seed)

    def sparse(rows, columns):
        dense = r.integers(0, 3, (rows, columns)) * (r.random((rows, columns)) < 0.3)
        i, j = np.nonzero(dense)
        return dense, Csr(np.concatenate([[0], np.cumsum(np.bincount(i, minlength=rows))]), j, dense[i, j], columns)

    (x, a), (y, b) = sparse(17, 9), sparse(9, 13)
    out = np.zeros((17, 13), int)
    for i, j, v in a.product(b):
        out[i, j] = v
    assert np.array_equal(out, x @ y)
    for i, j, v in b.transposed().product(a.transposed()):
        out[j, i] = v
    assert np.array_equal(out, x @ y)


def test_links_as_rows(spark):
    from kelpie.llm.alignment import token_links

    frame = spark.createDataFrame([(1, "overlapping tokens"), (2, None)], "doc_id long, text string")
    links = token_links(frame).collect()
    assert {x.doc_id for x in links} == {1}
    assert sum(x.common for x in links) == len(" overlapping tokens")
    assert {(x.a, x.b) for x in links} <= {(x.a, x.b) for x in token_links(frame, kind="group").collect()}
