"""Token ids by remembered chunks against encoding whole texts with the library, on strings of all of Unicode."""

from __future__ import annotations

import random

AWKWARD = ["İ", "İ.", "ß", "ΟΔΟΣ.", "ﬁ", "é", "́", "a​b", "½", "٣4", "'s", "can't", "I'LL", "'Tis", "<|endoftext|>", "x<|startoftext|>y", "<|x", " ", " ", "\t", "\x00", "\x1c", "K", "Å", "ǅ", "한국", "가", "👩‍👧", "a,b.c", "...", ".,", "1,234.5", "_", "﻿"]


def strings(n: int):
    r = random.Random(4)
    ranges = [(32, 126), (32, 126), (97, 122), (0xA0, 0x24F), (0x300, 0x36F), (0x370, 0x5FF), (0x900, 0x1CFF), (0x1E00, 0x2BFF), (0x3000, 0xABFF), (0xAC00, 0xD7A3), (0xF900, 0xFFFF), (0x10000, 0x1FFFF), (0, 31)]
    for _ in range(n):
        parts = []
        for _ in range(r.randint(1, 6)):
            if r.random() < 0.25:
                parts.append(r.choice(AWKWARD))
            low, high = r.choice(ranges)
            parts.append("".join(chr(r.randint(low, high)) for _ in range(r.randint(1, 5))))
            if r.random() < 0.4:
                parts.append(r.choice([" ", "  ", "\n", ".", ",", ". "]))
        yield "".join(parts)


def test_ids_do_not_depend_on_what_was_met_before():
    from kelpie.llm.tokens import ChunkEncoder, packed, vocabulary_path

    primed, small = ChunkEncoder(vocabulary_path()), ChunkEncoder(vocabulary_path(), most=2000)
    whole = primed.tokenizer
    for text in AWKWARD:
        primed.encode(text)
        primed.encode(text.replace(".", ""))
    texts = [*AWKWARD, *strings(100_000)]
    right = whole.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, e in zip(texts, right, strict=True) if primed.encode(t) != packed(e.ids)]
    assert not wrong, (len(wrong), [t.encode("unicode_escape") for t in wrong[:5]])
    assert all(small.encode(t) == packed(e.ids) for t, e in zip(texts[:5000], right, strict=False)) and small.held < 20_000


def test_what_is_remembered_is_bounded():
    from kelpie.llm.tokens import ChunkEncoder, vocabulary_path

    enc = ChunkEncoder(vocabulary_path(), most=100_000)
    for k in range(3000):
        enc.encode(f"word{k} other{k * 7}x " + "long" * 20)
    assert enc.held < 110_000 and len(enc.known) + len(enc.old) < 1200
    assert enc.encode(None) == enc.encode("") == b""
