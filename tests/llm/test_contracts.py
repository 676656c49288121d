"""The queries of the training-data operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from kelpie.llm import registry
from kelpie.llm.tokens import vocabulary_path

WORDS = "amber birch cedar delta ember frost grove heron inlet jetty knoll larch maple north otter plume quartz river stone tulip umbra vapor willow xenon yarrow zephyr".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 31 + k * k * 7 + k * seed) % len(WORDS)] for k in range(n))


PASSAGE = prose(3, 30)
LONG = prose(5, 400)
PRIVATE = (
    "Mail A.b+c@ex-ample.co.uk, x@@y.com a@b@c.de; hosts 10.0.0.255 1.2.3.4.5.6.7.8 999.1.1.1 01.02.03.004 and 12.3.4 é "
    "card 4111 1111-1111 1111 or 4111111111111112 or 1234567890 phone +49 (30) 1234-5678 +1 2 +12345678901234567 ++33 1 23 45 67 89 "
    "\U0001f600 q@r.st 5500-0055-5555-5559 token=abcdef0123456789abcd jane (at) site (dot) org 555-123-4567 Dr. Anna Smith"
)
TEXTS = [
    None, "", "   \n\t ", "one", "two words", LONG, LONG, LONG.replace("amber", "AMBER"), LONG + " tail", prose(9, 400), PRIVATE, PRIVATE + "\n" + PRIVATE,
    "intro " + PASSAGE + " outro", PASSAGE.upper(), "short item here", "a short item here " + prose(11, 300), "ünïcode Straße 東京 " * 20, prose(13, 9000), "x" * 5000, "+" * 300 + "1" * 300,
    "<|endoftext|> can't 12.5% e.g. naïve—dash", *[prose(100 + k, 60 + k) for k in range(12)], prose(100, 60), prose(200, 3), prose(200, 3),
]
ROWS = [(k * 3 + 1, t) for k, t in enumerate(TEXTS)]
ITEMS = [(1, PASSAGE), (2, "Short item here"), (3, None), (4, "!!!"), (10, PASSAGE)]


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "en" if i % 2 else None, "hot", None if t is None else len(t), "n", 1, i, 0) for i, t in ROWS]
    # n, node, key, size, shard: columns whose names the operators use themselves
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, node string, n int, size long, shard int").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i, _ in ROWS], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name, schema in {"documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return d


def run(spark, d, number: int):
    name = next(k for k in registry.queries() if k.startswith(f"op{number}_"))
    return registry.queries()[name](spark, d).collect()


@pytest.fixture(scope="module")
def encoded():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in ROWS}


def id_bytes(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def lower(t: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


@pytest.mark.parametrize("number", range(1, 11))
def test_empty_tables(spark, empty, number):
    assert run(spark, empty, number) == []


def test_decontamination(spark, data):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, t in ITEMS:
        w = word.findall(lower(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(item))
    got = {r.doc_id: r for r in run(spark, data, 1)}
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        w, hit, items = word.findall(lower(t)), set(), set()
        for p, owners in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    items |= owners
        r = got[i]
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(w))
    assert any(r.contaminated for r in got.values()) and any(r.n_hit and not r.contaminated for r in got.values())


def shingles(t: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[k : k + 3]) for k in range(len(w) - 2)}


def components(rows) -> dict:
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_ngram_join(spark, data):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, data, 3)} == components(ROWS)


def test_ngram_join_near_the_threshold(spark):
    """Chains of edited copies, of several sizes: some pairs just link and some just do not."""
    from kelpie.llm.ngram_join import jaccard_groups

    rows, i = [], 0
    for size in (25, 70, 200, 900, 4000):
        base = [f"w{size}x{k}" for k in range(size)]
        for step in range(6):
            i += 1
            words = list(base)
            for e in range(step * max(1, size // 70)):
                words[(e * 37 + step * 11) % size] = f"edit{step}e{e}"
            rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)


def test_sketches_bound_the_symmetric_difference():
    import numpy as np

    from kelpie.llm.ngram_join import coarse, coarse_difference, pack_set, unpack_set

    r = np.random.default_rng(1)
    for n, m in ((100, 130), (1000, 1100), (1020, 1030), (5000, 5000)):
        pool = np.unique(r.integers(0, 2**64, n + m, dtype=np.uint64))
        a, b = np.sort(r.choice(pool, n, replace=False)), np.sort(r.choice(pool, m, replace=False))
        differ, sizes = coarse_difference(coarse(a), coarse(b))
        assert sizes == n + m and differ <= len(np.setxor1d(a, b))
        assert (unpack_set(pack_set(a)) >> np.uint64(16) == a >> np.uint64(16)).all()


def test_token_files(spark, data, encoded):
    start = 0
    got = {r.doc_id: r for r in run(spark, data, 9)}
    for i, _ in sorted(ROWS):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(encoded[i]), crc(id_bytes(encoded[i])))
        start += len(encoded[i])


def test_packing(spark, data, encoded):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in run(spark, data, 5):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(encoded)
    for i, rs in pieces.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(encoded[i])
            assert r.ids_crc32 == crc(id_bytes(encoded[i][at : at + r.length]))
            at += r.length
        assert at == len(encoded[i])
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0


def test_sharding(spark, data):
    got = run(spark, data, 8)
    text, shard, slots, load = dict(ROWS), {}, defaultdict(list), [0] * 16
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, crc(raw), "bytes", None)
        assert shard.setdefault(raw, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert len(got) == len(ROWS) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_personal_data(spark, data):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def passes(kind: str, m: str) -> bool:
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    for r in run(spark, data, 10):
        t = dict(ROWS)[r.doc_id] or ""
        found = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t) if passes(k, m.group())]
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert [r[f"n_{k}"] for k in patterns] == [sum(f[0] == k for f in found) for k in patterns], t[:80]
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert r.spans.startswith(written)


def test_audio(spark, data):
    got = run(spark, data, 4)
    assert len(got) == len(ROWS)
    seen = {}
    for r in got:
        raw = (dict(ROWS)[r.doc_id] or "").encode()
        payload = raw + bytes(64 - len(raw) % 64 if raw and len(raw) % 64 else 0 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), crc(payload[-64:]))
        assert seen.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


@pytest.mark.parametrize(("number", "by", "fold", "least"), [(2, 3, 1, 0.5), (7, 4, 2, 0.3)])
def test_scores(spark, data, number, by, fold, least):
    got, text, score = run(spark, data, number), dict(ROWS), {}
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        assert r.held_out == (crc(str(r.doc_id).encode()) % by == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
        assert abs(score.setdefault(text[r.doc_id] or "", r.score) - r.score) < 1e-9


def test_pseudo_likelihood(spark, data):
    got = run(spark, data, 6)
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in ROWS)
    assert all(r.log_likelihood <= 0 and (r.n_words > 0 or r.log_likelihood == 0) for r in got)


def test_pipeline(spark, data):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    once = corpus_pipeline.drop_near_duplicates(spark, docs, data)
    assert once.columns == docs.columns
    assert sorted(r.doc_id for r in once.collect()) == sorted(i for i, (_, c) in components(ROWS).items() if i == c)
    clean = {r.doc_id: r.text for r in corpus_pipeline.replace_personal_data(spark, docs, data).collect()}
    assert "[EMAIL]" in clean[31] and "q@r.st" not in clean[31] and clean[16] == LONG and clean[1] is None
    assert {r.doc_id for r in corpus_pipeline.run(spark, data).collect()} <= {i for i, _ in ROWS}
