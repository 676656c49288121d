"""Personal data in one long text full of matches: places as plain regular expressions give them, and work that grows with it."""

from __future__ import annotations

import re
import time


def text_of(n):
    kinds = ("u{0}@h{0}.com", "+49 30 1{0:06d}", "4111 1111 1111 1111", "10.0.0.{1}", "naïve – {0}", "(202) 555-0{1:03d}")
    return "; ".join(kinds[k % 6].format(k, k % 256) for k in range(n))


def test_long_text(spark):
    from pyspark.sql import functions as F

    from kelpie.llm import pii

    text = text_of(30_000)
    docs = spark.createDataFrame([(1, text), (2, None), (3, "x")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    emails = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert got[1].n_email == len(emails) == 5000 and got[1].n_card == 5000
    assert got[1].spans.split(",")[:5000] == emails and got[2].spans == got[3].spans == ""
    assert time.time() - began < 60
    clean = pii.redact(docs).filter("doc_id = 1").select(F.col("text")).first()[0]
    assert clean.count("[EMAIL]") == 5000 and "@" not in clean and clean.count("naïve – ") == 5000


def test_running_values(spark):
    from pyspark.sql import functions as F

    from kelpie.llm.pii import _added, _before

    rows = [([k * 7 % 13 for k in range(n)],) for n in (0, 1, 2, 127, 128, 129, 1000)] + [(None,)]
    frame = spark.createDataFrame(rows, "v array<int>")
    for op, plain, zero in ((_added, lambda a, b: a + b, 0), (F.greatest, max, 0), (F.least, min, 99)):
        for r in _before(frame, "v", "out", F.lit(zero), op).collect():
            at, expected = zero, []
            for x in r.v or []:
                expected.append(at)
                at = plain(at, x)
            assert (r.out or []) == expected
