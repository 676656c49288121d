"""Digest mails over two streams whose files lie out of order: each slot once, with the notices of its window."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from kelpie.streaming.digests import digest_mails
from kelpie.streaming.events import run_once

HOURS, LATE = 24, "6 hours"


def test_one_mail_for_each_slot(spark, tmp_path):
    r = random.Random(5)
    start = datetime(2026, 3, 1)
    slots = [(r.choice("ab"), reader, start + timedelta(days=day, hours=9)) for day in range(5) for reader in range(6)]
    slots += [*slots[3:6], ("q", 77, start + timedelta(days=1))]  # some arrive twice, one meets nothing
    notices = [(r.choice("abc"), k, start + timedelta(minutes=r.randrange(5 * 24 * 60))) for k in range(80)]
    notices += [("a", 900, start + timedelta(days=1, hours=9)), ("a", 901, start + timedelta(days=2, hours=9))]  # at a slot's moment
    schemas = {"slots": "kind string, reader int, slot timestamp", "notices": "kind string, notice int, published timestamp"}
    paths = {n: f"file://{tmp_path}/{n}" for n in schemas}

    def arrive(name, rows):
        spark.createDataFrame(rows, schemas[name]).coalesce(1).write.mode("append").parquet(paths[name])

    def run():
        streams = [spark.readStream.schema(schemas[n]).option("maxFilesPerTrigger", 1).parquet(paths[n]) for n in ("slots", "notices")]
        return run_once(digest_mails(*streams, ["kind"], HOURS, LATE), f"file://{tmp_path}/run", "append")

    def near_order(rows):
        return sorted(rows, key=lambda x: x[2] + timedelta(hours=r.uniform(0, 5)))

    cut = start + timedelta(days=2)
    for part in (lambda t: t < cut, lambda t: t >= cut):  # stopped in between
        for name, rows in (("slots", slots), ("notices", notices)):
            some = near_order([x for x in rows if part(x[2])])
            for k in range(0, len(some), 12):
                arrive(name, some[k : k + 12])
        run()
    far = datetime(2027, 1, 1)
    arrive("slots", [("z", 0, far)])
    arrive("notices", [("z", 0, far)])
    got = sorted((x.kind, x.reader, x.slot, x.notices) for x in run().collect() if x.kind != "z")
    expected = {(k, reader, at): sum(k == kind and at - timedelta(hours=HOURS) <= t < at for kind, _, t in notices) for k, reader, at in slots}
    assert got == sorted((*key, n) for key, n in expected.items())
    assert any(n == 0 for n in expected.values())


def test_readers_stay_out_of_the_join_with_notices(spark):
    start = datetime(2026, 3, 1)
    slots = spark.createDataFrame([("a", r, start + timedelta(days=1)) for r in range(40)], "kind string, reader int, slot timestamp")
    notices = spark.createDataFrame([("a", k, start + timedelta(minutes=k)) for k in range(30)], "kind string, notice int, published timestamp")
    mails = digest_mails(slots, notices, ["kind"], HOURS, LATE)
    assert sorted((x.reader, x.notices) for x in mails.collect()) == [(r, 30) for r in range(40)]
    nodes, ranged = [mails._jdf.queryExecution().analyzed()], []
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Join" and "published" in node.toString().split("\n")[0]:
            ranged.append(node.output().toString())
    assert len(ranged) == 1 and "reader" not in ranged[0]
