"""Digest mails as a join of two streams: readers' slots, and the notices that fall into each slot's window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digest_mails(slots: DataFrame, notices: DataFrame, keys: list[str], hours: int, late: str) -> DataFrame:
    """(keys, reader, slot, notices): one row for each reader and slot, with the number of notices of the last `hours` before
    the slot (its moment excluded) that agree in the keys; 0 where there are none.

    slots: keys, reader, slot; notices: keys, notice, published. Both may arrive late by `late`; a reader's slot that arrives
    twice is one. A row is written once, when the watermarks of both streams have passed the slot. Notices are counted once for
    each slot, however many readers ask for it, and readers meet the counts, so the work does not grow with readers times notices.
    Rows of both meet on the keys and a bucket of `hours`, of which a slot's window lies in two at most. State: slots and
    notices that the other side may still meet, so at most `hours` and `late` of either.
    """
    width = hours * 3_600_000_000
    of = lambda t: F.floor(F.unix_micros(t) / F.lit(width)).cast("long")
    asked = slots.withWatermark("slot", late)
    once = asked.dropDuplicates([*keys, "slot"]).select(*keys, "slot")
    parted = once.withColumn("bucket", F.explode(F.array_distinct(F.array(of(F.expr(f"slot - interval {hours} hours")), of(F.expr("slot - interval 1 microsecond"))))))
    told = notices.withWatermark("published", late).select(*[F.col(k).alias(f"{k}_of") for k in keys], "notice", "published", of(F.col("published")).alias("bucket_of"))
    agree = F.expr(f"published >= slot - interval {hours} hours AND published < slot AND bucket = bucket_of")
    for k in keys:
        agree = agree & (F.col(k) == F.col(f"{k}_of"))
    counts = parted.join(told, agree, "left_outer").groupBy(*keys, "slot").agg(F.count("notice").alias("notices"))
    readers = asked.dropDuplicates([*keys, "reader", "slot"]).select(*[F.col(k).alias(f"{k}_by") for k in keys], "reader", F.col("slot").alias("slot_by"))
    same = F.col("slot") == F.col("slot_by")
    for k in keys:
        same = same & (F.col(k) == F.col(f"{k}_by"))
    return readers.join(counts, same).select(*keys, "reader", "slot", "notices")
