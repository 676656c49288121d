"""The event log read as a stream until all that is there has been processed, held against its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.session import shared_folder, table
from kelpie.streaming import digests, keyed
from kelpie.streaming import events as ops

TYPES = ["signup", "purchase", "view", "click"]
QUERIES, ORACLE = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


def _folder(spark) -> str:
    return shared_folder(spark, "streams")


def _log(spark, d):
    return ops.event_stream(spark, f"{d}/event[s].parquet")  # a pattern, since a plain path must be a folder


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def stream_daily_totals(spark, d):
    """The SQL is over the whole table, so no row is too late."""
    batches = ops.run_once(ops.daily_totals(ops.accepted(_log(spark, d), TYPES), late=None), _folder(spark))
    return batches.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("""SELECT user_id, event_id, old, new FROM (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old, event_type AS new FROM events) WHERE old <> new""")
def stream_state_changes(spark, d):
    """Batches bring the log in order of arrival; rows are compared in order of time once all have arrived."""
    arrived = ops.run_once(_log(spark, d).select("user_id", "event_id", "ts", "event_type"), _folder(spark), "append")
    return ops.ordered_state_changes(arrived)


@query("""WITH m AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    """A session is written once, when the watermark has passed its end; a last event far ahead, which has no part in the
    result, closes those that are still open."""
    folder = _folder(spark)
    end = table(spark, d, "events").agg(F.lit(None).cast("bigint").alias("user_id"), (F.max("ts") + F.expr("interval 30 days")).alias("ts")).filter("ts is not null")
    end.filter("false").write.parquet(f"{folder}/end")

    def sessions():
        seen = [x.select("user_id", "ts") for x in (_log(spark, d), ops.event_stream(spark, f"{folder}/end"))]
        return ops.session_counts(seen[0].union(seen[1]))

    ops.run_once(sessions(), folder, "append")
    end.write.mode("append").parquet(f"{folder}/end")
    return ops.run_once(sessions(), folder, "append").filter("user_id is not null").select("user_id", "n")


def _closed(spark, d, build):
    """build(stream) run over the log, then once more with a last row far ahead, which has no part in the result and lets the
    watermark pass all others."""
    folder = _folder(spark)
    end = table(spark, d, "events").agg(F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("bigint").alias("event_id"), (F.max("ts") + F.expr("interval 400 days")).alias("ts")).filter("ts is not null")
    end.filter("false").write.parquet(f"{folder}/end")

    def both():
        seen = [x.select("user_id", "event_id", "ts") for x in (_log(spark, d), ops.event_stream(spark, f"{folder}/end"))]
        return build(seen[0].union(seen[1]))

    ops.run_once(both(), folder, "append")
    end.write.mode("append").parquet(f"{folder}/end")
    return ops.run_once(both(), folder, "append")


@query("""SELECT event_id, user_id, coalesce(epoch_us(ts) - epoch_us(lag(ts, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 86400000000, false) AS limited FROM events WHERE user_id IS NOT NULL""")
def stream_rate_limits(spark, d):
    """Which events put their user over three in a day. The watermark waits as long as files lie out of order, so none is
    late, and a user's state ends a day after the last event."""
    keyed.use_rocks(spark)
    late = keyed.disorder(table(spark, d, "events"), "ts")
    return _closed(spark, d, lambda s: keyed.over_limit(s, 86_400, 3, f"{late} seconds")).select("event_id", "user_id", "limited")


@query("""WITH s AS (SELECT DISTINCT user_id % 3 AS kind, user_id AS reader, date_trunc('day', ts) + INTERVAL 1 DAY AS slot FROM events WHERE event_type = 'signup' AND user_id IS NOT NULL),
n AS (SELECT user_id % 3 AS kind, event_id, ts FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL)
SELECT reader, strftime(slot, '%Y-%m-%d') AS slot, count(event_id) AS notices FROM s LEFT JOIN n ON n.kind = s.kind AND n.ts >= slot - INTERVAL 24 HOUR AND n.ts < slot GROUP BY s.kind, reader, slot""")
def stream_digest_mails(spark, d):
    """A mail to each user the midnight after a day they signed up, with the purchases of that day in their third of users.
    Both sides are streams of the log; two last rows far ahead, which have no part in the result, close what is open."""
    folder = _folder(spark)
    late = f"{keyed.disorder(table(spark, d, 'events'), 'ts') + 86_400} seconds"
    far = table(spark, d, "events").agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).filter("ts is not null")
    end = far.select(F.lit(-3).cast("bigint").alias("user_id"), F.lit(-1).cast("bigint").alias("event_id"), "ts", F.explode(F.array(F.lit("signup"), F.lit("purchase"))).alias("event_type"))
    end.filter("false").write.parquet(f"{folder}/end")

    def mails():
        def side(kind):
            seen = [x.select("user_id", "event_id", "ts", "event_type") for x in (_log(spark, d), ops.event_stream(spark, f"{folder}/end"))]
            return seen[0].union(seen[1]).filter((F.col("event_type") == kind) & F.col("user_id").isNotNull()).withColumn("kind", F.col("user_id") % 3)

        slots = side("signup").select("kind", F.col("user_id").alias("reader"), (F.date_trunc("day", "ts") + F.expr("interval 1 day")).alias("slot"))
        return digests.digest_mails(slots, side("purchase").select("kind", F.col("event_id").alias("notice"), F.col("ts").alias("published")), ["kind"], 24, late)

    ops.run_once(mails(), folder, "append")
    end.write.mode("append").parquet(f"{folder}/end")
    return ops.run_once(mails(), folder, "append").filter("reader >= 0").select("reader", F.date_format("slot", "yyyy-MM-dd").alias("slot"), "notices")
