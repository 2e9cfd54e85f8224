"""Queries that run a stream over a table to its end and return what it wrote."""

from pyspark.sql import functions as F

from sightline.operators.sightings import latest_rows
from sightline.plans.collection import SIGHTINGS_SQL, sources_text
from sightline.plans.health import EMA_SQL, LAST_USERS_SQL, RATE
from sightline.plans.registry import query
from sightline.plans.verification import EXPONENTIAL, REPLIES_SQL, THROTTLE_SQL, outcomes
from sightline.session import work_path
from sightline.streaming import events as ops
from sightline.streaming import tables
from sightline.streaming.sources import Closing, read_files


def event_stream(t):
    """The events table as a file stream with a TIMESTAMP event time."""
    stream = read_files(t.spark, t.folder, t.events.schema, pattern="events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


class _Streams:
    """Like the batch tables, with events as a stream."""

    def __init__(self, t):
        self.events = event_stream(t)


def finished(t, stream, label):
    """Run an append stream to its end into a table and read it back."""
    path = work_path(t.spark, label)
    (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{path}-state").option("path", path)
        .trigger(availableNow=True).start().awaitTermination()
    )
    return t.spark.read.schema(stream.schema).parquet(path)


def finished_whole(spark, read, rows, make, label, seconds):
    """Run ``make(stream)`` to its end, tail included: a closing row ``seconds`` behind the last of
    ``rows`` follows in a second run of the same query. ``read()`` opens the stream of ``rows``."""
    path = work_path(spark, label)
    closing = Closing(spark, f"{path}-closing", rows.schema, "ts")
    for last in (False, True):
        if last:
            closing.close(rows, seconds)
        made = make(closing.follow(read()))
        (
            made.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{path}-state").option("path", path)
            .trigger(availableNow=True).start().awaitTermination()
        )
    return spark.read.schema(made.schema).parquet(path)


def whole_events(t, make, label, seconds):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return finished_whole(t.spark, lambda: event_stream(t), rows, make, label, seconds)


def reply_log(events):
    """Views as requests, clicks as replies; the closing row, which has no type, is neither."""
    kind = F.col("event_type")
    asks = F.when(kind.isin("view", "click"), kind == "view").alias("asks")
    return events.filter(kind.isNull() | kind.isin("view", "click")).select("event_id", "user_id", "ts", asks)


def ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("stream_sightings", SIGHTINGS_SQL)
def _(t):
    stream = event_stream(t).select(
        F.col("user_id").alias("infohash"), F.col("event_type").alias("source"), "ts"
    )
    path = work_path(t.spark, "sightings")
    table = tables.sightings_table(t.spark, path)
    tables.run_sightings(stream, table, f"{path}-state").awaitTermination()
    return ntz(sources_text(table.read()), "first_seen", "last_seen")


@query("stream_metadata", """
SELECT user_id, event_id, ts, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(t):
    stream = event_stream(t).select("user_id", "event_id", F.col("ts").alias("verified_at"), "event_type")
    path = work_path(t.spark, "metadata")
    table = tables.FoldTable(
        t.spark, path, lambda rows: latest_rows(rows, ["user_id"], ["batch_no", "verified_at", "event_id"])
    )
    tables.run_metadata(stream, table, f"{path}-state").awaitTermination()
    made = table.read().drop("batch_no").withColumnRenamed("verified_at", "ts")
    return ntz(made, "ts")


@query("stream_job_fold", EXPONENTIAL + "SELECT * FROM j")
def _(t):
    path = work_path(t.spark, "jobs")
    table = tables.jobs_table(t.spark, path)
    stream = outcomes(_Streams(t)).drop("event_id")
    tables.run_outcomes(stream, table, f"{path}-state").awaitTermination()
    return ntz(tables.read_jobs(table), "next_retry_at", "updated_at")


@query("stream_dedupe", "SELECT DISTINCT user_id FROM events")
def _(t):
    stream = event_stream(t).select("user_id", "ts")
    return finished(t, ops.dedupe(stream, "user_id", "ts", "365 days").select("user_id"), "dedupe")


@query("stream_minute_counts", """
SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS ts, event_type AS metric_name, count(*) AS n
FROM events GROUP BY 1, 2""")
def _(t):
    def make(events):
        return ops.counts(events.select("event_type", "ts"), "event_type", "ts")

    return ntz(whole_events(t, make, "counts", 3600), "ts")


@query("stream_replies", REPLIES_SQL)
def _(t):
    def make(events):
        return ops.correlate(reply_log(events), "user_id", "ts", "asks", "event_id", 6 * 3600, "1 hour")

    return ntz(whole_events(t, make, "replies", 24 * 3600), "ts", "reply_ts")


@query("stream_value_ema", EMA_SQL + "SELECT event_id, user_id, round(ema, 6) AS ema FROM r")
def _(t):
    def make(events):
        return ops.moving_average(events, "user_id", "ts", "value", RATE, tie="event_id", late="1 hour")

    made = whole_events(t, make, "ema", 24 * 3600)
    return made.select("event_id", "user_id", F.round("ema", 6).alias("ema"))


@query("stream_rate_limit", THROTTLE_SQL)
def _(t):
    stream = event_stream(t).select("event_id", "user_id", "ts")
    made = ops.rate_limit(stream, "user_id", "ts", 1 / 36000, 3.0, 86400.0)
    return ntz(finished(t, made, "throttle"), "ts")


@query("stream_negative_cache", """
SELECT event_id, user_id, ts FROM events v WHERE event_type = 'view' AND NOT EXISTS (
  SELECT 1 FROM events b WHERE b.event_type = 'error' AND b.user_id = v.user_id
    AND b.ts <= v.ts AND v.ts < b.ts + INTERVAL 1 DAY)""")
def _(t):
    stream = event_stream(t).filter(F.col("event_type").isin("view", "error")).select(
        "event_id", "user_id", "ts", (F.col("event_type") == "error").alias("is_mark")
    )
    made = ops.suppress_bad(stream, "user_id", "ts", "is_mark", 86400)
    return ntz(finished(t, made, "suppress").drop("is_mark"), "ts")


@query("stream_last_peers", LAST_USERS_SQL)
def _(t):
    path = work_path(t.spark, "last-peers")
    table = tables.last_peers_table(t.spark, path, "event_type", "user_id", "ts", 8)
    answers = event_stream(t).filter("value >= 50").select("event_type", "user_id", "ts")
    tables.run_into(answers, table, lambda batch, _: batch, f"{path}-state").awaitTermination()
    return ntz(table.read(), "ts")
