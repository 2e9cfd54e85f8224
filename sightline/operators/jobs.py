"""Verification jobs: retry fold, claims, recovery and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.timing import plus_seconds, time_chunk
from sightline.operators.scans import DEFAULT_SLICE_SECONDS, count_since
from sightline.vocab import (
    BACKLOG_STATES,
    MAX_RETRIES,
    RETRY_BASE_SECONDS,
    RETRY_BEYOND_TABLE_SECONDS,
    RETRY_TABLE_SECONDS,
)


def summarise_outcomes(
    outcomes: DataFrame, key: str = "infohash", *, ts: str = "ts",
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Summary per id and time slice: did it succeed, how many failures came after the last
    success (or in all), and what the last of them looked like.

    Rows of one id are ordered by time, and a failure precedes a success of the same moment.
    """
    success = F.col("outcome") == "verified"
    rows = outcomes.select(
        key, "outcome", "error", ts, time_chunk(F.col(ts), slice_seconds).alias("_slice")
    )
    group = Window.partitionBy(key, "_slice")
    rows = rows.withColumn("_success_ts", F.max(F.when(success, F.col(ts))).over(group))
    open_failure = (F.col("outcome") == "failed") & (
        F.col("_success_ts").isNull() | (F.col(ts) > F.col("_success_ts"))
    )
    return rows.groupBy(key, "_slice").agg(
        F.max(success).alias("succeeded"),
        F.count_if(open_failure).alias("failures"),
        F.max_by("error", F.when(open_failure, F.struct(ts, "error"))).alias("last_error"),
        F.max_by(
            "error", F.when(open_failure & F.col("error").isNotNull(), F.struct(ts, "error"))
        ).alias("kept_error"),
        F.max(F.when(open_failure, F.col(ts))).alias("failed_at"),
    )


def merge_summaries(summaries: DataFrame, key: str = "infohash", order: str = "_slice") -> DataFrame:
    """Combine the summaries of an id along ``order`` into one, which keeps the last ``order``."""
    whole = Window.partitionBy(key)
    since = summaries.withColumn(
        "_since", F.max(F.when(F.col("succeeded"), F.col(order))).over(whole)
    ).filter(F.col("_since").isNull() | (F.col(order) >= F.col("_since")))
    has_failure = F.col("failures") > 0
    return since.groupBy(key).agg(
        F.max("succeeded").alias("succeeded"),
        F.sum("failures").alias("failures"),
        F.max_by("last_error", F.when(has_failure, F.col(order))).alias("last_error"),
        F.max_by(
            "kept_error", F.when(F.col("kept_error").isNotNull(), F.col(order))
        ).alias("kept_error"),
        F.max("failed_at").alias("failed_at"),
        F.max(order).alias(order),
    )


def retry_delay(failures_before: Column, schedule: str = "exponential") -> Column:
    """Seconds to wait after a failure that had this many before it."""
    if schedule == "exponential":
        return F.lit(RETRY_BASE_SECONDS).cast("bigint") * F.pow(
            F.lit(2.0), failures_before
        ).cast("bigint")
    delay = F.lit(RETRY_BEYOND_TABLE_SECONDS)
    for index, seconds in reversed(list(enumerate(RETRY_TABLE_SECONDS))):
        delay = F.when(failures_before == index, F.lit(seconds)).otherwise(delay)
    return delay.cast("bigint")


def jobs_from_summaries(
    merged: DataFrame, key: str = "infohash", schedule: str = "exponential"
) -> DataFrame:
    """Job rows of the ids that have failed since their last success."""
    before = F.col("failures") - 1
    dead = (F.col("failures") >= MAX_RETRIES) | (
        (F.coalesce(F.col("last_error"), F.lit("")) == "no_peers") & (before >= 1)
        if schedule == "exponential"
        else F.lit(False)
    )
    return merged.filter(F.col("failures") > 0).select(
        key,
        F.when(dead, F.lit("dead")).otherwise(F.lit("failed")).alias("status"),
        F.col("failures").cast("int").alias("retry_count"),
        F.when(~dead, plus_seconds(F.col("failed_at"), retry_delay(before, schedule))).alias(
            "next_retry_at"
        ),
        F.col("kept_error").alias("last_error"),
        F.col("failed_at").alias("updated_at"),
    )


def fold_outcomes(
    outcomes: DataFrame, key: str = "infohash", *, ts: str = "ts",
    schedule: str = "exponential", slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Final job table of an outcome log; an id whose last outcome is a success has no row."""
    summaries = summarise_outcomes(outcomes, key, ts=ts, slice_seconds=slice_seconds)
    return jobs_from_summaries(merge_summaries(summaries, key), key, schedule)


def number_attempts(outcomes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Attempt number of each outcome since the id's previous success (1, 2, ...)."""
    return count_since(outcomes, [key], order, F.col("outcome") == "verified", output="attempt")


def is_due(as_of: Column) -> Column:
    """A failed job whose wait is over and that may still be retried."""
    return (
        (F.col("status") == "failed")
        & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of))
        & (F.col("retry_count") < MAX_RETRIES)
    )


def claim_due(jobs: DataFrame, as_of: Column, limit: int = 1000, key: str = "infohash") -> DataFrame:
    """Ids to hand out next: 7 in 10 fresh, the rest retries, neither share lending to the other."""
    fresh_limit = max(1, limit * 7 // 10)
    retry_limit = max(1, limit - fresh_limit)
    fresh = (
        jobs.filter(F.col("status") == "pending")
        .orderBy(F.col("next_retry_at").asc_nulls_first(), key)
        .limit(fresh_limit)
    )
    retries = (
        jobs.filter(is_due(as_of))
        .orderBy("retry_count", F.col("next_retry_at").asc_nulls_last(), key)
        .limit(retry_limit)
    )
    return fresh.select(key, "retry_count").union(retries.select(key, "retry_count")).distinct()


def mark_claimed(jobs: DataFrame, claimed: DataFrame, as_of: Column, key: str = "infohash") -> DataFrame:
    """The job table after a claim."""
    flags = claimed.select(key, F.lit(True).alias("_claimed"))
    hit = F.coalesce(F.col("_claimed"), F.lit(False))
    return (
        jobs.join(flags, key, "left")
        .withColumn("status", F.when(hit, F.lit("verifying")).otherwise(F.col("status")))
        .withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at")))
        .select(*jobs.columns)
    )


def recover_stale(jobs: DataFrame, as_of: Column, stale_seconds: int = 300) -> DataFrame:
    """Claims older than five minutes become pending again, due at once."""
    stale = (F.col("status") == "verifying") & (
        F.col("updated_at") < plus_seconds(as_of, -stale_seconds)
    )
    return jobs.select(
        *[c for c in jobs.columns if c not in ("status", "next_retry_at", "updated_at")],
        F.when(stale, F.lit("pending")).otherwise(F.col("status")).alias("status"),
        F.when(stale, as_of).otherwise(F.col("next_retry_at")).alias("next_retry_at"),
        F.when(stale, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*jobs.columns)


def retain(
    jobs: DataFrame, as_of: Column, dead_seconds: int = 86400, verified_seconds: int = 3600
) -> DataFrame:
    """Drop dead rows older than a day and verified rows older than an hour."""
    expired = (
        (F.col("status") == "dead") & (F.col("updated_at") < plus_seconds(as_of, -dead_seconds))
    ) | (
        (F.col("status") == "verified")
        & (F.col("updated_at") < plus_seconds(as_of, -verified_seconds))
    )
    return jobs.filter(~F.coalesce(expired, F.lit(False)))


def add_missing_jobs(jobs: DataFrame, ids: DataFrame, status: str, as_of: Column, key: str = "infohash") -> DataFrame:
    """Insert-if-absent: rows for ids that have no job yet."""
    pending = status == "pending"
    known = {
        "status": F.lit(status),
        "retry_count": F.lit(0),
        "next_retry_at": as_of if pending else F.lit(None),
        "last_error": F.lit(None),
        "updated_at": as_of,
    }
    new = ids.select(key).distinct().join(jobs.select(key), key, "left_anti")
    kinds = {f.name: f.dataType for f in jobs.schema.fields}
    rows = new.select(*[
        F.col(key) if c == key else known[c].cast(kinds[c]).alias(c) for c in jobs.columns
    ])
    return jobs.unionByName(rows)


def retry_counts(ids: DataFrame, jobs: DataFrame, key: str = "infohash") -> DataFrame:
    """Retry count per id, 0 for ids without a job."""
    return ids.join(jobs.select(key, "retry_count"), key, "left").withColumn(
        "retry_count", F.coalesce(F.col("retry_count"), F.lit(0))
    )


def remove_verified(jobs: DataFrame, verified: DataFrame, key: str = "infohash") -> DataFrame:
    return jobs.join(verified.select(key), key, "left_anti")


def queue_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count_if(F.col("status").isin(BACKLOG_STATES)).alias("queue_backlog"),
        F.count_if(F.col("status") == "verifying").alias("verifying"),
    )
