"""Counters over time: snapshots, current values, history, rates, sessions, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.timing import hours_between, millis, plus_seconds, seconds_between, truncate
from sightline.functions.vectors import guarded_ratio
from sightline.operators.scans import sliced_scan
from sightline.vocab import FAILURE_BREAKDOWN, INTERVALS, SESSION_MARKER, STALE_AFTER_SECONDS


def counter_series(events: DataFrame, name: str, ts: str, unit: str = "minute") -> DataFrame:
    """Cumulative count per name at the end of each unit that has events.

    Events are counted per (name, unit) first; the running sum then orders one row per unit.
    """
    counted = events.groupBy(
        F.col(name).alias("metric_name"), truncate(unit, F.col(ts)).alias("ts")
    ).agg(F.count(F.lit(1)).alias("n"))
    running = (
        Window.partitionBy("metric_name")
        .orderBy("ts")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return counted.select("ts", "metric_name", F.sum("n").over(running).alias("metric_value"))


def snapshot_to_rows(snapshot: DataFrame, ts: str = "ts") -> DataFrame:
    """Wide snapshot rows to (ts, metric_name, metric_value)."""
    names = [c for c in snapshot.columns if c != ts]
    longs = snapshot.select(ts, *[F.col(c).cast("bigint").alias(c) for c in names])
    return longs.unpivot([ts], names, "metric_name", "metric_value")


def merge_snapshots(*parts: DataFrame) -> DataFrame:
    """Upsert on (ts, metric_name): a later part replaces the value of an earlier one."""
    rows = None
    for index, part in enumerate(parts):
        numbered = part.select("ts", "metric_name", "metric_value", F.lit(index).alias("_part"))
        rows = numbered if rows is None else rows.unionByName(numbered)
    return rows.groupBy("ts", "metric_name").agg(
        F.max_by("metric_value", "_part").alias("metric_value")
    )


def session_start(metrics: DataFrame) -> DataFrame:
    """One row: the latest session marker, null when there is none."""
    return metrics.filter(F.col("metric_name") == SESSION_MARKER).agg(F.max("ts").alias("start"))


def in_session(metrics: DataFrame) -> DataFrame:
    """Rows since the latest session marker; none at all without a marker."""
    return metrics.filter(F.col("ts") >= session_start(metrics).scalar())


def number_sessions(metrics: DataFrame) -> DataFrame:
    """Session number of every row: how many markers there are up to its time."""
    is_marker = F.col("metric_name") == SESSION_MARKER
    rows = metrics.withColumn("_all", F.lit(0)).withColumn(
        "_after", F.when(is_marker, 0).otherwise(1)
    )
    scanned = sliced_scan(
        rows, ["_all"], ["ts", "_after"], sums={"session": F.when(is_marker, 1).otherwise(0)}
    )
    return scanned.select(*metrics.columns, "session")


def latest_values(metrics: DataFrame) -> DataFrame:
    """Newest row of each metric in the running session, markers left out."""
    rows = in_session(metrics).filter(F.col("metric_name") != SESSION_MARKER)
    return rows.groupBy("metric_name").agg(
        F.max_by("metric_value", "ts").alias("current_value"), F.max("ts").alias("ts")
    )


def current_values(metrics: DataFrame) -> DataFrame:
    """Newest value of each metric, its value at least an hour earlier, and the hourly rate.

    The rate is null when there is no earlier value in the session or the counter fell.
    The earlier value is reduced on the map side, so a frequent metric stays cheap; the small
    side of the join is one row per metric, which adaptive execution broadcasts when its
    measured size allows and joins by sort otherwise.
    """
    latest = latest_values(metrics)
    history = in_session(metrics).select("metric_name", "metric_value", "ts")
    cutoff = latest.select("metric_name", plus_seconds(F.col("ts"), -3600).alias("_cutoff"))
    previous = (
        history.join(cutoff, "metric_name")
        .filter(F.col("ts") <= F.col("_cutoff"))
        .groupBy("metric_name")
        .agg(F.max_by("metric_value", "ts").alias("_value"), F.max("ts").alias("_ts"))
    )
    joined = latest.join(previous, "metric_name", "left")
    hours = hours_between(F.col("_ts"), F.col("ts"))
    before = F.coalesce(F.col("_value"), F.lit(0))
    return joined.select(
        "metric_name",
        "current_value",
        "ts",
        before.alias("value_1h_ago"),
        hours.alias("hours_elapsed"),
        F.when(
            (hours > 0) & (F.col("current_value") >= before),
            (F.col("current_value") - before) / hours,
        ).alias("rate"),
    )


def history(
    metrics: DataFrame, metric: str | list[str] | None, start: Column | None = None, end: Column | None = None,
    interval: str = "minute",
) -> DataFrame:
    """Last value per bucket of the named metrics, within the running session and time range."""
    interval = interval if interval in INTERVALS else "minute"
    rows = in_session(metrics)
    if metric is None:
        rows = rows.filter(~F.col("metric_name").startswith("_"))
    else:
        names = [metric] if isinstance(metric, str) else list(metric)
        if not names or any(not n or n.startswith("_") for n in names):
            raise ValueError("metric is required")
        rows = rows.filter(F.col("metric_name").isin(names))
    if start is None and end is not None:
        start = plus_seconds(end, -3600)
    if start is not None:
        rows = rows.filter(F.col("ts") >= start)
    if end is not None:
        rows = rows.filter(F.col("ts") <= end)
    return rows.groupBy(
        "metric_name", millis(truncate(interval, F.col("ts"))).alias("t")
    ).agg(F.max_by("metric_value", "ts").alias("value"))


def rates(points: DataFrame) -> DataFrame:
    """Hourly rate between neighbouring buckets; null where the counter fell.

    ``points`` has one row per (metric_name, t), so a window holds one row per bucket.
    """
    along = Window.partitionBy("metric_name").orderBy("t")
    hours = (F.col("t") - F.col("_t")) / F.lit(3_600_000.0)
    change = F.col("value") - F.col("_value")
    return (
        points.withColumn("_t", F.lag("t").over(along))
        .withColumn("_value", F.lag("value").over(along))
        .filter(hours > 0)
        .select("metric_name", "t", F.when(change >= 0, change / hours).alias("rate"))
    )


def tick_rates(snapshots: DataFrame, names: list[str], step_seconds: float, ts: str = "ts") -> DataFrame:
    """Per-hour change of counters between fixed-step snapshots, 0 for the first one."""
    scanned = sliced_scan(
        snapshots.withColumn("_all", F.lit(0)), ["_all"], [ts], slice_seconds=3600,
        lasts={f"_{n}": F.col(n) for n in names},
    )
    return scanned.select(
        *snapshots.columns,
        *[
            ((F.col(n) - F.coalesce(F.col(f"_{n}"), F.col(n))) / step_seconds * 3600.0)
            .alias(f"{n}_per_hour")
            for n in names
        ],
    )


def aligned_series(points: DataFrame, metrics: list[str]) -> DataFrame:
    """Chart table: raw value and rate of each metric at the times of the first that has data."""
    rank = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric_name"))
    wanted = points.filter(F.col("metric_name").isin(metrics))
    base = wanted.agg(F.min(rank).alias("r")).scalar()
    both = wanted.join(rates(wanted), ["metric_name", "t"], "left").withColumn(
        "_base", rank == base
    )
    columns = []
    for m in metrics:
        is_m = F.col("metric_name") == m
        columns.append(F.max(F.when(is_m, F.floor(F.col("rate") + 0.5))).alias(m))
        columns.append(F.max(F.when(is_m, F.col("value"))).alias(f"{m}_raw"))
    return (
        both.groupBy("t")
        .agg(F.max("_base").alias("_base"), *columns)
        .filter("_base")
        .drop("_base")
    )


def status_row(
    items: DataFrame, sightings: DataFrame, jobs: DataFrame, metrics: DataFrame, as_of: Column
) -> DataFrame:
    """One row of totals, recent activity, queue state and age of the last snapshot.

    Four one-row aggregates, combined by scalar subqueries in one plan.
    """
    hour_ago, day_ago = plus_seconds(as_of, -3600), plus_seconds(as_of, -86400)
    item_counts = items.agg(
        F.struct(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("verified_at") > hour_ago).alias("hour"),
            F.count_if(F.col("verified_at") > day_ago).alias("day"),
        ).alias("c")
    ).scalar()
    seen = sightings.agg(
        F.struct(
            F.count_if(F.col("last_seen") > hour_ago).alias("seen"),
            F.count_if(F.col("first_seen") > hour_ago).alias("new"),
        ).alias("c")
    ).scalar()
    from sightline.operators.jobs import queue_counts

    queue = queue_counts(jobs).select(F.struct("queue_backlog", "verifying").alias("c")).scalar()
    beat = metrics.agg(F.max("ts").alias("c")).scalar()
    one = items.sparkSession.range(1).select(
        item_counts.alias("i"), seen.alias("s"), queue.alias("q"), beat.alias("b")
    )
    age = F.round(seconds_between(F.col("b"), as_of)).cast("bigint")
    return one.select(
        F.col("i.total").alias("total_items"),
        F.col("i.hour").alias("verified_last_1h"),
        F.col("i.day").alias("verified_last_24h"),
        F.col("s.seen").alias("seen_last_1h"),
        F.col("s.new").alias("new_last_1h"),
        F.col("q.queue_backlog").alias("queue_backlog"),
        F.col("q.verifying").alias("verifying"),
        F.col("i.total").alias("verified_total"),
        F.col("b").alias("heartbeat_ts"),
        age.alias("stale_s"),
        (age > STALE_AFTER_SECONDS).alias("is_stale"),
    )


def failure_breakdown(current: DataFrame) -> DataFrame:
    """The ten failure counters with their labels; null for one never written."""
    spark = current.sparkSession
    labels = spark.createDataFrame(
        [(i, label, name) for i, (label, name) in enumerate(FAILURE_BREAKDOWN)],
        "position int, label string, metric_name string",
    )
    return labels.join(current.select("metric_name", "current_value"), "metric_name", "left").select(
        "position", "label", "metric_name", F.col("current_value").alias("value")
    )


def share_percent(part: Column, other: Column) -> Column:
    """Share of one pool in both, in percent; 0 without traffic."""
    return guarded_ratio(part, part + other) * 100.0
