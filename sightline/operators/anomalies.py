"""Anomalies of hourly metrics: against the same hour of other weeks, and of all metrics together.

The history is first counted per hour, which leaves a table of hours times metrics. The usual value of a
metric in an hour of the week is the median there, its spread the median distance from it. Medians come
from quantile sketches: those of a new stretch of history are merged into the stored ones, no history
is read again. (With as few values as weeks in an hour of the week a sketch holds them all.)
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns a median distance into a standard deviation of normal values.
NORMAL = 1.4826


def hourly_counts(events: DataFrame, ts: str, name: str, names: list[str]) -> DataFrame:
    """(hour, metric_name, value) for every hour from the first to the last event; 0 where nothing happened."""
    hour = F.date_trunc("hour", F.col(ts))
    counted = events.filter(F.col(name).isin(names)).groupBy(hour.alias("hour"), F.col(name).alias("metric_name")).agg(
        F.count(F.lit(1)).alias("n")
    )
    span = events.agg(F.min(hour).alias("a"), F.max(hour).alias("b")).filter(F.col("a").isNotNull())
    grid = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour")).select(
        "hour", F.explode(F.array(*map(F.lit, names))).alias("metric_name")
    )
    return grid.join(counted, ["hour", "metric_name"], "left").select(
        "hour", "metric_name", F.coalesce("n", F.lit(0)).alias("value")
    )


def hour_of_week(hour: Column) -> Column:
    return (F.weekday(hour) * 24 + F.hour(hour)).alias("hour_of_week")


def sketches(hourly: DataFrame) -> DataFrame:
    """(metric_name, hour_of_week, sketch) of the values."""
    return hourly.groupBy("metric_name", hour_of_week(F.col("hour"))).agg(
        F.kll_sketch_agg_bigint("value").alias("sketch")
    )


def merged(*parts: DataFrame) -> DataFrame:
    """One table of sketches from those of several stretches of history."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("metric_name", "hour_of_week").agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))


def _median(sketch: str) -> Column:
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(0.5))


def usual(hourly: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``hourly`` with ``usual`` (the median of its hour of the week) and ``spread`` (the median distance).

    ``stored`` sketches of the history are used in place of those of ``hourly``.
    """
    rows = hourly.withColumn("hour_of_week", hour_of_week(F.col("hour")))
    medians = (stored if stored is not None else sketches(hourly)).select(
        "metric_name", "hour_of_week", _median("sketch").alias("usual")
    )
    known = rows.join(medians, ["metric_name", "hour_of_week"])
    far = known.groupBy("metric_name", "hour_of_week").agg(
        F.kll_sketch_agg_bigint(F.abs(F.col("value") - F.col("usual"))).alias("sketch")
    ).select("metric_name", "hour_of_week", _median("sketch").alias("spread"))
    return known.join(far, ["metric_name", "hour_of_week"]).select("hour", "metric_name", "value", "usual", "spread")


def anomalies(hourly: DataFrame, limit: float = 5.0, least_spread: float = 1.0, stored: DataFrame | None = None) -> DataFrame:
    """:func:`usual` with ``score``, the distance in spreads (of at least ``least_spread``), and ``anomaly``.

    The median distance of a handful of weeks is often near zero by chance; ``least_spread`` is then what
    keeps common hours out, and should be the size of the usual noise.
    """
    width = F.greatest(F.col("spread") * F.lit(NORMAL), F.lit(least_spread))
    score = F.abs(F.col("value") - F.col("usual")) / width
    return usual(hourly, stored).withColumn("score", score).withColumn("anomaly", F.col("score") > limit)


def distances(hourly: DataFrame, names: list[str]) -> DataFrame:
    """(hour, distance): how unusual the metrics of an hour are together.

    Squared Mahalanobis distance of the vector of all ``names`` from its mean, under the covariance of all
    hours; where metrics depend on each other exactly, directions without variance do not count.
    """
    cells = [F.sum(F.when(F.col("metric_name") == n, F.col("value")).otherwise(F.lit(0))).cast("double").alias(f"m{i}") for i, n in enumerate(names)]
    wide = hourly.groupBy("hour").agg(*cells)
    every = range(len(names))
    pairs = list(combinations_with_replacement(every, 2))
    fitted = wide.agg(
        *[F.avg(f"m{i}").alias(f"mean{i}") for i in every],
        *[F.covar_samp(f"m{i}", f"m{j}").alias(f"cov{i}_{j}") for i, j in pairs],
    ).first()
    cov = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = fitted[f"cov{i}_{j}"] or 0.0
    inverse = np.linalg.pinv(cov)
    off = [F.col(f"m{i}") - F.lit(fitted[f"mean{i}"]) for i in every]
    total = sum((F.lit(float(inverse[i, j])) * off[i] * off[j] for i in every for j in every), F.lit(0.0))
    return wide.select("hour", total.alias("distance"))
