"""Reputation of a peer: exponential moving averages along its outcomes.

A step of the average, r -> (1 - a) r + a x, is an affine map, and maps compose: any run of rows is
one pair (keep, add) with r -> keep r + add. So the log of a peer is cut into time slices and these into
blocks of ``BLOCK`` rows; blocks are summed up natively, composed per slice, slices per peer, and what
comes in is handed back down. No task sorts more than one slice, and a group that is folded in one
place holds one pair per block of a slice, or per slice of a peer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.scans import DEFAULT_SLICE_SECONDS, with_slices

BLOCK = 64


def _composed(parts: Column, start: Column) -> Column:
    """For each (keep, add) of a sorted list the value before it, and last the value after all."""
    return F.aggregate(
        parts, F.array(start), lambda acc, p: F.concat(acc, F.array(p["keep"] * F.element_at(acc, -1) + p["add"]))
    )


def moving_average(
    log: DataFrame, key: str, ts: str, value: str, rate: float, *, tie: str,
    slice_seconds: int = DEFAULT_SLICE_SECONDS, output: str = "ema",
) -> DataFrame:
    """Add the moving average of ``value`` along each key, which starts at the key's first value."""
    if not 0 < rate < 1:
        raise ValueError("the rate must lie between 0 and 1")
    keep = 1.0 - rate
    rows = with_slices(log, [ts], slice_seconds).withColumn("_x", F.col(value).cast("double"))
    along = Window.partitionBy(key, "_slice").orderBy(ts, tie)
    at = F.row_number().over(along) - 1
    placed = rows.withColumn("_at", at).withColumns({
        "_block": F.floor(F.col("_at") / BLOCK), "_in": (F.col("_at") % BLOCK + 1).cast("double"),
    })
    # sums of x / keep^i, brought to the scale of the row they end at
    inside = Window.partitionBy(key, "_slice", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.lit(rate) * F.col("_x") * F.pow(F.lit(keep), -F.col("_in"))
    run = placed.withColumns({
        "_keep": F.pow(F.lit(keep), F.col("_in")), "_add": F.sum(scaled).over(inside) * F.pow(F.lit(keep), F.col("_in")),
    })
    blocks = run.groupBy(key, "_slice", "_block").agg(
        F.min("_keep").alias("keep"), F.max_by("_add", "_in").alias("add"),
    )
    # each block as a pair, and where a slice as a whole leads: fold with the unknown start as (1, 0)
    listed = blocks.groupBy(key, "_slice").agg(
        F.array_sort(F.collect_list(F.struct("_block", "keep", "add"))).alias("_list")
    )
    slices = listed.select(
        key, "_slice", "_list", F.aggregate("_list", F.lit(1.0), lambda a, p: a * p["keep"]).alias("keep"),
        F.element_at(_composed(F.col("_list"), F.lit(0.0)), -1).alias("add"),
    )
    first = log.groupBy(key).agg(F.min_by(F.col(value).cast("double"), F.struct(ts, tie)).alias("_start"))
    per_key = slices.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_slice", "keep", "add"))).alias("_slices")
    ).join(first, key)
    entering = per_key.select(
        key, F.explode(F.arrays_zip(F.col("_slices._slice").alias("s"), _composed(F.col("_slices"), F.col("_start")).alias("v"))).alias("e")
    ).select(key, F.col("e.s").alias("_slice"), F.col("e.v").alias("_enter")).filter(F.col("_slice").isNotNull())
    block_enter = slices.select(key, "_slice", "_list").join(entering, [key, "_slice"]).select(
        key, "_slice", F.explode(F.arrays_zip(F.col("_list._block").alias("b"), _composed(F.col("_list"), F.col("_enter")).alias("v"))).alias("e")
    ).select(key, "_slice", F.col("e.b").alias("_block"), F.col("e.v").alias("_enter")).filter(F.col("_block").isNotNull())
    return run.join(block_enter, [key, "_slice", "_block"]).select(
        *log.columns, (F.col("_keep") * F.col("_enter") + F.col("_add")).alias(output)
    )


def reputations(
    log: DataFrame, key: str, ts: str, ok: str, took: str, *, tie: str, rate: float = 0.1,
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """One row per peer: its averages after the last outcome, counts, and when it last answered.

    ``ok`` says whether a query was answered; ``took`` is its round trip, which counts where it was.
    """
    options = {"tie": tie, "slice_seconds": slice_seconds}
    judged = moving_average(log.withColumn("_ok", F.col(ok).cast("double")), key, ts, "_ok", rate, output="_rate", **options)
    trips = moving_average(log.filter(F.col(ok)), key, ts, took, rate, output="_trip", **options)
    last = F.struct(ts, tie)
    return judged.groupBy(key).agg(
        F.max_by("_rate", last).alias("success_ema"), F.count(F.lit(1)).alias("query_count"),
        F.count_if(~F.col(ok)).alias("fail_count"), F.max(F.when(F.col(ok), F.col(ts))).alias("last_response"),
    ).join(trips.groupBy(key).agg(F.max_by("_trip", last).alias("rtt_ema")), key, "left")
