"""Running values per key that stay parallel when one key holds much of the data.

A plain window over one key sorts all its rows in one task. Here a key's rows are first
split into time slices: each slice is one window group, a small summary per slice is
carried along the slices, and the carried value is joined back. The carried window sees one
row per (key, slice), so its group size is bounded by the time span, not by the row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sightline.functions.timing import micros, time_chunk

DEFAULT_SLICE_SECONDS = 600


def with_slices(df: DataFrame, order: list[str], slice_seconds: int) -> DataFrame:
    """Add ``_slice``, the number of the time slice of the first order column."""
    return df.withColumn("_slice", time_chunk(F.col(order[0]), slice_seconds))


def within_slice(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "_slice").orderBy(*order)


def earlier_slices(keys: list[str]) -> WindowSpec:
    """All earlier slices of a key, for frames with one row per (key, slice)."""
    return Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)


def sliced_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running columns per key; ``order[0]`` is the time column, keys are non-null.

    ``sums`` are running sums up to and including the row; ``lasts`` are the latest non-null
    value strictly before the row; ``maxes`` are the largest value strictly before the row,
    which for values that grow along the order is the latest one at the price of a plain
    hash aggregate.
    """
    sums, lasts, maxes = sums or {}, lasts or {}, maxes or {}
    rows = with_slices(df, order, slice_seconds)
    position = F.struct(*order)

    summary = rows.groupBy(*keys, "_slice").agg(
        *[F.sum(e).alias(f"_sum_{n}") for n, e in sums.items()],
        *[
            F.max_by(F.struct(e.alias("v")), F.when(e.isNotNull(), position)).alias(f"_last_{n}")
            for n, e in lasts.items()
        ],
        *[F.max(e).alias(f"_max_{n}") for n, e in maxes.items()],
    )
    earlier = earlier_slices(keys)
    carried = summary.select(
        *keys,
        "_slice",
        *[F.sum(f"_sum_{n}").over(earlier).alias(f"_carry_{n}") for n in sums],
        *[
            F.last(f"_last_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}")
            for n in lasts
        ],
        *[F.max(f"_max_{n}").over(earlier).alias(f"_carry_{n}") for n in maxes],
    )

    within = within_slice(keys, order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carried, [*keys, "_slice"], "left")
    added = {
        **{n: F.sum(e).over(upto) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0))
           for n, e in sums.items()},
        **{n: F.coalesce(F.last(e, ignorenulls=True).over(before), F.col(f"_carry_{n}.v"))
           for n, e in lasts.items()},
        **{n: F.greatest(F.max(e).over(before), F.col(f"_carry_{n}")) for n, e in maxes.items()},
    }
    return joined.select(*df.columns, *[c.alias(n) for n, c in added.items()])


def episode_starts(
    df: DataFrame, keys: list[str], order: list[str], pause_us: int, *,
    slice_seconds: int = DEFAULT_SLICE_SECONDS, output: str = "episode",
) -> DataFrame:
    """Add the start (in microseconds) of the stretch without a pause each row belongs to.

    A new stretch begins where a key has been silent for longer than ``pause_us``. Inside a
    slice this shows locally; only a slice's first row needs the last time of an earlier slice.
    """
    us = micros(F.col(order[0]))
    rows = with_slices(df, order, slice_seconds).withColumn("_us", us)
    within = within_slice(keys, order)
    local = rows.withColumn("_gap", F.col("_us") - F.lag("_us").over(within)).withColumn(
        "_start", F.when(F.col("_gap") > pause_us, F.col("_us"))
    )
    summary = local.groupBy(*keys, "_slice").agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_final"), F.max("_start").alias("_inner")
    )
    along = Window.partitionBy(*keys).orderBy("_slice")
    silent = F.col("_first") - F.lag("_final").over(along)
    opened = summary.withColumn(
        "_opening", F.when(silent.isNull() | (silent > pause_us), F.col("_first"))
    ).withColumn(
        "_carried",
        F.coalesce(
            F.col("_opening"),
            F.last(F.coalesce("_inner", "_opening"), ignorenulls=True).over(earlier_slices(keys)),
        ),
    )
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = local.join(opened.select(*keys, "_slice", "_carried"), [*keys, "_slice"], "left")
    return joined.select(
        *df.columns,
        F.coalesce(F.max("_start").over(upto), F.col("_carried")).alias(output),
    )


def count_since(
    df: DataFrame, keys: list[str], order: list[str], mark: Column, *,
    slice_seconds: int = DEFAULT_SLICE_SECONDS, output: str = "n",
) -> DataFrame:
    """Add how many rows of the key lie after the latest earlier marked row, this one included."""
    rows = with_slices(df, order, slice_seconds)
    within = within_slice(keys, order)
    marked_at = F.when(mark, F.col("_at"))
    placed_rows = rows.withColumn("_at", F.row_number().over(within).cast("bigint"))
    local = placed_rows.withColumn(
        "_mark", F.max(marked_at).over(within.rowsBetween(Window.unboundedPreceding, -1))
    )
    summary = placed_rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"), F.max(marked_at).alias("_mark"))
    earlier = earlier_slices(keys)
    total = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    placed = summary.withColumn("_before", total)
    carried = placed.select(
        *keys, "_slice",
        (F.col("_before") - F.coalesce(
            F.last(F.col("_before") + F.col("_mark"), ignorenulls=True).over(earlier), F.lit(0)
        )).alias("_open"),
    )
    joined = local.join(carried, [*keys, "_slice"], "left")
    return joined.select(
        *df.columns,
        F.when(F.col("_mark").isNotNull(), F.col("_at") - F.col("_mark"))
        .otherwise(F.col("_at") + F.col("_open")).alias(output),
    )
