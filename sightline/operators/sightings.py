"""Sighting fold, metadata fold and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.timing import time_chunk


def _presence(sources: Column) -> Column:
    """Map of each source to 1."""
    return F.map_from_entries(
        F.transform(
            F.array_sort(sources),
            lambda s: F.struct(s.alias("key"), F.lit(1).cast("bigint").alias("value")),
        )
    )


def fold_sightings(
    events: DataFrame, key: str = "infohash", *, source: str = "source", ts: str = "ts",
    count_sources: bool = False, sources: list[str] | None = None,
) -> DataFrame:
    """One row per id: first and last time seen, sources, number of sightings.

    Sources form a presence map with values 1; ``count_sources`` gives true counts instead.
    With the list of possible ``sources`` all buffers are of fixed width and stay in the hash
    aggregate; a source outside the list is an error. All aggregates combine on the map side,
    so a hot id shuffles one row per task.
    """
    span = [F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")]
    if sources and not count_sources:
        names = sorted(sources)
        flags = events.groupBy(key).agg(
            *span,
            *[F.max(F.col(source) == s).alias(f"_is_{i}") for i, s in enumerate(names)],
            F.count_if(~F.col(source).isin(names)).alias("_other"),
            F.count(F.lit(1)).alias("total_seen"),
        )
        found = F.array_compact(F.array(*[
            F.when(F.col(f"_is_{i}"), F.lit(s)) for i, s in enumerate(names)
        ]))
        checked = F.when(F.col("_other") > 0, F.raise_error(F.lit(f"source not in {names}"))).otherwise(found)
        return flags.select(
            key, "first_seen", "last_seen", _presence(checked).alias("source_counts"), "total_seen"
        )
    if not count_sources:
        return events.groupBy(key).agg(
            *span,
            _presence(F.collect_set(source)).alias("source_counts"),
            F.count(F.lit(1)).alias("total_seen"),
        )
    per_source = events.groupBy(key, source).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("n")
    )
    return per_source.groupBy(key).agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col(source).isNotNull(), F.struct(source, "n"))))
        ).alias("source_counts"),
        F.sum("n").alias("total_seen"),
    )


def merge_sightings(*parts: DataFrame, key: str = "infohash") -> DataFrame:
    """Fold sighting rows that were folded before (stored rows, micro-batches, imports)."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    flat = rows.withColumn("_sources", F.map_keys("source_counts"))
    return flat.groupBy(key).agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        _presence(F.array_distinct(F.flatten(F.collect_set("_sources")))).alias("source_counts"),
        F.sum("total_seen").alias("total_seen"),
    )


def imported_sightings(ids: DataFrame, ts: str, key: str = "infohash") -> DataFrame:
    """Sighting rows of a legacy import: source ``legacy``, adding nothing to the count.

    A new id still starts at 1, which ``apply_import`` sees to.
    """
    return ids.groupBy(key).agg(
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.create_map(F.lit("legacy"), F.lit(1).cast("bigint")).alias("source_counts"),
        F.lit(0).cast("bigint").alias("total_seen"),
    )


def apply_import(stored: DataFrame, imported: DataFrame, key: str = "infohash") -> DataFrame:
    """Stored sightings after a legacy import: known ids keep their count, new ids get 1."""
    merged = merge_sightings(stored, imported, key=key)
    return merged.withColumn("total_seen", F.greatest(F.col("total_seen"), F.lit(1)))


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps; the right value wins."""
    empty = F.from_json(F.lit("{}"), "map<string,bigint>")
    return F.map_zip_with(
        F.coalesce(left, empty), F.coalesce(right, empty), lambda k, a, b: F.coalesce(b, a)
    )


def latest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Whole-row last-wins fold; ties beyond ``order`` are the caller's to break."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
        .select(*df.columns)
    )


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Exact first-seen deduplication."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
        .select(*df.columns)
    )


def rotating_dedupe(
    events: DataFrame, key: str, order: list[str], period_seconds: int
) -> DataFrame:
    """Drop ids already let through in the current or the previous period.

    Two generations of seen ids, rotated by time: an id that was dropped is not entered
    again, so one that keeps coming gets through in every other period of a run. Rows are
    reduced to the first of each (id, period) before any ordering.
    """
    periods = events.withColumn("_period", time_chunk(F.col(order[0]), period_seconds))
    firsts = first_rows(periods, [key, "_period"], order)
    per_id = Window.partitionBy(key).orderBy("_period")
    runs = firsts.withColumn("_run", F.col("_period") - F.row_number().over(per_id))
    in_run = Window.partitionBy(key, "_run").orderBy("_period")
    return (
        runs.withColumn("_at", F.row_number().over(in_run))
        .filter(F.col("_at") % 2 == 1)
        .select(*events.columns)
    )


def unseen(events: DataFrame, known: DataFrame, key: str = "infohash") -> DataFrame:
    """Rows whose id is not in a table of known ids."""
    return events.join(known.select(key), key, "left_anti")


def distinct_ids(events: DataFrame, key: str, approximate: bool = True, rsd: float = 0.01) -> DataFrame:
    """Number of distinct ids; the sketch has fixed size, the exact form shuffles every id once."""
    if approximate:
        return events.agg(F.approx_count_distinct(key, rsd).alias("unique_ids"))
    return events.select(key).distinct().agg(F.count(F.lit(1)).alias("unique_ids"))
