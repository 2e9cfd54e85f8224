"""Streams that keep folded tables: sightings, metadata and jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sightline.operators.jobs import jobs_from_summaries, merge_summaries, summarise_outcomes
from sightline.operators.peers import last_peers
from sightline.operators.sightings import fold_sightings, latest_rows, merge_sightings
from sightline.sources.sinks import FoldTable


def run_into(
    stream: DataFrame, table: FoldTable, prepare: Callable[[DataFrame, int], DataFrame],
    checkpoint: str, trigger: dict | None = None, compact_every: int | None = None,
) -> StreamingQuery:
    """Write each micro-batch as one batch of a folded table; repeating a batch is harmless."""

    def store(batch: DataFrame, number: int) -> None:
        table.write(prepare(batch, number), number)
        if compact_every and number and number % compact_every == 0:
            table.compact()

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def sightings_table(spark, path: str, key: str = "infohash") -> FoldTable:
    return FoldTable(spark, path, lambda rows: merge_sightings(rows, key=key))


def run_sightings(stream: DataFrame, table: FoldTable, checkpoint: str, key: str = "infohash", **options) -> StreamingQuery:
    """Sighting events into the sightings table (columns key, source, ts)."""
    return run_into(stream, table, lambda batch, _: fold_sightings(batch, key), checkpoint, **options)


def metadata_table(spark, path: str, key: str = "infohash") -> FoldTable:
    return FoldTable(spark, path, lambda rows: latest_rows(rows, [key], ["batch_no", "verified_at"]))


def run_metadata(stream: DataFrame, table: FoldTable, checkpoint: str, **options) -> StreamingQuery:
    """Metadata rows into the metadata table; the newest row of an id wins whole."""
    return run_into(
        stream, table, lambda batch, number: batch.withColumn("batch_no", F.lit(number).cast("bigint")),
        checkpoint, **options,
    )


def jobs_table(spark, path: str, key: str = "infohash") -> FoldTable:
    return FoldTable(spark, path, lambda rows: merge_summaries(rows, key, "batch_no"))


def run_outcomes(stream: DataFrame, table: FoldTable, checkpoint: str, key: str = "infohash", **options) -> StreamingQuery:
    """Job outcomes into the job table's summaries; batches follow each other in time."""

    def prepare(batch: DataFrame, number: int) -> DataFrame:
        merged = merge_summaries(summarise_outcomes(batch, key), key).drop("_slice")
        return merged.withColumn("batch_no", F.lit(number).cast("bigint"))

    return run_into(stream, table, prepare, checkpoint, **options)


def read_jobs(table: FoldTable, key: str = "infohash", schedule: str = "exponential") -> DataFrame:
    return jobs_from_summaries(table.read(), key, schedule)


def last_peers_table(spark, path: str, key: str, peer: str, ts: str, count: int) -> FoldTable:
    """The last peers of each id; a batch holds ``count`` rows an id at most."""
    return FoldTable(spark, path, lambda rows: last_peers(rows, key, peer, ts, count))
