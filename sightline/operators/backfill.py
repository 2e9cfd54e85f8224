"""Backfill of the keyed tables from the files of an older store, as one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.jobs import add_missing_jobs
from sightline.operators.sightings import apply_import, imported_sightings, latest_rows
from sightline.session import store
from sightline.sources.files import read_hex_ids
from sightline.sources.payloads import decode_payloads
from sightline.sources.records import read_records

#: The names of the two files of a data folder.
RECORDS, IDS = "metadata.bin", "discovered.txt"
FIELDS = ["name", "piece_length", "total_size", "file_count", "files"]


@dataclass
class Backfilled:
    """The tables after the import, and how many records and ids were read."""

    sightings: DataFrame
    metadata: DataFrame
    jobs: DataFrame
    records: int
    ids: int


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def updated_metadata(stored: DataFrame, new: DataFrame, as_of: Column, key: str = "infohash") -> DataFrame:
    """Known ids take the new fields and keep their own times and counts; new ids start with ``as_of``."""
    fresh = new.select(key, *[F.col(c).alias(f"_{c}") for c in FIELDS], F.lit(True).alias("_new"))
    joined = stored.withColumn("_known", F.lit(True)).join(fresh, key, "full")
    kinds = {f.name: f.dataType for f in stored.schema}
    start = {"fetch_attempts": F.lit(0), "verified_at": as_of}

    def value(column: str) -> Column:
        if column == key:
            return F.col(key)
        if column in FIELDS:
            return F.when(F.col("_new"), F.col(f"_{column}").cast(kinds[column])).otherwise(F.col(column))
        first = start.get(column, F.lit(None)).cast(kinds[column])
        return F.when(F.col("_known"), F.col(column)).otherwise(first)

    return joined.select(*[value(c).alias(c) for c in stored.columns])


def backfill(
    spark: SparkSession, folder: str, as_of: Column, sightings: DataFrame, metadata: DataFrame, jobs: DataFrame,
) -> Backfilled:
    """Import the record file (or folder) and the id list of ``folder`` into the tables.

    Payloads are taken as they are, also where they are not what their id says. The last record of an id
    wins. Ids of records get a verified job, listed ids a pending one, unless they have a job. A file
    that is not there counts as empty.
    """
    none = spark.createDataFrame([], "infohash binary")
    new = spark.createDataFrame([], "infohash binary, payload binary, file string, at bigint")
    if _there(spark, f"{folder}/{RECORDS}"):
        new = read_records(spark, f"{folder}/{RECORDS}", places=True)
    listed = read_hex_ids(spark, f"{folder}/{IDS}") if _there(spark, f"{folder}/{IDS}") else none
    # each file is read once
    kept = store(decode_payloads(new).drop("payload"), "records")
    listed = store(listed, "listed-ids")
    seen = kept.select("infohash").union(listed)
    return Backfilled(
        sightings=apply_import(sightings, imported_sightings(seen.withColumn("ts", as_of), "ts")),
        metadata=updated_metadata(metadata, latest_rows(kept, ["infohash"], ["file", "at"]), as_of),
        jobs=add_missing_jobs(add_missing_jobs(jobs, kept, "verified", as_of), listed, "pending", as_of),
        records=kept.count(), ids=listed.count(),
    )
