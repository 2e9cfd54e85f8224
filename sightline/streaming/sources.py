"""Streaming readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_files(
    spark: SparkSession, path: str, schema: T.StructType, *, pattern: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream; a bound on files per trigger is the back-pressure."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


class Closing:
    """The end of a finite stream: after the input has been read, one row far behind it.

    Event-time operators hold back what the watermark has not passed yet, which for a finite input is
    its tail. A stream opened by :meth:`follow` also reads a folder of its own; :meth:`close` puts one
    row there that is null but for the event time, so that running the same query once more lets
    the watermark pass everything.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, ts: str):
        self.spark, self.path, self.schema, self.ts = spark, path, schema, ts
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)

    def follow(self, stream: DataFrame) -> DataFrame:
        return stream.unionByName(read_files(self.spark, self.path, self.schema))

    def close(self, rows: DataFrame, seconds: int) -> None:
        """Put the row ``seconds`` behind the latest of ``rows``."""
        last = rows.agg(F.max(self.ts).alias("t"))
        fields = [
            (F.col("t") + F.make_dt_interval(secs=F.lit(seconds))).alias(f.name) if f.name == self.ts
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in self.schema
        ]
        last.filter(F.col("t").isNotNull()).select(*fields).coalesce(1).write.mode("append").parquet(self.path)
