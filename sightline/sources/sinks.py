"""Writers, and keyed tables kept as folded batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.files import top_dirs
from sightline.functions.ids import to_hex
from sightline.vocab import SESSION_MARKER


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sample_export(items: DataFrame, limit: int, seed: int | None = None) -> DataFrame:
    """``limit`` random named items with the fields a classifier reads."""
    named = items.filter(
        F.col("name").isNotNull() & (F.col("name") != "") & (F.col("name") != "[unknown]")
    )
    chosen = named.orderBy(F.rand(seed)).limit(limit)
    return chosen.select(
        to_hex(F.col("infohash")).alias("infohash"), "name", "file_count", "total_size",
        top_dirs(F.col("files")).alias("top_dirs"),
    )


def append_metrics(rows: DataFrame, path: str) -> None:
    """Append snapshot rows, partitioned by day; readers take the last value per (ts, name)."""
    (
        rows.withColumn("day", F.to_date("ts"))
        .write.mode("append").partitionBy("day").parquet(path)
    )


def write_metrics(rows: DataFrame, path: str, number: int) -> None:
    """Store the snapshot rows (ts, metric_name, metric_value) of one write.

    Writes are numbered, as micro-batches are; a write that is repeated replaces its own folder, and
    of several writes of one (ts, name) the greatest number counts, in whatever order they end.
    """
    rows.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/write={number}")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(ts, metric_name, metric_value): the last write of each."""
    return spark.read.parquet(path).groupBy("ts", "metric_name").agg(
        F.max_by("metric_value", "write").alias("metric_value")
    )


def session_marker(at: DataFrame, ts: str) -> DataFrame:
    """The marker row of a session start, for each time of ``at``."""
    return at.select(
        F.col(ts).alias("ts"), F.lit(SESSION_MARKER).alias("metric_name"), F.lit(0).cast("bigint").alias("metric_value")
    )


def append_session_marker(spark: SparkSession, path: str, at: Column) -> None:
    append_metrics(
        spark.range(1).select(
            at.alias("ts"), F.lit(SESSION_MARKER).alias("metric_name"),
            F.lit(0).cast("bigint").alias("metric_value"),
        ),
        path,
    )


def write_report(frames: dict[str, DataFrame], folder: str) -> None:
    """Small report frames, each as one CSV and one JSON file below its name."""
    for name, frame in frames.items():
        frame.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}/csv")
        frame.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}/json")


class FoldTable:
    """A keyed table stored as folded batches, for targets without row-level updates.

    Each batch is folded before it is written to its own ``batch=<n>`` folder; reading folds
    all batches once more. ``fold`` must give the same result however rows are grouped. Writing
    a batch again replaces it, so a repeated micro-batch changes nothing, and no write ever
    touches older data. ``compact`` writes everything up to a batch as one ``base=<n>``.
    """

    def __init__(self, spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.fold = spark, path.rstrip("/"), fold

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the completely written folders of a kind."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            folder = status.getPath()
            name = folder.getName()
            done = jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
            if name.startswith(f"{kind}=") and fs.exists(done):
                found.append(int(name.split("=")[1]))
        return sorted(found)

    def write(self, batch: DataFrame, number: int) -> None:
        """Store rows that already have the table's columns."""
        self.fold(batch).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def parts(self) -> list[str]:
        bases = self._numbers("base")
        last = bases[-1] if bases else None
        parts = [f"{self.path}/base={last}"] if bases else []
        return parts + [
            f"{self.path}/batch={n}" for n in self._numbers("batch") if last is None or n > last
        ]

    def read(self) -> DataFrame:
        parts = self.parts()
        if not parts:
            raise FileNotFoundError(f"no batches in {self.path}")
        return self.fold(self.spark.read.parquet(*parts))

    def compact(self) -> None:
        batches = self._numbers("batch")
        if batches:
            self.read().write.mode("overwrite").parquet(f"{self.path}/base={batches[-1]}")


def cached_embeddings(
    items: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], model: str,
    key: str = "infohash", text: str = "text",
) -> DataFrame:
    """Embeddings kept by (id, model, text): only rows not stored yet are embedded and appended."""
    spark = items.sparkSession
    wanted = items.withColumn("model", F.lit(model)).withColumn("text_hash", F.sha1(F.col(text)))
    on = [key, "model", "text_hash"]
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    missing = wanted
    if fs.exists(hadoop_path):
        missing = wanted.join(spark.read.parquet(path).select(*on), on, "left_anti")
    embed(missing).select(*on, "embedding").write.mode("append").parquet(path)
    stored = spark.read.parquet(path).groupBy(*on).agg(F.first("embedding").alias("embedding"))
    return wanted.join(stored, on)
