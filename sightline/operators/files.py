"""File lists as rows, and directory sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_rows(items: DataFrame, key: str, files: str = "files") -> DataFrame:
    """One row per file: id, position in the list, path segments, length."""
    return items.select(key, F.posexplode(files).alias("pos", "f")).select(
        key, "pos", F.col("f.path").alias("path"), F.col("f.length").alias("length")
    )


def directory_sizes(files: DataFrame, key: str) -> DataFrame:
    """Size of every file and directory path of each id.

    ``files`` has (key, pos, path array, length). A directory weighs what is below it. A file
    without a path is ``<unnamed>``. A later file at the same path replaces what was there
    before, including anything below it; a path that has both a file and heavier content below
    it weighs what its content weighs.
    """
    sep = "\u0000"
    path = F.when(F.size(F.coalesce(F.col("path"), F.array().cast("array<string>"))) > 0, F.col("path")).otherwise(
        F.array(F.lit("<unnamed>"))
    )
    leaves = (
        files.select(key, "pos", path.alias("parts"), F.coalesce("length", F.lit(0)).alias("own"))
        .withColumn("path", F.array_join("parts", sep))
        .groupBy(key, "path")
        .agg(F.max_by(F.struct("pos", "parts", "own"), "pos").alias("f"))
        .select(key, "path", "f.pos", "f.parts", "f.own")
    )
    above = leaves.select(
        key, "path", "pos", "own",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("parts")),
                lambda n: F.array_join(F.slice("parts", F.lit(1), n), sep),
            )
        ).alias("node"),
    )
    # files sitting where other files have a directory: they are few, all else has no match here
    clashes = (
        above.filter(F.col("node") != F.col("path"))
        .join(
            leaves.select(key, F.col("path").alias("node"), F.col("pos").alias("top_pos")),
            [key, "node"],
        )
    )
    replaced = clashes.filter(F.col("top_pos") > F.col("pos")).select(key, "path").distinct()
    standing = clashes.join(replaced, [key, "path"], "left_anti")
    covered = (
        standing.filter(F.col("own") > 0).select(key, F.col("node").alias("path")).distinct()
    )
    weights = (
        above.join(replaced, [key, "path"], "left_anti")
        .join(covered.withColumn("_covered", F.lit(True)), [key, "path"], "left")
        .withColumn("weight", F.when(F.col("_covered"), F.lit(0)).otherwise(F.col("own")))
    )
    return weights.groupBy(key, "node").agg(F.sum("weight").alias("size")).select(
        key, F.replace(F.col("node"), F.lit(sep), F.lit("/")).alias("path"), "size"
    )
