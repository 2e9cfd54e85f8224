"""Readers of the file inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.ids import parse_hex_id
from sightline.schemas import ANCHORS, FEWSHOT, ITEMS, LABEL_MAP, PREDICTIONS


def read_jsonl(
    spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None
) -> DataFrame:
    """One JSON object per line, blank lines skipped; ``limit`` takes any that many rows."""
    rows = spark.read.schema(schema).json(path)
    return rows if not limit else rows.limit(limit)


def read_json_array(
    spark: SparkSession, path: str, schema: T.StructType, index: str | None = None
) -> DataFrame:
    """A file that holds one JSON array, or one JSON object per line when named .jsonl.

    ``index`` adds the row's position: in the array, or counted over the lines in file order.
    """
    if path.endswith(".jsonl"):
        if not index:
            return read_jsonl(spark, path, schema)
        lines = spark.read.text(path).filter(F.trim("value") != "")
        numbered = lines.rdd.zipWithIndex().map(lambda pair: (pair[0][0], pair[1])).toDF(
            T.StructType([
                T.StructField("value", T.StringType()), T.StructField(index, T.LongType()),
            ])
        )
        return numbered.select(F.from_json("value", schema).alias("r"), index).select("r.*", index)
    if not index:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    # one file is one partition, which numbers its rows in order
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn(index, F.monotonically_increasing_id())


def merge_item_fields(rows: DataFrame) -> DataFrame:
    """One spelling for fields that inputs name in several ways."""
    return rows.select(
        F.coalesce("infohash", "id", F.lit("")).alias("infohash"),
        F.coalesce("infohash", "idx", F.lit("")).alias("key"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("file_count", F.lit(0)).alias("file_count"),
        F.coalesce("total_size", "total_size_bytes", F.lit(0)).alias("total_size"),
        F.coalesce("top_dirs", "files", F.array().cast("array<string>")).alias("top_dirs"),
        "label_category",
        "label_keep",
        F.coalesce("true_category", "label_category", F.lit("")).alias("gold"),
    )


def read_items(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Rows to classify or labelled rows."""
    return merge_item_fields(read_jsonl(spark, path, ITEMS, limit))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    rows = read_jsonl(spark, path, PREDICTIONS)
    return rows.withColumn("key", F.coalesce("infohash", "idx", F.lit("")))


def read_hex_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file with one 40-digit hex id per line; other lines are skipped."""
    ends = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"
    lines = spark.read.text(path).select(F.regexp_replace("value", ends, "").alias("value"))
    return lines.select(parse_hex_id(F.col("value")).alias("infohash")).filter(
        F.col("infohash").isNotNull()
    )


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """(category, text, place) of the anchor file, in file order."""
    entries = read_json_array(spark, path, ANCHORS, index="_entry")
    return entries.select("category", "_entry", F.posexplode("anchors").alias("_n", "text")).select(
        "category", "text", (F.shiftleft("_entry", 32) + F.col("_n")).alias("place")
    )


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(idx, category, keep) of a CSV file with a header or a JSON-lines file; never executed."""
    if path.endswith(".csv"):
        return spark.read.schema(LABEL_MAP).option("header", True).csv(path)
    return read_jsonl(spark, path, LABEL_MAP)


def read_fewshot(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, FEWSHOT)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of an existing database; needs its driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
