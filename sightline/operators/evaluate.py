"""Labels and evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.vectors import guarded_ratio
from sightline.operators.sightings import latest_rows
from sightline.vocab import CATEGORIES, MALFORMED


def convert_labels(rows: DataFrame, label_map: DataFrame | None = None, index: str = "row_idx") -> DataFrame:
    """Labelled rows: a row's own label, else the map's entry at its index; others are dropped."""
    own = F.when(F.col("label_category") != "", F.col("label_category"))
    if label_map is None:
        labelled = rows.withColumn("label_category", own).withColumn(
            "label_keep", F.coalesce("label_keep", F.lit(True))
        )
    else:
        entries = label_map.select(
            F.col("idx").alias(index), F.col("category").alias("_category"), F.col("keep").alias("_keep")
        )
        labelled = (
            rows.join(entries, index, "left")
            .withColumn("label_keep", F.when(
                own.isNull() & F.col("_category").isNotNull(), F.col("_keep")
            ).otherwise(F.coalesce("label_keep", F.lit(True))))
            .withColumn("label_category", F.coalesce(own, F.col("_category")))
            .drop("_category", "_keep")
        )
    return labelled.filter(
        F.col("label_category").isNotNull() & (F.col("label_category") != "")
    )


def judged(
    labels: DataFrame, predictions: DataFrame, key: str, gold: str = "gold", predicted: str = "category",
    order: str | None = None,
) -> DataFrame:
    """(gold, pred) per label; MALFORMED without a prediction or when parsing it failed.

    With ``order``, repeated keys keep their last row on both sides.
    """
    if order:
        labels = latest_rows(labels, [key], [order])
        predictions = latest_rows(predictions, [key], [order])
    status = (
        F.coalesce(F.col("parse_status"), F.lit("success"))
        if "parse_status" in predictions.columns else F.lit("success")
    )
    answers = predictions.select(
        key,
        F.when(status != "success", F.lit(MALFORMED))
        .otherwise(F.coalesce(F.col(predicted), F.lit("Other"))).alias("pred"),
    )
    return labels.select(key, F.coalesce(F.col(gold), F.lit("")).alias("gold")).join(
        answers, key, "left"
    ).select("gold", F.coalesce("pred", F.lit(MALFORMED)).alias("pred"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion(pairs: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Gold rows by predicted columns, MALFORMED last; all categories get a row."""
    names = sorted(categories or CATEGORIES)
    spark = pairs.sparkSession
    counted = pairs.groupBy("gold").agg(
        *[F.count_if(F.col("pred") == c).alias(c) for c in names + [MALFORMED]]
    )
    golds = spark.createDataFrame([(c,) for c in names], "gold string")
    return golds.join(counted, "gold", "left").na.fill(0)


def class_report(pairs: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of each category that occurs as gold."""
    names = sorted(categories or CATEGORIES)
    counts = pair_counts(pairs)
    known_gold = F.col("gold").isin(names + [MALFORMED])
    by_gold = counts.filter(F.col("gold").isin(names)).groupBy(F.col("gold").alias("category")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"),
    )
    by_pred = counts.filter(known_gold).groupBy(F.col("pred").alias("category")).agg(
        F.sum("n").alias("predicted")
    )
    p, r = F.col("precision"), F.col("recall")
    return (
        by_gold.join(by_pred, "category", "left")
        .withColumn("predicted", F.coalesce("predicted", F.lit(0)))
        .withColumn("precision", guarded_ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", guarded_ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", guarded_ratio(2 * p * r, p + r))
        .select("category", "precision", "recall", "f1", "support")
    )


def eval_summary(pairs: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Totals, accuracy over the well-formed and macro averages over the reported categories."""
    macro = class_report(pairs, categories).agg(
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )
    macro_row = macro.select(F.struct("*").alias("m")).scalar()
    bad = F.col("pred") == MALFORMED
    totals = pairs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(bad).alias("parse_fail"),
        F.count_if(~bad & (F.col("gold") == F.col("pred"))).alias("correct"),
    )
    evaluated = F.col("total") - F.col("parse_fail")
    return totals.select(
        "total",
        evaluated.alias("evaluated"),
        "parse_fail",
        (guarded_ratio(F.col("parse_fail"), F.col("total")) * 100.0).alias("parse_fail_percent"),
        "correct",
        guarded_ratio(F.col("correct"), evaluated).alias("accuracy"),
        macro_row.alias("_m"),
    ).select("*", "_m.*").drop("_m")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Count of each class and its balanced weight n / (k * count)."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    return counts.select(label, "n", totals.alias("_t")).select(
        label, "n", (F.col("_t.n") / (F.col("_t.k") * F.col("n"))).alias("weight")
    )


def with_class_weight(rows: DataFrame, label: str, output: str = "weight") -> DataFrame:
    """Attach the balanced weight of its class to each row; rows without a label are a class too."""
    weights = class_weights(rows, label).select(F.col(label).alias("_class"), F.col("weight").alias(output))
    return rows.join(weights, F.col(label).eqNullSafe(F.col("_class"))).drop("_class")


def report_frames(pairs: DataFrame, categories: list[str] | None = None) -> dict[str, DataFrame]:
    """The evaluation as frames by name: one summary row, the classes, the confusion counts."""
    return {
        "summary": eval_summary(pairs, categories),
        "classes": class_report(pairs, categories),
        "confusion": confusion(pairs, categories),
    }
