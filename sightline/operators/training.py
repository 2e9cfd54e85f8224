"""Training of the linear classifiers."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.operators.evaluate import with_class_weight
from sightline.session import store

SPLIT_SLICES = 4096


def stratified_split(
    rows: DataFrame, label: str, key: str, test_fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: in each class, the given share of rows with the smallest key hashes.

    Exact without sorting a class in one task: hash slices are counted, the slice in which the
    share ends is found from the counts, and ranks are only taken within slices.
    """
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).withColumn(
        "_slice", F.pmod(F.col("_h"), F.lit(SPLIT_SLICES))
    )
    along = Window.partitionBy(label).orderBy("_slice")
    counts = hashed.groupBy(label, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(
        F.col(label).alias("_class"), F.col("_slice").alias("_at"),
        (F.sum("_n").over(along) - F.col("_n")).alias("_before"),
        F.round(F.sum("_n").over(Window.partitionBy(label)) * test_fraction).alias("_want"),
    )
    rank = F.row_number().over(Window.partitionBy(label, "_slice").orderBy("_h", key))
    return (
        hashed.join(before, F.col(label).eqNullSafe(F.col("_class")) & (F.col("_slice") == F.col("_at")))
        .withColumn("is_test", F.col("_before") + rank <= F.col("_want"))
        .drop("_h", "_slice", "_class", "_at", "_before", "_want")
    )


@dataclass
class Trained:
    """A fitted classifier: class names in index order and a scorer of feature rows."""

    classes: list[str]
    algorithm: str
    models: list

    def predict(self, rows: DataFrame, vector: str = "embedding", output: str = "linear") -> DataFrame:
        """Add all classes with their probability, best first, and the best as ``pred``."""
        scored = rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
        if self.algorithm == "logreg":
            model = self.models[0]
            scored = model.transform(scored).withColumn("_p", vector_to_array("probability"))
            scored = scored.drop("rawPrediction", "probability", "prediction")
        else:
            scored = scored.withColumn("_f", vector_to_array("features"))
            scored = scored.withColumn("_p", self._calibrated(F.col("_f"))).drop("_f")
        labels = F.array(*[F.lit(c) for c in self.classes])
        ranked = F.sort_array(
            F.zip_with("_p", labels, lambda p, c: F.struct(p.alias("confidence"), c.alias("category"))),
            asc=False,
        )
        best_first = F.transform(
            ranked, lambda x: F.struct(x["category"].alias("category"), x["confidence"].alias("confidence"))
        )
        return (
            scored.withColumn(output, best_first)
            .withColumn("pred", F.col(output)[0]["category"])
            .drop("_p", "features")
        )

    def _calibrated(self, features: Column) -> Column:
        """Mean over folds of each class's sigmoid, scaled to sum to 1 within a fold."""
        folds = [
            tuple(np.array(part, dtype="float64") for part in zip(*fold)) for fold in self.models
        ]

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def score(vectors: pd.Series) -> pd.Series:
            data = np.stack(vectors.to_list()) if len(vectors) else np.empty((0, folds[0][0].shape[1]))
            total = 0.0
            for weights, intercepts, slopes, shifts in folds:
                margins = data @ weights.T + intercepts
                raw = 1.0 / (1.0 + np.exp(-(slopes * margins + shifts)))
                sums = raw.sum(axis=1, keepdims=True)
                total = total + np.where(sums > 0, raw / np.where(sums > 0, sums, 1), 1 / raw.shape[1])
            return pd.Series(list(total / len(folds)))

        return score(features)


def _class_names(rows: DataFrame, label: str) -> list[str]:
    """Class names in alphabetical order, as the label index has them."""
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc")
    return list(Pipeline(stages=[indexer]).fit(rows).stages[0].labels)


def _prepared(rows: DataFrame, label: str, vector: str, classes: list[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    return with_class_weight(rows, label).select(
        (F.array_position(names, F.col(label)) - 1).cast("double").alias("y"),
        "weight",
        array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
        *[c for c in rows.columns if c in ("_fold",)],
    )


def train_logreg(
    rows: DataFrame, label: str, vector: str = "embedding", *, c: float = 1.0, max_iter: int = 2000,
) -> Trained:
    """L2 multinomial logistic regression with balanced class weights."""
    rows = rows.withColumn(label, F.col(label).cast("string"))
    classes = _class_names(rows, label)
    data = _prepared(rows, label, vector, classes)
    n = data.count()
    fitted = LogisticRegression(
        labelCol="y", weightCol="weight", family="multinomial", standardization=False,
        regParam=1.0 / (c * n), elasticNetParam=0.0, maxIter=max_iter,
    ).fit(data)
    return Trained(classes, "logreg", [fitted])


def train_svm(
    rows: DataFrame, label: str, key: str, vector: str = "embedding", *, c: float = 1.0,
    max_iter: int = 2000, folds: int = 3, seed: int = 42, parallelism: int = 8,
) -> Trained:
    """One linear SVM per class, calibrated by a sigmoid on held-out folds, folds averaged.

    The fits of the folds and classes are independent Spark jobs, several at a time.
    """
    rows = rows.withColumn(label, F.col(label).cast("string")).withColumn(
        "_fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds))
    )
    classes = _class_names(rows, label)
    data = store(_prepared(rows, label, vector, classes), "training")
    sizes = {r["_fold"]: r["count"] for r in data.groupBy("_fold").count().collect()}

    def fit(fold: int, index: int) -> tuple:
        is_class = (F.col("y") == index).cast("double").alias("is")
        rest = data.filter(F.col("_fold") != fold).select("features", "weight", is_class)
        n = sum(sizes.values()) - sizes.get(fold, 0)
        # the model scores the held-out fold itself
        svm = LinearSVC(
            labelCol="is", weightCol="weight", maxIter=max_iter, regParam=1.0 / (c * n),
            standardization=False,
        ).fit(rest)
        held = svm.transform(data.filter(F.col("_fold") == fold).select("features", "weight", is_class))
        held = held.select(
            "is", "weight", array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("m")
        )
        sigmoid = LogisticRegression(
            labelCol="is", featuresCol="m", weightCol="weight", family="binomial",
            maxIter=max_iter,
        ).fit(held)
        return (
            [float(x) for x in svm.coefficients], float(svm.intercept),
            float(sigmoid.coefficients[0]), float(sigmoid.intercept),
        )

    tasks = [(fold, index) for fold in range(folds) for index in range(len(classes))]
    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(lambda task: fit(*task), tasks))
    fitted = [parts[f * len(classes):(f + 1) * len(classes)] for f in range(folds)]
    return Trained(classes, "svm", fitted)


def model_path(root: str, algorithm: str) -> str:
    """Where a model of this algorithm is kept; two algorithms never share a place."""
    return f"{root.rstrip('/')}/{algorithm}_category"


def save(trained: Trained, spark, root: str) -> str:
    """Write a model as rows, readable by ``load``."""
    path = model_path(root, trained.algorithm)
    if trained.algorithm == "logreg":
        trained.models[0].write().overwrite().save(f"{path}/model")
        parts = []
    else:
        parts = [
            (f, i, [float(x) for x in w], float(b), float(slope), float(shift))
            for f, fold in enumerate(trained.models) for i, (w, b, slope, shift) in enumerate(fold)
        ]
    spark.createDataFrame(
        list(enumerate(trained.classes)), "idx int, category string"
    ).write.mode("overwrite").parquet(f"{path}/classes")
    spark.createDataFrame(
        parts, "fold int, idx int, weights array<double>, intercept double, slope double, shift double"
    ).write.mode("overwrite").parquet(f"{path}/parts")
    return path


def load(spark, path: str) -> Trained:
    from pyspark.ml.classification import LogisticRegressionModel

    classes = [r.category for r in spark.read.parquet(f"{path}/classes").orderBy("idx").collect()]
    rows = spark.read.parquet(f"{path}/parts").orderBy("fold", "idx").collect()
    if not rows:
        return Trained(classes, "logreg", [LogisticRegressionModel.load(f"{path}/model")])
    folds: dict[int, list] = {}
    for r in rows:
        folds.setdefault(r.fold, []).append((list(r.weights), r.intercept, r.slope, r.shift))
    return Trained(classes, "svm", [folds[f] for f in sorted(folds)])
