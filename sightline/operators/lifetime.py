"""How long ids live: product-limit survival curves by cohort, and a regression on them.

An id that has been silent for longer than ``quiet`` has ended at its last sighting; any other is still
alive and only known to have lived until now (right-censored). Curves are made from counts per cohort
and whole hour of age, so the ordered step sees one row per hour of age, however many ids there are.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression, AFTSurvivalRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.timing import hours_between


def lifetimes(sightings: DataFrame, as_of: Column, quiet_hours: float, first: str = "first_seen", last: str = "last_seen") -> DataFrame:
    """Add ``age`` (hours lived, as far as known) and ``ended``."""
    ended = hours_between(F.col(last), as_of) > quiet_hours
    age = F.when(ended, hours_between(F.col(first), F.col(last))).otherwise(hours_between(F.col(first), as_of))
    return sightings.withColumns({"ended": ended, "age": age})


def survival(lives: DataFrame, by: list[str], age: str = "age", ended: str = "ended") -> DataFrame:
    """(by, hour, at_risk, ends, survival): the product-limit estimate of each cohort.

    ``at_risk`` have lived at least ``hour`` whole hours; ``survival`` is the share that outlives it. Only
    hours in which an id ended are given. Ids without an age take no part.
    """
    counts = lives.filter(F.col(age) >= 0).groupBy(*by, F.floor(age).alias("hour")).agg(
        F.count_if(F.col(ended)).alias("ends"), F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy(*by).orderBy("hour")
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    risk = counts.withColumn("at_risk", F.sum("n").over(later))
    left = F.col("at_risk") - F.col("ends")
    # a factor of 0 can only be the last
    steps = risk.withColumn("step", F.when(left > 0, F.log(left / F.col("at_risk"))).otherwise(F.lit(0.0)))
    estimate = F.when(left == 0, F.lit(0.0)).otherwise(F.exp(F.sum("step").over(upto)))
    return steps.withColumn("survival", estimate).filter("ends > 0").select(*by, "hour", "at_risk", "ends", "survival")


def median_lifetime(curve: DataFrame, by: list[str]) -> DataFrame:
    """(by, median_hours): the first hour that at most half outlive; null where more than half are alive."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("hour"))).alias("median_hours"))


def fit_lifetime(
    lives: DataFrame, features: list[str], age: str = "age", ended: str = "ended", max_iter: int = 200,
) -> AFTSurvivalRegressionModel:
    """Accelerated failure time regression (Weibull) of the age on numeric columns.

    Ages count as at least one hour. The model's ``transform`` wants the column ``features`` of
    :func:`lifetime_features`.
    """
    rows = lifetime_features(lives.filter(F.col(age) >= 0), features).select(
        "features", F.greatest(F.col(age), F.lit(1.0)).alias("label"), F.col(ended).cast("double").alias("censor")
    )
    return AFTSurvivalRegression(maxIter=max_iter).fit(rows)


def lifetime_features(lives: DataFrame, features: list[str]) -> DataFrame:
    """Add the vector column ``features``; rows with a null among them are left out."""
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(lives)
