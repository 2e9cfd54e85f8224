"""Anomalies and moving averages against plain models."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import anomalies, lifetime, reputation

START = dt.datetime(2024, 1, 1)


def steady(spark, hours, planted):
    """Two metrics that follow the hour of the week and each other, with planted hours."""
    draw, rows = np.random.default_rng(1), []
    for n in range(hours):
        level = 40 + 30 * (n % 24 > 8) + 10 * (n % 168 > 120)
        a = level + int(draw.integers(-3, 4))
        b = 2 * a + int(draw.integers(-2, 3))
        a, b = planted.get(n, lambda a, b: (a, b))(a, b)
        rows += [(START + dt.timedelta(hours=n), "a", a), (START + dt.timedelta(hours=n), "b", b)]
    return spark.createDataFrame(rows, "hour timestamp, metric_name string, value long")


def test_planted_anomalies_are_found(spark):
    hours = 168 * 6
    planted = {200: lambda a, b: (a + 60, b), 555: lambda a, b: (a, 0), 700: lambda a, b: (a + 12, b - 24)}
    hourly = steady(spark, hours, planted).cache()
    found = {(int((r.hour - START).total_seconds() // 3600), r.metric_name) for r in anomalies.anomalies(hourly, least_spread=4.0).filter("anomaly").collect()}
    assert {(200, "a"), (555, "b")} <= found and len(found) <= 0.01 * 2 * hours
    # each value of hour 700 alone is near the usual one, both together are not
    far = anomalies.distances(hourly, ["a", "b"]).orderBy(F.col("distance").desc()).limit(3).collect()
    assert {int((r.hour - START).total_seconds() // 3600) for r in far} == {200, 555, 700}


def test_distances_are_mahalanobis_distances(spark):
    hourly = steady(spark, 300, {})
    got = {r.hour: r.distance for r in anomalies.distances(hourly, ["a", "b"]).collect()}
    wide = hourly.groupBy("hour").pivot("metric_name", ["a", "b"]).sum("value").toPandas().sort_values("hour")
    x = wide[["a", "b"]].to_numpy(float)
    d = x - x.mean(axis=0)
    want = np.einsum("ni,ij,nj->n", d, np.linalg.inv(np.cov(x.T)), d)
    assert np.allclose([got[h.to_pydatetime()] for h in wide.hour], want)
    twice = hourly.union(hourly.filter("metric_name = 'a'").withColumn("metric_name", F.lit("c")))
    again = anomalies.distances(twice, ["a", "b", "c"]).collect()  # c is a: one direction has no variance
    assert np.allclose(sorted(r.distance for r in again), sorted(want))


def test_sketches_of_two_stretches_merge(spark):
    hourly = steady(spark, 168 * 5, {}).cache()
    cut = F.lit(START + dt.timedelta(hours=401))
    parts = [anomalies.sketches(hourly.filter(F.col("hour") < cut)), anomalies.sketches(hourly.filter(F.col("hour") >= cut))]
    key = lambda rows: sorted(map(tuple, rows.collect()), key=str)
    assert key(anomalies.usual(hourly, anomalies.merged(*parts))) == key(anomalies.usual(hourly))


def test_hours_without_events_count_zero(spark):
    rows = [(START, "a"), (START + dt.timedelta(hours=3, minutes=5), "b"), (START, "other")]
    events = spark.createDataFrame(rows, "ts timestamp, kind string")
    got = {(r.hour.hour, r.metric_name): r.value for r in anomalies.hourly_counts(events, "ts", "kind", ["a", "b"]).collect()}
    assert got == {(h, m): int((h, m) in ((0, "a"), (3, "b"))) for h in range(4) for m in "ab"}
    assert anomalies.hourly_counts(events.limit(0), "ts", "kind", ["a"]).collect() == []


@pytest.mark.parametrize("rate,slice_seconds", [(0.1, 600), (0.5, 50), (0.9, 100_000)])
def test_average_against_a_loop(spark, rate, slice_seconds):
    """One peer holds most rows; blocks end inside slices, slices inside peers, times tie."""
    draw = random.Random(int(rate * 10))
    log = [("hot" if draw.random() < 0.8 else f"p{draw.randrange(9)}", draw.randrange(4000), n, draw.random() * 50) for n in range(1500)]
    df = spark.createDataFrame([(k, START + dt.timedelta(seconds=s), n, x) for k, s, n, x in log], "peer string, ts timestamp, n long, x double")
    got = {r.n: r.ema for r in reputation.moving_average(df.repartition(5), "peer", "ts", "x", rate, tie="n", slice_seconds=slice_seconds).collect()}
    state = {}
    for k, _, n, x in sorted(log, key=lambda e: (e[1], e[2])):
        state[k] = x if k not in state else (1 - rate) * state[k] + rate * x
        assert got[n] == pytest.approx(state[k], rel=1e-9)
    assert len(got) == len(log)


def test_reputation_of_peers(spark):
    rows = [("a", 1, True, 10.0), ("a", 2, False, None), ("a", 3, True, 20.0), ("b", 1, False, None)]
    df = spark.createDataFrame([(k, START + dt.timedelta(seconds=s), s, ok, x) for k, s, ok, x in rows],
                               "peer string, ts timestamp, n long, ok boolean, took double")
    got = {r.peer: r for r in reputation.reputations(df, "peer", "ts", "ok", "took", tie="n", rate=0.5).collect()}
    assert (got["a"].success_ema, got["a"].rtt_ema, got["a"].query_count, got["a"].fail_count) == (0.75, 15.0, 3, 1)
    assert (got["b"].success_ema, got["b"].rtt_ema, got["b"].last_response) == (0.0, None, None)


def product_limit(lives):
    """The curve of (whole hours, ended) by its definition."""
    curve, share = {}, 1.0
    for hour in sorted({h for h, _ in lives}):
        risk = sum(h >= hour for h, _ in lives)
        ends = sum(h == hour and e for h, e in lives)
        share *= 1 - ends / risk
        if ends:
            curve[hour] = (risk, ends, share)
    return curve


def test_survival_curve(spark):
    draw = random.Random(8)
    lives = [(draw.choice("ab"), draw.expovariate(1 / 40), draw.random() < 0.6) for _ in range(400)] + [("c", 5.0, True), ("d", 7.0, False)]
    df = spark.createDataFrame([*lives, ("a", None, True)], "kind string, age double, ended boolean")
    curve = lifetime.survival(df, ["kind"]).cache()
    for kind in "abcd":
        want = product_limit([(int(age), e) for k, age, e in lives if k == kind])
        got = {r.hour: (r.at_risk, r.ends, pytest.approx(r.survival)) for r in curve.filter(F.col("kind") == kind).collect()}
        assert got == want
        if kind in "ab":
            half = min(h for h, v in want.items() if v[2] <= 0.5)
            assert lifetime.median_lifetime(curve, ["kind"]).filter(F.col("kind") == kind).first().median_hours == half


def test_silent_ids_have_ended(spark):
    rows = [(START, START + dt.timedelta(hours=10)), (START, START + dt.timedelta(hours=95)), (START, START)]
    df = spark.createDataFrame(rows, "first_seen timestamp, last_seen timestamp")
    got = lifetime.lifetimes(df, F.lit(START + dt.timedelta(hours=100)), 24).collect()
    assert [(r.ended, r.age) for r in got] == [(True, 10.0), (False, 100.0), (True, 0.0)]


def test_lifetime_regression_finds_the_effect(spark):
    """Weibull lives that double with every step of x, a third of them cut off."""
    draw = np.random.default_rng(4)
    x = draw.integers(0, 4, 3000)
    age = 50 * np.exp(0.7 * x) * draw.weibull(1.5, 3000)
    cut = 20 + 800 * draw.random(3000)
    df = spark.createDataFrame([(float(a), float(min(t, c)), bool(t <= c)) for a, t, c in zip(x, age, cut)], "x double, age double, ended boolean")
    model = lifetime.fit_lifetime(df, ["x"])
    assert model.coefficients[0] == pytest.approx(0.7, abs=0.05) and model.scale == pytest.approx(1 / 1.5, abs=0.05)
    assert lifetime.lifetime_features(df, ["x"]).transform(model.transform).count() == 3000
