import datetime as dt
import random
from fractions import Fraction

import pytest

from sightline.operators import throttle

START = dt.datetime(2024, 1, 1)


def model(times, rate, burst, idle):
    """One bucket, hit by hit, in floating point."""
    tokens, last, out = burst, None, []
    for now in times:
        if last is None or now - last > idle:
            tokens = burst
        else:
            tokens = min(burst, tokens + (now - last) * rate)
        out.append(tokens >= 1 - 1e-9)
        if out[-1]:
            tokens -= 1
        last = now
    return out


def check(spark, logs, rate, burst, idle=600.0, width=10):
    rows, n = [], 0
    expected = {}
    for key, times in logs.items():
        times = sorted(times)
        for at, ok in zip(times, model(times, rate, burst, idle)):
            rows.append((key, START + dt.timedelta(microseconds=round(at * 1e6)), n))
            expected[n] = ok
            n += 1
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, ts timestamp, i long")
    found = throttle.rate_limit(
        df, "k", "ts", rate, burst, tie="i", idle_seconds=idle, slice_seconds=width
    )
    assert {r.i: r.allowed for r in found.collect()} == expected


def test_burst_then_refusal(spark):
    check(spark, {"a": [0.0, 0.0, 0.0, 0.0]}, 10.0, 3.0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixed_traffic_against_one_bucket(spark, seed):
    rng = random.Random(seed)
    step = lambda lo, hi: rng.randrange(lo, hi) / 64
    logs = {}
    for n, (lo, hi) in enumerate([(1, 8), (4, 20), (8, 40), (1, 3), (60, 700), (14, 19)]):
        at, times = 0.0, []
        for _ in range(400):
            at += step(lo, hi)
            if rng.random() < 0.01:
                at += rng.choice([2, 9, 40])
            times.append(at)
        logs[f"k{n}"] = times
    check(spark, logs, 4.0, 8.0, idle=30.0)


def test_key_that_is_always_over_the_limit(spark):
    rng = random.Random(9)
    times, at = [], 0.0
    for _ in range(3000):
        at += rng.randrange(1, 12) / 128
        times.append(at)
    check(spark, {"hot": times, "calm": times[::100]}, 8.0, 16.0, width=5)


def test_weekly_rate_refills():
    from sightline.operators.throttle import Bucket

    week = 7 * 86_400
    for bucket in (Bucket.of(1 / week, 1, 10 * week), Bucket.of(Fraction(1, week), 1, 10 * week)):
        units, allowed = bucket.full, []
        for _ in range(6):
            ok, units = bucket.take(units)
            allowed.append(ok)
            units = bucket.refilled(units, week * 1_000_000)
        assert allowed == [True] * 6
    with pytest.raises(ValueError):
        Bucket.of(Fraction(1, 1 << 50), 1, week)


def test_other_columns_and_null_keys_come_back_as_they_were(spark):
    rows = [(1, START, 0, 9007199254740993), (None, START, 1, None), (None, START, 2, 9007199254740995), (1, START, 3, None)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, i long, big long")
    found = throttle.rate_limit(df, "k", "ts", 1.0, 1.0, tie="i")
    assert sorted((r.i, r.k, r.big, r.allowed) for r in found.collect()) == [
        (0, 1, 9007199254740993, True), (1, None, None, True), (2, None, 9007199254740995, False), (3, 1, None, False)]
