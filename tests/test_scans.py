import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators.scans import count_since, episode_starts, sliced_scan

START = dt.datetime(2024, 1, 1)


def log(seed, n=400, keys=3):
    """Hits of a few keys, one of them with most rows; times repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else f"k{rng.randrange(keys)}"
        at = START + dt.timedelta(seconds=rng.choice([rng.randrange(7200), rng.randrange(60) * 60]))
        rows.append((key, at, i, rng.random() < 0.3, rng.randrange(9)))
    return rows


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_loops(spark, seed):
    rows = log(seed)
    df = spark.createDataFrame(rows, "k string, ts timestamp, i long, m boolean, v long")
    scanned = sliced_scan(
        df, ["k"], ["ts", "i"], slice_seconds=300, sums={"s": F.col("v")},
        lasts={"last_marked": F.when(F.col("m"), F.col("v")), "prev": F.col("i")},
        maxes={"top": F.when(F.col("m"), F.col("v"))},
    )
    scanned = count_since(scanned, ["k"], ["ts", "i"], F.col("m"), slice_seconds=300, output="n")
    scanned = episode_starts(scanned, ["k"], ["ts", "i"], 45_000_000, slice_seconds=300)
    got = {r.i: (r.s, r.last_marked, r.prev, r.n, r.episode, r.top) for r in scanned.collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        total, marked, prev, n, begin, last, top = 0, None, None, 0, None, None, None
        for _, ts, i, m, v in group:
            total, n = total + v, n + 1
            us = int((ts - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
            if last is None or us - last > 45_000_000:
                begin = us
            last = us
            assert got[i] == (total, marked, prev, n, begin, top)
            prev = i
            if m:
                marked, n = v, 0
                top = v if top is None else max(top, v)
