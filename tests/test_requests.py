"""One open request an id: the walk, and the batch operator against a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import peers
from sightline.operators.requests import walk


def plainly(log, timeout):
    """Outcomes of (key, second, tie, asks) by a table of open requests, second by second."""
    out, open_ = [], {}
    for key, at, tie, asks in sorted(log, key=lambda e: (e[1], e[2])):
        for k, (sent, t) in list(open_.items()):
            if at > sent + timeout:
                out.append((k, sent, t, "timeout", None))
                del open_[k]
        if asks and key in open_:
            out.append((key, at, tie, "refused", None))
        elif asks:
            open_[key] = at, tie
        elif key in open_:
            out.append((key, *open_.pop(key), "answered", at))
    return sorted(out + [(k, *o, "timeout", None) for k, o in open_.items()], key=str)


def test_second_request_is_refused_and_a_reply_is_taken_once():
    events = [(1, "a", True), (2, "b", True), (3, "c", False), (4, "d", False), (5, "e", True)]
    steps = walk(None, events, 100)
    assert list(steps) == [("refused", 2, "b", None), ("answered", 1, "a", 3)]


def test_the_last_moment_counts():
    assert list(walk(None, [(0, 1, True), (8, 2, False)], 8)) == [("answered", 0, 1, 8)]
    assert list(walk(None, [(0, 1, True), (8, 2, True)], 8)) == [("refused", 8, 2, None)]
    assert list(walk(None, [(0, 1, True), (9, 2, False)], 8)) == [("timeout", 0, 1, None)]


@pytest.mark.parametrize("seed,keys,reply", [(1, 30, 0.4), (2, 1, 0.1), (3, 3, 0.0)])
def test_batch_against_a_plain_loop(spark, seed, keys, reply):
    """Many ids, one hot id, and an id whose requests never get a reply; times with ties."""
    draw, start = random.Random(seed), dt.datetime(2024, 1, 1)
    log = [(f"k{draw.randrange(keys)}", draw.randrange(3000), tie, draw.random() >= reply) for tie in range(900)]
    df = spark.createDataFrame([(k, start + dt.timedelta(seconds=at), tie, asks) for k, at, tie, asks in log],
                               "tx string, ts timestamp_ntz, tie long, asks boolean").repartition(4)
    got = peers.match_replies(df.filter("asks"), df.filter("not asks"), "tx", "ts", 8, tie="tie", slice_seconds=60)
    assert got.schema["ts"].dataType == got.schema["reply_ts"].dataType == df.schema["ts"].dataType
    seconds = lambda t: None if t is None else int((t - start).total_seconds())
    rows = [(r.tx, seconds(r.ts), r.tie, r.outcome, seconds(r.reply_ts)) for r in got.collect()]
    assert sorted(rows, key=str) == plainly(log, 8)


def test_no_rows(spark):
    df = spark.createDataFrame([], "tx string, ts timestamp, tie long")
    assert peers.match_replies(df, df, "tx", "ts", 8, tie="tie").collect() == []
    one = spark.createDataFrame([("a", 1)], "tx string, tie long").withColumn("ts", F.timestamp_seconds(F.lit(5)))
    assert [r.outcome for r in peers.match_replies(one, one.limit(0), "tx", "ts", 8, tie="tie").collect()] == ["timeout"]
