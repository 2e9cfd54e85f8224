"""Each stream, cut into several files in time order, equals its batch form."""

from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.operators import jobs, peers, reputation, throttle
from sightline.operators.sightings import fold_sightings
from sightline.plans.registry import Tables
from sightline.plans.streams import finished, finished_whole, reply_log
from sightline.plans.verification import outcomes
from sightline.streaming import events as ops
from sightline.streaming import tables
from sightline.streaming.sources import read_files

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """State stores are per partition; two are enough here."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def batch(spark):
    return Tables(spark, FOLDER).events.withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.fixture(scope="module")
def cut(spark, batch, tmp_path_factory):
    """The events as five files whose modification order is their time order."""
    folder = tmp_path_factory.mktemp("events")
    bounds = [r.t for r in batch.select(F.explode(F.percentile_approx("ts", [0.2, 0.4, 0.6, 0.8])).alias("t")).collect()]
    edges = [None, *bounds, None]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        part = batch
        part = part if low is None else part.filter(F.col("ts") >= low)
        part = part if high is None else part.filter(F.col("ts") < high)
        import time
        part.toPandas().to_parquet(folder / f"p{i}.parquet", coerce_timestamps="us")
        time.sleep(0.05)
    return str(folder)


def stream(spark, cut, batch):
    return read_files(spark, cut, batch.schema, files_per_trigger=1)


def same(a, b):
    columns = sorted(a.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, a.select(columns).collect()), key=key) == sorted(
        map(tuple, b.select(columns).collect()), key=key)


def as_sightings(df):
    return df.select(F.col("user_id").alias("infohash"), F.col("event_type").alias("source"), "ts")


def test_sightings(spark, cut, batch, tmp_path):
    table = tables.sightings_table(spark, str(tmp_path / "t"))
    tables.run_sightings(as_sightings(stream(spark, cut, batch)), table, str(tmp_path / "c"), compact_every=2).awaitTermination()
    assert len(table._numbers("batch")) == 5 and table._numbers("base")
    cols = ["infohash", "first_seen", "last_seen", "total_seen", "n"]
    flat = lambda df: df.withColumn("n", F.size("source_counts")).select(cols)
    same(flat(table.read()), flat(fold_sightings(as_sightings(batch))))


def test_jobs(spark, cut, batch, tmp_path):
    class T:
        pass

    t, s = T(), T()
    t.events, s.events = batch, stream(spark, cut, batch)
    table = tables.jobs_table(spark, str(tmp_path / "t"))
    tables.run_outcomes(outcomes(s).drop("event_id"), table, str(tmp_path / "c"), compact_every=2).awaitTermination()
    same(tables.read_jobs(table), jobs.fold_outcomes(outcomes(t)))


def test_throttle(spark, cut, batch):
    made = ops.rate_limit(stream(spark, cut, batch).select("event_id", "user_id", "ts"), "user_id", "ts", 1 / 36000, 3.0, 86400.0)
    expected = throttle.rate_limit(
        batch.select("event_id", "user_id", "ts"), "user_id", "ts", 1 / 36000, 3.0, tie="event_id", idle_seconds=86400.0)
    t = type("T", (), {"spark": spark})
    same(finished(t, made, "throttle"), expected)


def test_suppression(spark, cut, batch):
    marked = lambda df: df.filter(F.col("event_type").isin("view", "error")).select(
        "event_id", "user_id", "ts", (F.col("event_type") == "error").alias("is_mark"))
    made = ops.suppress_bad(marked(stream(spark, cut, batch)), "user_id", "ts", "is_mark", 86400)
    both = marked(batch)
    expected = peers.suppress_bad(both.filter(~F.col("is_mark")), both.filter("is_mark").drop("is_mark"), "user_id", "ts", 86400, tie="event_id")
    t = type("T", (), {"spark": spark})
    same(finished(t, made, "suppress"), expected)


def test_minute_counts(spark, cut, batch):
    make = lambda events: ops.counts(events.select("event_type", "ts"), "event_type", "ts")
    got = finished_whole(spark, lambda: stream(spark, cut, batch), batch, make, "counts", 3600)
    same(got, batch.groupBy(F.date_trunc("minute", "ts").alias("ts"), F.col("event_type").alias("metric_name")).agg(
        F.count(F.lit(1)).alias("n")))


def test_replies(spark, cut, batch):
    """Five files of events in time order, and the same events in one batch; every request has an outcome."""
    make = lambda events: ops.correlate(reply_log(events), "user_id", "ts", "asks", "event_id", 6 * 3600, "1 hour")
    got = finished_whole(spark, lambda: stream(spark, cut, batch), batch, make, "replies", 24 * 3600)
    of = lambda kind: batch.filter(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    expected = peers.match_replies(of("view"), of("click"), "user_id", "ts", 6 * 3600, tie="event_id")
    same(got, expected)
    assert got.count() == of("view").count()


def test_moving_average(spark, cut, batch):
    make = lambda events: ops.moving_average(events, "user_id", "ts", "value", 0.2, tie="event_id", late="1 hour")
    got = finished_whole(spark, lambda: stream(spark, cut, batch), batch, make, "ema", 24 * 3600)
    expected = reputation.moving_average(batch.select("user_id", "ts", "event_id", "value"), "user_id", "ts", "value", 0.2, tie="event_id")
    rounded = lambda df: df.withColumn("ema", F.round("ema", 9))
    same(rounded(got), rounded(expected))


class _Held:
    """State in memory that counts its entries."""

    def __init__(self):
        self.value = []

    def exists(self):
        return bool(self.value)

    def get(self):
        return iter(self.value) if isinstance(self.value, list) else self.value

    def appendList(self, entries):
        self.value = [*self.value, *entries]

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = []


def test_waiting_events_share_entries():
    """Events are sent and stored together, however many wait, and still come out in order."""
    made = ops._Average(0.5, T.LongType())
    made.kept, made.waiting, made.handle = _Held(), _Held(), SimpleNamespace(registerTimer=lambda ms: None)
    rows = [Row(key=1, ts=None, us=us, tie=us, x=float(us)) for us in reversed(range(3000))] + [Row(key=1, ts=None, us=9000, tie=0, x=None)]
    list(made.handleInputRows((1,), iter(rows), None))
    assert len(made.waiting.value) == 3
    passed = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    first = list(made.handleExpiredTimer((1,), passed(1), None))
    assert [r.us for r in first] == list(range(1001)) and len(made.waiting.value) == 2
    rest = list(made.handleExpiredTimer((1,), passed(9), None))
    assert [r.us for r in rest] == list(range(1001, 3000)) and not made.waiting.exists()
    ema = None
    for r in first + rest:
        ema = r.x if ema is None else 0.5 * ema + 0.5 * r.x
        assert r.ema == ema


def test_last_peers(spark, cut, batch, tmp_path):
    of = lambda df: df.filter("value >= 50").select("event_type", "user_id", "ts")
    table = tables.last_peers_table(spark, str(tmp_path / "t"), "event_type", "user_id", "ts", 8)
    tables.run_into(of(stream(spark, cut, batch)), table, lambda b, _: b, str(tmp_path / "c"), compact_every=2).awaitTermination()
    expected = peers.last_peers(of(batch), "event_type", "user_id", "ts", 8)
    same(table.read(), expected)
    since = expected.agg(F.percentile_approx("ts", 0.5)).first()[0]
    recent = peers.last_peers(table.read(), "event_type", "user_id", "ts", 8, F.lit(since))
    assert 0 < recent.count() < expected.count() and recent.filter(F.col("ts") < since).count() == 0
