import datetime as dt

import pytest
from pyspark.sql import functions as F

from sightline.operators import metrics, search
from sightline.operators.sightings import fold_sightings, rotating_dedupe
from sightline.vocab import METRIC_NAMES, SESSION_MARKER

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def frame(spark, rows):
    return spark.createDataFrame([(at(m), n, v) for m, n, v in rows], "ts timestamp, metric_name string, metric_value long")


def test_current_values(spark):
    df = frame(spark, [
        (-200, "old", 1), (-100, "a", 99), (0, SESSION_MARKER, 0),
        (0, "a", 10), (59, "a", 20), (61, "a", 30), (125, "a", 100),
        (10, "fell", 50), (90, "fell", 5), (10, "new", 5),
    ])
    got = {r.metric_name: r for r in metrics.current_values(df).collect()}
    assert set(got) == {"a", "fell", "new"}
    assert (got["a"].value_1h_ago, got["a"].rate) == (30, pytest.approx(70 / (64 / 60)))
    assert (got["fell"].value_1h_ago, got["fell"].rate) == (50, None)
    assert (got["new"].value_1h_ago, got["new"].hours_elapsed, got["new"].rate) == (0, None, None)


def test_nothing_without_a_session(spark):
    df = frame(spark, [(0, "a", 1), (70, "a", 2)])
    assert metrics.current_values(df).count() == 0
    assert metrics.history(df, "a").count() == 0


@pytest.mark.parametrize("name", ["", SESSION_MARKER, "_hidden"])
def test_history_refuses_inner_names(spark, name):
    with pytest.raises(ValueError):
        metrics.history(frame(spark, [(0, "a", 1)]), name)


def test_rates_skip_resets(spark):
    rows = [("a", 0, 10), ("a", 1_800_000, 15), ("a", 3_600_000, 3), ("a", 7_200_000, 4)]
    df = spark.createDataFrame(rows, "metric_name string, t long, value long")
    got = [(r.t, r.rate) for r in metrics.rates(df).orderBy("t").collect()]
    assert got == [(1_800_000, 10.0), (3_600_000, None), (7_200_000, 1.0)]


def test_snapshot_names(spark):
    wide = spark.range(1).select(F.lit(START).alias("ts"), *[F.lit(i).alias(n) for i, n in enumerate(METRIC_NAMES)])
    rows = {r.metric_name: r.metric_value for r in metrics.snapshot_to_rows(wide).collect()}
    assert len(rows) == 50 and rows["inbound_ping"] == 0 and rows["utp_metadata_ok"] == 49


def test_share_without_traffic(spark):
    df = spark.createDataFrame([(0, 0), (1, 3)], "a long, b long")
    got = [r.s for r in df.select(metrics.share_percent(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [0.0, 25.0]


def items(spark):
    rows = [("a", "Blue Widget", 5), ("b", None, None), ("c", "blue_wid%get", 7), ("d", "red", 5), ("e", "widgets, blue", None)]
    return spark.createDataFrame(rows, "infohash string, name string, total_size long").withColumn(
        "verified_at", F.lit(START))


def test_search(spark):
    df = items(spark)
    names = lambda d: [r.infohash for r in d.collect()]
    assert sorted(names(search.search(df, "blue widget"))) == ["a", "c", "e"]
    assert names(search.search(df, "_wid%")) == ["c"]
    assert names(search.search(df, None, "size", "desc")) == ["b", "e", "c", "a", "d"]
    assert names(search.search(df, None, "size", "asc")) == ["a", "d", "c", "b", "e"]
    assert names(search.search(df, None, "size", "asc", page=2, limit=2)) == ["c", "b"]
    assert names(search.search(df, None, "size", "asc", limit=2, after=(5, "d"))) == ["c", "b"]
    assert names(search.search(df, None, "size", "desc", limit=2, after=(None, "b"))) == ["e", "c"]
    assert search.search_total(df, "zzz").first().asDict() == {"total": 0, "pages": 1}
    assert search.page_bounds(0, 1000) == (1, 100) and search.page_bounds(None, None) == (1, 25)


def test_similarity_of_words(spark):
    from sightline.functions.text import term_trigrams, trigram_similarity, trigrams

    df = spark.createDataFrame([("Foo-Bär 2x",)], "n string")
    row = df.select(F.sort_array(trigrams(F.col("n"))).alias("t"), trigram_similarity(F.col("n"), "foo").alias("s")).first()
    assert row.t == sorted(term_trigrams("Foo-Bär 2x")) and "  2" in row.t
    assert row.s == pytest.approx(4 / 11)


def test_unknown_source_is_an_error(spark):
    df = spark.createDataFrame([("a", "x", START)], "infohash string, source string, ts timestamp")
    with pytest.raises(Exception, match="source not in"):
        fold_sightings(df, sources=["get_peers"]).collect()


def test_rotating_dedupe_lets_every_other_period_through(spark):
    rows = [("a", at(10 * p), p) for p in (0, 0, 1, 2, 3, 5)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i int")
    got = sorted(r.i for r in rotating_dedupe(df, "k", ["ts", "i"], 600).collect())
    assert got == [0, 2, 5]
