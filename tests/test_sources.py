import datetime as dt
import json

from pyspark.sql import functions as F

from sightline import schemas
from sightline.operators.evaluate import convert_labels
from sightline.operators.jobs import add_missing_jobs
from sightline.operators.sightings import fold_sightings
from sightline.sources import files, sinks
from sightline.streaming.tables import sightings_table

START = dt.datetime(2024, 1, 1)


def write(path, text):
    path.write_text(text)
    return str(path)


def test_items(spark, tmp_path):
    rows = [
        {"infohash": "h1", "name": "a", "total_size": 5, "top_dirs": ["d"]},
        {"id": "i2", "total_size_bytes": 7, "files": ["f"], "true_category": "Games", "label_category": "Music"},
        {"idx": "3"},
    ]
    path = write(tmp_path / "x.jsonl", "\n\n".join(json.dumps(r) for r in rows))
    got = {r.infohash: r for r in files.read_items(spark, path).collect()}
    assert (got["h1"].total_size, got["h1"].top_dirs) == (5, ["d"])
    assert (got["i2"].total_size, got["i2"].top_dirs, got["i2"].gold) == (7, ["f"], "Games")
    assert (got[""].key, got[""].name, got[""].top_dirs, got[""].file_count) == ("3", "", [], 0)
    assert files.read_items(spark, path, limit=2).count() == 2


def test_label_conversion_from_files(spark, tmp_path):
    rows = [{"id": "a", "label_category": "Movies", "label_keep": False}, {"id": "b"}, {"id": "c"}, {"id": "d", "label_category": ""}]
    array = write(tmp_path / "s.json", json.dumps(rows))
    lines = write(tmp_path / "s.jsonl", "\n".join(json.dumps(r) for r in rows))
    labels = write(tmp_path / "map.csv", "idx,category,keep\n0,Games,true\n1,Music,false\n3,Anime,true\n")
    for path in (array, lines):
        sample = files.read_json_array(spark, path, schemas.ITEMS, index="row_idx")
        got = {r.id: (r.label_category, r.label_keep) for r in convert_labels(sample, files.read_label_map(spark, labels)).collect()}
        assert got == {"a": ("Movies", False), "b": ("Music", False), "d": ("Anime", True)}


def test_anchors_keep_their_order(spark, tmp_path):
    path = write(tmp_path / "a.json", json.dumps([
        {"category": "Games", "anchors": ["x", "y"]}, {"category": "Music", "anchors": ["z"]},
    ]))
    got = [(r.category, r.text) for r in files.read_anchors(spark, path).orderBy("place").collect()]
    assert got == [("Games", "x"), ("Games", "y"), ("Music", "z")]


def test_hex_ids(spark, tmp_path):
    good = "AB" * 20
    path = write(tmp_path / "d.txt", f" {good} \n{good}0\n{'zz' * 20}\n\n{'01' * 20}\n")
    got = sorted(bytes(r.infohash).hex() for r in files.read_hex_ids(spark, path).collect())
    assert got == ["01" * 20, "ab" * 20]


def events(spark, *rows):
    return spark.createDataFrame([(k, s, START + dt.timedelta(minutes=m)) for k, s, m in rows],
                                 "infohash string, source string, ts timestamp")


def test_fold_table_repeated_batch_and_compaction(spark, tmp_path):
    table = sightings_table(spark, str(tmp_path / "t"))
    one = fold_sightings(events(spark, ("a", "get_peers", 1), ("a", "get_peers", 2), ("b", "get_peers", 3)))
    two = fold_sightings(events(spark, ("a", "announce_peer", 9)))
    table.write(one, 0)
    table.write(two, 1)
    table.write(two, 1)

    def state():
        return {r.infohash: (r.total_seen, r.source_counts, r.last_seen.minute) for r in table.read().collect()}

    expected = {"a": (3, {"get_peers": 1, "announce_peer": 1}, 9), "b": (1, {"get_peers": 1}, 3)}
    assert state() == expected
    table.compact()
    assert [p.rsplit("/", 1)[1] for p in table.parts()] == ["base=1"]
    table.write(two, 2)
    assert state()["a"][0] == 4


def test_metrics_files_and_marker(spark, tmp_path):
    path = str(tmp_path / "m")
    sinks.append_metrics(spark.createDataFrame([(START, "a", 1)], "ts timestamp, metric_name string, metric_value long"), path)
    sinks.append_session_marker(spark, path, F.lit(START))
    got = {r.metric_name: r.metric_value for r in spark.read.parquet(path).collect()}
    assert got == {"a": 1, "_session_start": 0}


def test_embedding_cache_embeds_only_new_rows(spark, tmp_path):
    seen = []

    def embed(rows):
        seen.append(sorted(r.infohash for r in rows.collect()))
        return rows.withColumn("embedding", F.array(F.length("text").cast("float")))

    path = str(tmp_path / "cache")
    rows = lambda *r: spark.createDataFrame(r, "infohash string, text string")
    sinks.cached_embeddings(rows(("a", "x"), ("b", "yy")), path, embed, "m1")
    got = sinks.cached_embeddings(rows(("a", "x"), ("b", "changed"), ("c", "z")), path, embed, "m1")
    assert seen == [["a", "b"], ["b", "c"]]
    assert {r.infohash: r.embedding[0] for r in got.collect()} == {"a": 1.0, "b": 7.0, "c": 1.0}


def test_missing_jobs_leave_known_ones(spark):
    jobs = spark.createDataFrame([(b"a", "failed", 2, START, "no_peers", START)], schemas.JOBS)
    ids = spark.createDataFrame([(b"a",), (b"b",), (b"b",)], "infohash binary")
    got = {bytes(r.infohash): (r.status, r.retry_count) for r in add_missing_jobs(jobs, ids, "verified", F.lit(START)).collect()}
    assert got == {b"a": ("failed", 2), b"b": ("verified", 0)}
