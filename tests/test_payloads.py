import hashlib
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline import schemas
from sightline.operators.backfill import backfill
from sightline.sources import payloads, records
from sightline.sources.payloads import decode, describe, split_records

SINGLE = b"d6:lengthi42e4:name5:hello12:piece lengthi16384ee"
MULTI = b"d5:filesld6:lengthi10e4:pathl3:sub5:afileeee12:piece lengthi32768ee"


def test_single_file():
    assert describe(SINGLE) == {
        "name": "hello", "piece_length": 16384, "total_size": 42, "file_count": 1, "files": None,
    }


def test_file_list():
    found = describe(MULTI)
    assert (found["file_count"], found["total_size"]) == (1, 10)
    assert found["files"] == [{"length": 10, "path": ["sub", "afile"]}]


def test_wrapped_info_negative_length_and_odd_entries():
    found = describe(b"d4:infod5:filesld6:lengthi-5e4:pathl1:ai3eeei7ed6:lengthi3eee4:name1:\xffee")
    assert found["files"] == [{"length": 0, "path": ["a"]}, {"length": 3, "path": []}]
    assert (found["total_size"], found["file_count"], found["name"]) == (3, 2, "�")


def test_sizes_stop_at_the_largest_bigint():
    big = b"d6:lengthi9223372036854775807ee"
    assert describe(b"d5:filesl" + big + big + b"ee")["total_size"] == 2**63 - 1


@pytest.mark.parametrize("data", [
    b"", b"not bencode at all", b"i9223372036854775808e", b"ie", b"i-e", b"5:abc", b"-1:a", b"l", b"d",
    b"di1ei2ee", b"i12", b"4", b"l" * 65 + b"e" * 65, b"i1x2e",
])
def test_bad_input(data):
    with pytest.raises(ValueError):
        decode(data)
    assert set(describe(data).values()) == {None}


def test_limits():
    assert decode(b"i9223372036854775807e") == 2**63 - 1
    assert decode(b"i-9223372036854775807e") == -(2**63) + 1
    assert decode(b"l" * 64 + b"e" * 64)
    assert decode(b"i1etrailing") == 1


def record(data, key=None):
    return (key or hashlib.sha1(data).digest()) + struct.pack(">I", len(data)) + data


def test_record_file(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(record(SINGLE) + record(MULTI) + b"cut header")
    (tmp_path / "b.bin").write_bytes(record(b"junk") + record(SINGLE, b"x" * 20))
    rows = records.read_records(spark, str(tmp_path)).withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp")
    )
    metadata, failed = payloads.ingest(rows, "ts")
    found = {bytes(r.infohash): r for r in metadata.collect()}
    assert len(found) == 3
    assert found[hashlib.sha1(SINGLE).digest()].total_size == 42
    assert found[hashlib.sha1(MULTI).digest()].files[0].path == ["sub", "afile"]
    assert found[hashlib.sha1(b"junk").digest()].name is None
    row, = failed.collect()
    assert (bytes(row.infohash), row.error) == (b"x" * 20, "sha1_mismatch")


def test_cut_payload_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        split_records(record(SINGLE)[:-1])
    (tmp_path / "a.bin").write_bytes(record(MULTI) + record(SINGLE)[:-1])
    with pytest.raises(Exception, match="is cut at byte"):
        records.read_records(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("range_bytes", [1, 700, 1 << 20])
def test_ranges_hold_every_record_once(spark, tmp_path, range_bytes):
    """Small, empty and large payloads over several files, ranges smaller than a record and larger than all."""
    draw = np.random.default_rng(range_bytes)
    want = []
    for n in range(3):
        data = [draw.bytes(int(s)) for s in [0, *draw.integers(0, 900, 60), 70_000, 5_000_000 if n == 1 else 1]]
        whole = b"".join(map(record, data)) + (b"x" * 23 if n else b"")
        (tmp_path / f"{n}.bin").write_bytes(whole)
        want += split_records(whole)
    (tmp_path / "empty.bin").write_bytes(b"")
    got = records.read_records(spark, str(tmp_path), range_bytes, places=True).collect()
    assert sorted((bytes(r.infohash), bytes(r.payload)) for r in got) == sorted(want)
    assert len({(r.file, r["at"]) for r in got}) == len(want)
    edges = records.record_ranges(spark, str(tmp_path), range_bytes).collect()
    assert all(e.start < e.end for e in edges) and len(edges) >= {1: 180, 700: 30, 1 << 20: 3}[range_bytes]


def test_file_above_two_gigabytes(spark, tmp_path):
    """A sparse file: 2.2 GB of zeros as payloads of 8 MB, with small ones between."""
    size, count = 8 << 20, 264
    with open(tmp_path / "big.bin", "wb") as out:
        for n in range(count):
            out.write(n.to_bytes(20, "big") + size.to_bytes(4, "big"))
            out.seek(size, 1)
            out.write(record(b"small", (n + 1000).to_bytes(20, "big")))
    assert (tmp_path / "big.bin").stat().st_size > 2 << 30
    ranges = records.record_ranges(spark, str(tmp_path)).collect()
    assert len(ranges) >= 30
    got = records.read_records(spark, str(tmp_path)).groupBy(F.octet_length("payload").alias("n")).agg(
        F.count("*").alias("rows"), F.countDistinct("infohash").alias("ids")).collect()
    assert {(r.n, r.rows, r.ids) for r in got} == {(size, count, count), (5, count, count)}


def test_written_records_are_read_again(spark, tmp_path):
    rows = [(hashlib.sha1(str(n).encode()).digest(), b"p" * (n % 50)) for n in range(300)]
    df = spark.createDataFrame(rows, "infohash binary, payload binary")
    path = str(tmp_path / "out")
    for part in (df.limit(0), df.repartition(4), df.limit(10)):
        records.write_records(part, path)
    got = [(bytes(r.infohash), bytes(r.payload)) for r in records.read_records(spark, path).collect()]
    assert Counter(got) == Counter(rows) + Counter([(bytes(r.infohash), bytes(r.payload)) for r in df.limit(10).collect()])
    bad = spark.createDataFrame([(b"short", b"x")], df.schema)
    with pytest.raises(Exception, match="20 bytes"):
        records.write_records(bad, path)
    assert records.read_records(spark, path).count() == len(got)


def test_backfill_without_files_and_with_repeated_ids(spark, tmp_path):
    tables = [spark.createDataFrame([], s) for s in (schemas.SIGHTINGS, schemas.METADATA, schemas.JOBS)]
    at = F.lit("2024-01-01").cast("timestamp")
    made = backfill(spark, str(tmp_path), at, *tables)
    assert (made.records, made.ids, made.sightings.count(), made.jobs.count()) == (0, 0, 0, 0)
    key = b"k" * 20
    (tmp_path / "metadata.bin").write_bytes(record(MULTI, key) + record(b"junk", b"j" * 20) + record(SINGLE, key))
    (tmp_path / "discovered.txt").write_text(f"{key.hex()}\nnot an id\n{(b'd' * 20).hex()}\n")
    made = backfill(spark, str(tmp_path), at, *tables)
    assert (made.records, made.ids) == (3, 2)
    assert {bytes(r.infohash): (r.name, r.total_size) for r in made.metadata.collect()} == {key: ("hello", 42), b"j" * 20: (None, None)}
    assert {bytes(r.infohash): r.status for r in made.jobs.collect()} == {key: "verified", b"j" * 20: "verified", b"d" * 20: "pending"}
    assert {bytes(r.infohash): (r.total_seen, r.source_counts) for r in made.sightings.collect()} == {
        k: (1, {"legacy": 1}) for k in (key, b"j" * 20, b"d" * 20)}
