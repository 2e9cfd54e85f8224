import random

import pytest
from pyspark.sql import functions as F

from sightline.functions import ids
from sightline.operators import nodes, peers


def distance(a, b):
    return int.from_bytes(a, "big") ^ int.from_bytes(b, "big")


def node_ids(seed, n=300):
    """Random ids, and a crowd that shares its first 3 bytes."""
    rng = random.Random(seed)
    crowd = rng.randbytes(3)
    return [rng.randbytes(20) for _ in range(n)] + [crowd + rng.randbytes(17) for _ in range(n)]


@pytest.mark.parametrize("k,leaf", [(1, 8), (40, 16)])
def test_closest_against_sorting(spark, k, leaf):
    known = node_ids(3)
    rng = random.Random(5)
    targets = [rng.randbytes(20) for _ in range(20)] + known[:3] + known[-3:] + [known[-1][:4] + b"\0" * 16]
    got = {}
    found = nodes.closest(
        spark.createDataFrame([(i,) for i in known + known[:5]], "id binary"),
        spark.createDataFrame([(t,) for t in targets], "target binary"), k, leaf_size=leaf,
    )
    for r in found.collect():
        got.setdefault(bytes(r.target), {})[r["rank"]] = bytes(r.id)
    for t in targets:
        expected = sorted(known, key=lambda i: distance(i, t))[:k]
        assert [got[t][i + 1] for i in range(k)] == expected


def test_fewer_ids_than_asked_for(spark):
    known = [bytes([i]) * 20 for i in range(5)]
    found = nodes.closest(
        spark.createDataFrame([(i,) for i in known], "id binary"),
        spark.createDataFrame([(known[2],)], "target binary"), 8,
    ).orderBy("rank").collect()
    assert [bytes(r.id) for r in found] == sorted(known, key=lambda i: distance(i, known[2]))


def test_bucket_index(spark):
    own = b"\xaa" * 20
    cases = {own: 0, own[:-1] + b"\xab": 0, b"\x2a" + own[1:]: 159, own[:10] + b"\xa8" + own[11:]: 73}
    df = spark.createDataFrame([(i,) for i in cases], "id binary")
    got = {bytes(r.id): r.b for r in df.select("id", ids.bucket_index(F.lit(own), F.col("id")).alias("b")).collect()}
    assert got == cases


@pytest.mark.parametrize("size,width", [(60, 50), (17, 250), (400, 100)])
def test_retention_against_a_plain_queue(spark, size, width):
    rng = random.Random(size)
    own = rng.randbytes(20)
    pool = [rng.randbytes(20) for _ in range(size)] + [own]
    rows = [(rng.choice(pool), i, f"addr{i}") for i in range(1000)]
    table = {}
    for node, _, addr in rows:
        if node == own:
            continue
        bucket = table.setdefault(159 - (160 - distance(node, own).bit_length()), {})
        if node not in bucket and len(bucket) >= 8:
            del bucket[next(iter(bucket))]
        bucket[node] = addr
    expected = {
        (b, n): (pos, a) for b, held in table.items() for pos, (n, a) in enumerate(held.items(), 1)
    }
    df = spark.createDataFrame(rows, "id binary, seen_ts long, addr string")
    got = {
        (r.bucket, bytes(r.id)): (r.position, r.addr)
        for r in nodes.retain_buckets(
            df, F.lit(own), slices=F.floor(F.col("seen_ts") / width), whole_rows=100
        ).collect()
    }
    assert got == expected


@pytest.mark.parametrize("quiet,whole", [(0, 400), (300, 400), (300, 100), (1000, 100)])
def test_retention_starts_from_rows_that_settle_it(spark, monkeypatch, quiet, whole):
    """Slices start from unknown buckets; only a long tail of few ids is run from a guess."""
    rng = random.Random(quiet)
    own = bytes(20)
    many, few = [b"\x80" + rng.randbytes(19) for _ in range(300)], [b"\xc0" + rng.randbytes(19) for _ in range(10)]
    rows = [(rng.choice(few if i >= 1000 - quiet else many), i, f"addr{i}") for i in range(1000)]
    held = {}
    for node, _, addr in rows:
        if node not in held and len(held) >= 8:
            del held[next(iter(held))]
        held[node] = addr
    guessed = []
    plain = nodes._settled_ends
    monkeypatch.setattr(nodes, "_settled_ends", lambda *a: guessed.append(1) or plain(*a))
    df = spark.createDataFrame(rows, "id binary, seen_ts long, addr string")
    got = nodes.retain_buckets(df, F.lit(own), slices=F.floor(F.col("seen_ts") / 100), whole_rows=whole).collect()
    assert [(bytes(r.id), r.addr) for r in sorted(got, key=lambda r: r.position)] == list(held.items())
    assert bool(guessed) == (quiet > whole)


def test_nearest_pool_without_members(spark):
    members = spark.createDataFrame([], "id binary, pool string")
    targets = spark.createDataFrame([(b"\1" * 20,)], "target binary")
    assert nodes.nearest_pool(members, targets).first().pool == "random"


@pytest.mark.parametrize("ip,public", [
    ("8.8.8.8", True), ("192.168.1.1", False), ("10.0.0.1", False), ("127.0.0.1", False),
    ("0.0.0.0", False), ("100.64.0.1", False), ("100.200.1.1", False), ("172.32.0.1", True),
    ("172.16.9.1", False), ("169.254.1.1", False), ("255.255.255.255", False), ("224.0.0.1", False),
    ("0.0.0.1", True), ("240.0.0.1", True),
])
def test_public_addresses(spark, ip, public):
    row = spark.createDataFrame([(ip,)], "ip string").select(ids.is_public_ipv4(F.col("ip")).alias("p")).first()
    assert row.p is public


def test_cut_to_count_comes_before_suppression(spark):
    rows = [("h", f"p{i}", i) for i in range(5)]
    first = peers.first_peers(spark.createDataFrame(rows, "h string, p string, ts long"), "h", "p", "ts", 3)
    checks = first.select("p", F.timestamp_seconds("ts").alias("ts"))
    bad = spark.createDataFrame([("p1", 0)], "p string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    left = peers.suppress_bad(checks, bad, "p", "ts", 600)
    assert sorted(r.p for r in left.collect()) == ["p0", "p2"]


def test_suppression_ends_with_its_time(spark):
    at = lambda rows: spark.createDataFrame(rows, "p string, s long").select(
        "p", F.timestamp_seconds("s").alias("ts"))
    left = peers.suppress_bad(at([("a", 0), ("a", 699), ("a", 700), ("b", 150)]), at([("a", 100)]), "p", "ts", 600)
    assert sorted((r.p, int(r.ts.timestamp()) % 10000) for r in left.collect()) == [("a", 0), ("a", 700), ("b", 150)]
