"""Peer addresses: expansion of packed lists, deduplication, suppression, replies."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.ids import ipv4_text, is_public_ipv4, port_number
from sightline.functions.timing import micros, seconds_between
from sightline.operators.requests import walk_batches
from sightline.operators.scans import DEFAULT_SLICE_SECONDS, sliced_scan

PEER_BYTES = 6
NODE_BYTES = 26


def _records(packed: Column, size: int) -> Column:
    """Start (from 1) of each whole record of a packed list; trailing bytes are ignored."""
    count = F.floor(F.octet_length(packed) / size).cast("int")
    return F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (i * size + 1).cast("int"),
    )


def expand_peers(df: DataFrame, packed: str) -> DataFrame:
    """One row per 6-byte peer of a packed list."""
    at = F.col("_at")
    rest = [c for c in df.columns if c != packed]
    return (
        df.select("*", F.explode(_records(F.col(packed), PEER_BYTES)).alias("_at"))
        .select(*rest, ipv4_text(F.col(packed), at).alias("ip"),
                port_number(F.col(packed), at + 4).alias("port"))
    )


def expand_nodes(df: DataFrame, packed: str) -> DataFrame:
    """One row per 26-byte node of a packed list."""
    at = F.col("_at")
    rest = [c for c in df.columns if c != packed]
    return (
        df.select("*", F.explode(_records(F.col(packed), NODE_BYTES)).alias("_at"))
        .select(*rest, F.substring(F.col(packed), at, F.lit(20)).alias("id"),
                ipv4_text(F.col(packed), at + 20).alias("ip"),
                port_number(F.col(packed), at + 24).alias("port"))
    )


def public_only(peers: DataFrame, ip: str = "ip") -> DataFrame:
    return peers.filter(is_public_ipv4(F.col(ip)))


def first_peers(peers: DataFrame, key: str, peer: str, ts: str, count: int) -> DataFrame:
    """The first ``count`` distinct peers of each id in order of arrival.

    Repeats collapse on the map side; the rank filter lets Spark cut each group to ``count``
    before the shuffle.
    """
    firsts = peers.groupBy(key, peer).agg(F.min(ts).alias(ts))
    along = Window.partitionBy(key).orderBy(ts, peer)
    return firsts.withColumn("arrival", F.row_number().over(along)).filter(
        F.col("arrival") <= count
    )


def last_peers(answers: DataFrame, key: str, peer: str, ts: str, count: int, since: Column | None = None) -> DataFrame:
    """(key, peer, ts): of each id the ``count`` peers that answered last, none from before ``since``.

    A fold: what it gives for several stretches of the log gives the same for all of it when folded once
    more, so it serves as the fold of a stored table. Repeats collapse on the map side, and the rank
    filter cuts each group to ``count`` before it is shuffled.
    """
    rows = answers if since is None else answers.filter(F.col(ts) >= since)
    latest = rows.groupBy(key, peer).agg(F.max(ts).alias(ts))
    order = Window.partitionBy(key).orderBy(F.col(ts).desc(), peer)
    return latest.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= count).drop("_rank")


def suppress_bad(
    checks: DataFrame, bad: DataFrame, addr: str, ts: str, ttl_seconds: int = 600, *,
    tie: str | None = None, slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Drop checks of an address marked bad less than ``ttl_seconds`` earlier.

    Only the latest mark before a check matters, so both logs are merged and the latest mark is
    carried along; no (check, mark) pairs are formed.
    """
    marks = bad.select(addr, ts, F.lit(0).alias("_kind"))
    log = checks.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    order = [ts, "_kind"] + ([tie] if tie else [])
    scanned = sliced_scan(
        log, [addr], order, slice_seconds=slice_seconds,
        maxes={"_marked": F.when(F.col("_kind") == 0, F.col(ts))},
    )
    suppressed = seconds_between(F.col("_marked"), F.col(ts)) < ttl_seconds
    return scanned.filter(
        (F.col("_kind") == 1) & ~F.coalesce(suppressed, F.lit(False))
    ).select(*checks.columns)


def match_replies(
    requests: DataFrame, replies: DataFrame, key: str, ts: str, timeout_seconds: float, *,
    tie: str, slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Outcome of each request, by the rule of :mod:`sightline.operators.requests`: ``answered`` with
    the reply time, ``timeout``, or ``refused`` while another request of its id is open.

    Nothing is open after a reply, nor after a pause longer than the timeout. At such places the log
    of an id falls apart into stretches, which are walked independently of each other: an id with a
    large share of the rows spreads over all tasks, and a task holds one open request.
    """
    timeout_us = int(timeout_seconds * 1_000_000)
    log = requests.select(key, ts, tie, F.lit(True).alias("_asks")).unionByName(
        replies.select(key, ts, tie, F.lit(False).alias("_asks"))
    )
    order = [ts, tie]
    seen = sliced_scan(
        log, [key], order, slice_seconds=slice_seconds,
        lasts={"_prev": F.struct(F.col(ts).alias("ts"), F.col("_asks").alias("asks"))},
    )
    fresh = F.col("_prev").isNull() | ~F.col("_prev.asks") | (
        micros(F.col(ts)) - micros(F.col("_prev.ts")) > timeout_us
    )
    stretches = sliced_scan(
        seen.withColumn("_fresh", F.coalesce(fresh, F.lit(True)).cast("int")).drop("_prev"), [key], order,
        slice_seconds=slice_seconds, sums={"_stretch": F.col("_fresh")},
    ).select(key, "_stretch", micros(F.col(ts)).alias("_us"), tie, "_asks")
    kinds = [requests.schema[c].dataType.simpleString() for c in (key, tie)]
    found = stretches.repartition(key, "_stretch").sortWithinPartitions(key, "_stretch", "_us", tie).mapInArrow(
        partial(walk_batches, timeout_us=timeout_us),
        f"key {kinds[0]}, sent bigint, tie {kinds[1]}, outcome string, reply bigint",
    )
    time = requests.schema[ts].dataType
    at = lambda c: F.timestamp_micros(c).cast(time)
    return found.select(
        F.col("key").alias(key), at("sent").alias(ts), F.col("tie").alias(tie), "outcome", at("reply").alias("reply_ts")
    )
