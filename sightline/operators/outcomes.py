"""Counters derived from message, attempt and stage logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.ids import in_sample
from sightline.functions.timing import micros
from sightline.operators.scans import sliced_scan

# Counter of each (phase, error) of a fetch attempt.
ATTEMPT_COUNTERS = {
    ("connect", "timeout"): "fetch_connect_timeout",
    ("connect", "io"): "fetch_connect_io",
    ("metadata", "timeout"): "fetch_io",
    ("metadata", "handshake"): "fetch_handshake",
    ("metadata", "no_extension"): "fetch_no_extension",
    ("metadata", "reject"): "fetch_reject",
    ("metadata", "bad_piece"): "fetch_bad_piece",
    ("metadata", "io"): "fetch_io",
}

# Counters each verification outcome raises beside verify_attempts.
VERIFY_COUNTERS = {
    "verified": ["verify_success"],
    "sha1_mismatch": ["verify_fail", "sha1_mismatch"],
    "no_peers": ["verify_fail", "source_no_peers"],
    "source_timeout": ["verify_fail", "source_all_timeout"],
    "no_metadata": ["verify_fail"],
}

# Message kinds and the two id pools they may hit.
MESSAGE_KINDS = ["ping", "find_node", "get_peers", "announce_peer"]
POOL_COUNTERS = {
    ("find_node", "bep42"): "inbound_find_node_bep42",
    ("find_node", "random"): "inbound_find_node_random",
    ("get_peers", "bep42"): "inbound_get_peers_bep42",
    ("get_peers", "random"): "inbound_get_peers_random",
    ("announce_peer", "bep42"): "inbound_announce_bep42",
    ("announce_peer", "random"): "inbound_announce_random",
}


def attempt_counter(phase: Column, error: Column) -> Column:
    """Counter name of a failed attempt; other connect errors count as connect I/O."""
    out = F.when(F.lit(False), F.lit(""))
    for (p, e), name in ATTEMPT_COUNTERS.items():
        out = out.when((phase == p) & (error == e), F.lit(name))
    return out.when(phase == "connect", F.lit("fetch_connect_io"))


def count_attempts(attempts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Failure counters of an attempt log with columns phase and error (null = success)."""
    failed = F.col("error").isNotNull()
    name = attempt_counter(F.col("phase"), F.col("error"))
    counters = sorted(set(ATTEMPT_COUNTERS.values()))
    return attempts.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("fetch_attempts"),
        *[F.count_if(failed & (name == c)).alias(c) for c in counters],
        F.count_if(F.col("error") == "timeout").alias("verify_timeouts"),
    )


def count_verifications(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters of a verification log with columns outcome and error."""
    result = F.when(F.col("outcome") == "verified", F.lit("verified")).otherwise(F.col("error"))
    names = ["verify_success", "verify_fail", "sha1_mismatch", "source_no_peers", "source_all_timeout"]
    raised = {n: [r for r, cs in VERIFY_COUNTERS.items() if n in cs] for n in names}
    return outcomes.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("verify_attempts"),
        *[F.count_if(result.isin(rs)).alias(n) for n, rs in raised.items()],
    )


def count_messages(messages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters of a message log with columns kind, pool and token_ok.

    A null kind is an unreadable message; a null pool is a query without an id. Tokens are
    issued to id-carrying get_peers queries and checked on id-carrying announcements.
    """
    kind, pool = F.col("kind"), F.col("pool")
    has_id = pool.isNotNull()
    rejected = (kind == "announce_peer") & has_id & ~F.coalesce(F.col("token_ok"), F.lit(False))
    return messages.groupBy(*(by or [])).agg(
        *[F.count_if(kind == k).alias(f"inbound_{k}") for k in MESSAGE_KINDS],
        F.count_if(kind.isNull()).alias("inbound_invalid"),
        *[F.count_if((kind == k) & (pool == p)).alias(n) for (k, p), n in POOL_COUNTERS.items()],
        F.count_if(rejected).alias("inbound_announce_invalid_token"),
        F.count_if((kind == "get_peers") & has_id).alias("tokens_issued"),
    )


def discrete_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Lower median of a whole-number column per group, exactly: (group, median).

    Values are counted by millions first, then one by one within the million that holds the
    middle, so a window orders counts of at most a million values, never the rows.
    """
    rows = df.filter(F.col(value).isNotNull()).select(
        group, F.col(value).alias("_v"), F.floor(F.col(value) / 1_000_000).alias("_m")
    )
    upto = Window.partitionBy(group).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(group)
    coarse = rows.groupBy(group, "_m").agg(F.count(F.lit(1)).alias("_n")).select(
        group, "_m", "_n", F.sum("_n").over(upto.orderBy("_m")).alias("_upto"),
        F.floor((F.sum("_n").over(whole) + 1) / 2).alias("_middle"),
    )
    holder = coarse.filter(
        (F.col("_upto") >= F.col("_middle")) & (F.col("_upto") - F.col("_n") < F.col("_middle"))
    ).select(group, "_m", (F.col("_middle") - F.col("_upto") + F.col("_n")).alias("_nth"))
    fine = rows.groupBy(group, "_m", "_v").agg(F.count(F.lit(1)).alias("_n")).join(
        holder, [group, "_m"]
    ).withColumn("_upto", F.sum("_n").over(upto.orderBy("_v")))
    return fine.filter(F.col("_upto") >= F.col("_nth")).groupBy(group).agg(
        F.min("_v").alias("median")
    )


def stage_funnel(
    stages: DataFrame, key: str, stage: str, order: list[str], sample_rate: float = 1.0,
    always: Column | None = None,
) -> DataFrame:
    """Rows, ids and median gap to the previous stage of the same id, for each stage."""
    if sample_rate < 1:
        stages = stages.filter(in_sample(F.col(key), sample_rate, always))
    scanned = sliced_scan(stages, [key], order, maxes={"_prev": F.col(order[0])})
    gap = micros(F.col(order[0])) - micros(F.col("_prev"))
    medians = discrete_median(scanned.withColumn("_gap", gap), stage, "_gap")
    counts = stages.groupBy(stage, key).agg(F.count(F.lit(1)).alias("n")).groupBy(stage).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_ids")
    )
    return counts.join(medians, stage, "left").select(
        stage, "n", "n_ids", (F.col("median") / 1_000_000).alias("median_gap_s")
    )
