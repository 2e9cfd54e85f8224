"""Node tables: nearest ids by XOR distance, bucketed retention, candidate merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.ids import bucket_index, to_hex, xor_distance
from sightline.functions.timing import time_chunk
from sightline.operators.scans import DEFAULT_SLICE_SECONDS
from sightline.operators.sightings import latest_rows
from sightline.session import store

HEX_DIGITS = 40
# Down to this depth there are at most 16 ** 4 prefixes, few enough to send to every task.
BROADCAST_DEPTH = 4


def _digit(hex_id: Column, position: int) -> Column:
    return F.conv(F.substring(hex_id, position + 1, 1), 16, 10).cast("int")


def closest(
    nodes: DataFrame, targets: DataFrame, k: int = 8, *, node: str = "id", target: str = "target",
    leaf_size: int = 64,
) -> DataFrame:
    """The k ids nearest to each target by XOR distance, with rank 1..k.

    Ids sharing a longer prefix with the target are always nearer, so the search walks down
    the hex digits: at each step the children of the current prefix are taken whole, nearest
    first, until the k-th id must lie inside one child, which the next step opens. A prefix
    with no more than ``leaf_size`` ids is read as it is. Targets meet prefix counts and short
    id lists only, never the node table, and a crowded prefix is opened further rather than
    listed.
    """
    ids = nodes.select(F.col(node).alias("_id")).distinct().withColumn("_hex", to_hex(F.col("_id")))
    wanted = targets.select(F.col(target).alias("_t")).distinct().withColumn(
        "_thex", to_hex(F.col("_t"))
    )
    total = ids.count()
    leaf_size = max(leaf_size, k)
    # prefixes to read whole: (target, prefix)
    reads: list[tuple[int, DataFrame]] = []
    frontier = wanted.select("_t", "_thex", F.lit("").alias("_p"), F.lit(k).alias("_need"))
    if total <= leaf_size:
        reads.append((0, frontier.select("_t", "_p")))
        frontier = None

    depth = 0
    while frontier is not None and depth < HEX_DIGITS:
        children = (
            ids.groupBy(F.substring("_hex", 1, depth + 1).alias("_c"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_p", F.substring("_c", 1, depth) if depth else F.lit(""))
        )
        if depth < BROADCAST_DEPTH:
            # all targets share few prefixes here; they stay where they are
            children = F.broadcast(children)
        nearest_first = (
            Window.partitionBy("_t", "_p").orderBy("_near")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        step = (
            frontier.join(children, "_p")
            .withColumn("_near", _digit(F.col("_c"), depth).bitwiseXOR(_digit(F.col("_thex"), depth)))
            .withColumn("_before", F.coalesce(F.sum("_n").over(nearest_first), F.lit(0)))
            .filter(F.col("_before") < F.col("_need"))
            .withColumn("_left", F.col("_need") - F.col("_before"))
        )
        step = store(step.select("_t", "_thex", "_c", "_n", "_left"), "closest")
        opened = (F.col("_n") > F.col("_left")) & (F.col("_n") > leaf_size)
        reads.append((depth + 1, step.filter(~opened).select("_t", F.col("_c").alias("_p"))))
        frontier = step.filter(opened).select(
            "_t", "_thex", F.col("_c").alias("_p"), F.col("_left").cast("int").alias("_need")
        )
        depth += 1
        if frontier.isEmpty():
            frontier = None

    found = None
    for length, read in reads:
        prefixed = ids.withColumn("_p", F.substring("_hex", 1, length) if length else F.lit(""))
        if total <= leaf_size:
            prefixed = F.broadcast(prefixed)
        part = read.join(prefixed, "_p").select("_t", "_id")
        found = part if found is None else found.unionByName(part)
    ranked = found.withColumn("distance", xor_distance(F.col("_t"), F.col("_id"))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("_t").orderBy("distance"))
    )
    return ranked.filter(F.col("rank") <= k).select(
        F.col("_t").alias(target), F.col("_id").alias(node), "rank"
    )


def nearest_pool(
    members: DataFrame, targets: DataFrame, *, node: str = "id", pool: str = "pool",
    target: str = "target", default: str = "random",
) -> DataFrame:
    """Pool of the member id nearest to each target; ``default`` when there are no members."""
    best = closest(members, targets, 1, node=node, target=target)
    named = best.join(members.groupBy(node).agg(F.min(pool).alias(pool)), node)
    return (
        targets.select(target).distinct()
        .join(named.select(target, pool), target, "left")
        .withColumn(pool, F.coalesce(F.col(pool), F.lit(default)))
    )


def merge_candidates(old: DataFrame, new: DataFrame, targets: DataFrame, k: int = 8, **names: str) -> DataFrame:
    """Append, drop equal ids, keep the k nearest per target."""
    return closest(old.unionByName(new), targets, k, **names)


def without_own(nodes: DataFrame, own: DataFrame, node: str = "id") -> DataFrame:
    """Nodes whose id is not one of our own."""
    return nodes.join(own.select(node).distinct(), node, "left_anti")


def latest_arrivals(nodes: DataFrame, own: Column, k: int = 8, *, node: str = "id", seen: str = "seen_ts") -> DataFrame:
    """Last k ids per bucket by first appearance, each with its latest address.

    Equal to ``retain_buckets`` as long as no id returns after it was pushed out; built from
    map-side aggregates and a top-k that is cut before the shuffle.
    """
    rest = [c for c in nodes.columns if c not in (node, seen)]
    per_id = nodes.filter(F.col(node) != own).groupBy(node).agg(
        F.min(seen).alias("first_ts"),
        *[F.max_by(c, seen).alias(c) for c in rest],
    )
    ranked = per_id.withColumn("bucket", bucket_index(own, F.col(node))).withColumn(
        "rank",
        F.row_number().over(
            Window.partitionBy("bucket").orderBy(F.desc("first_ts"), F.desc(node))
        ),
    )
    return ranked.filter(F.col("rank") <= k)


def _first_comers(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """(bucket, _slice, _start): the last k ids first seen before each slice, oldest first.

    Ids are numbered by first appearance through counts per slice, so that the k numbers below
    a slice's count find them; no bucket is sorted as a whole.
    """
    firsts = rows.groupBy("bucket", "_id").agg(
        F.min(F.struct("_slice", *order)).alias("_f")
    ).select("bucket", "_id", "_f.*")
    local = firsts.withColumn(
        "_nth", F.row_number().over(Window.partitionBy("bucket", "_slice").orderBy(*order))
    )
    counts = rows.groupBy("bucket", "_slice").agg(F.lit(0).alias("_none")).join(
        firsts.groupBy("bucket", "_slice").agg(F.count(F.lit(1)).alias("_new")),
        ["bucket", "_slice"], "left",
    )
    before = counts.select(
        "bucket", "_slice",
        F.coalesce(
            F.sum("_new").over(
                Window.partitionBy("bucket").orderBy("_slice")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_seen"),
    )
    numbered = local.join(before, ["bucket", "_slice"]).select(
        "bucket", (F.col("_seen") + F.col("_nth")).alias("_no"), "_id"
    )
    wanted = before.select(
        "bucket", "_slice",
        F.explode_outer(F.when(
            F.col("_seen") > 0,
            F.sequence(F.greatest(F.col("_seen") - (k - 1), F.lit(1)), F.col("_seen")),
        )).alias("_no"),
    )
    # at most k ids are collected per slice
    return wanted.join(numbered, ["bucket", "_no"], "left").groupBy("bucket", "_slice").agg(
        F.array_sort(F.collect_list(F.when(F.col("_id").isNotNull(), F.struct("_no", "_id")))).alias("_s")
    ).select("bucket", "_slice", F.transform("_s", lambda x: x["_id"]).alias("_start"))


def _settled_ends(
    rows: DataFrame, order: list[str], k: int, first: DataFrame, ends_of: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """(bucket, _slice, _end) where every slice started with what the one before ended with; the
    first slice of a bucket starts with its ``_first``."""
    on = ["bucket", "_slice"]
    along = Window.partitionBy("bucket").orderBy("_slice")
    starts = store(_first_comers(rows, order, k), "buckets")
    state = store(ends_of(rows.join(starts, on)).join(starts, on), "buckets")
    while True:
        due = state.join(F.broadcast(first), "bucket").withColumn(
            "_due", F.coalesce(F.lag("_end").over(along), F.col("_first"))
        )
        wrong = store(
            due.filter(F.col("_due") != F.col("_start"))
            .select(*on, F.col("_due").alias("_start")),
            "buckets",
        )
        if wrong.isEmpty():
            return state.select(*on, "_end")
        again = ends_of(rows.join(wrong, on)).join(wrong, on)
        state = store(
            state.join(wrong.select(*on), on, "left_anti").unionByName(again), "buckets"
        )


def _tails(
    rows: DataFrame, state: DataFrame, large: list[int], order: list[str], k: int, whole_rows: int,
    ends_of: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """(bucket, _slice, _end) of what follows the last slice of a large bucket whose end is known."""
    nothing = F.array().cast("array<binary>")
    ended = F.when(F.col("_end").isNotNull(), F.col("_slice"))
    # at most one row per bucket, here and in the counts
    known = store(
        state.filter(F.col("bucket").isin(large)).groupBy("bucket").agg(
            F.max(ended).alias("_known"), F.max("_slice").alias("_last"),
            F.coalesce(F.max_by("_end", ended), nothing).alias("_first"),
        ).filter(F.col("_known").isNull() | (F.col("_known") < F.col("_last"))), "known",
    )
    tail = rows.join(F.broadcast(known), "bucket").filter(
        F.col("_known").isNull() | (F.col("_slice") > F.col("_known"))
    )
    counts = tail.groupBy("bucket").count().collect()
    long = [r["bucket"] for r in counts if r["count"] > whole_rows]
    # the last slice number stands for the whole tail
    short = tail.filter(~F.col("bucket").isin(long)).withColumn("_slice", F.col("_last")).withColumn("_start", F.col("_first"))
    ends = ends_of(short)
    if long:
        late = tail.filter(F.col("bucket").isin(long)).select("bucket", "_slice", "_id", *order)
        ends = ends.unionByName(_settled_ends(late, order, k, known.select("bucket", "_first"), ends_of))
    return ends


def retain_buckets(
    nodes: DataFrame, own: Column, k: int = 8, *, node: str = "id", seen: str = "seen_ts",
    tie: str | None = None, slices: Column | None = None, whole_rows: int = 1_000_000,
) -> DataFrame:
    """Routing table after seeing ``nodes`` in time order, exactly: (bucket, id, position, ...).

    Each bucket keeps k ids; a new id pushes out the one inserted longest ago, a known id only
    changes its address. A bucket of more than ``whole_rows`` rows is cut into time slices
    (``slices`` gives another non-decreasing number, say for a sequence instead of a time).

    All slices are run at once, each from an unknown start. After 3k - 1 rows in a row with
    different ids the bucket holds the last k of them, whatever it held before: an id that is
    seen again after 2k - 1 others has been pushed out, as at most k - 1 of these were in the
    bucket with it and the other k were inserted later. From there on a slice is run exactly.
    What follows the last slice of a bucket that came to such a point is run again from that
    slice's end, as one stream; if that is more than ``whole_rows`` rows, slice by slice from a
    guess (the last k ids that had first appeared by then) until every slice started with what
    the one before ended with. No task holds more than a stream of rows and k ids.
    """
    order = [seen] + ([tie] if tie else [])
    rest = [c for c in nodes.columns if c not in (node, *order)]
    slice_no = slices if slices is not None else time_chunk(F.col(seen), DEFAULT_SLICE_SECONDS)
    # buckets are worked out once; rows without a time come first
    placed = store(nodes.filter(F.col(node) != own).select(
        bucket_index(own, F.col(node)).alias("bucket"),
        F.coalesce(slice_no.cast("bigint"), F.lit(-(2**63))).alias("_slice"), F.col(node).alias("_id"), *order,
    ), "placed")
    # one count per bucket reaches the driver: at most 160
    sizes = placed.groupBy("bucket").count().collect()
    large = [r["bucket"] for r in sizes if r["count"] > whole_rows]
    rows = placed.withColumn(
        "_slice", F.when(F.col("bucket").isin(large), F.col("_slice")).otherwise(0)
    )
    on = ["bucket", "_slice"]
    schema = "bucket int, _slice bigint, _end array<binary>"
    kind = pa.schema([("bucket", pa.int32()), ("_slice", pa.int64()), ("_end", pa.list_(pa.binary()))])
    sure = 3 * k - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The end of each slice; null while the start is unknown and no row has settled it."""
        group, held, recent, ends = None, {}, {}, []

        def end():
            ends.append({"bucket": group[0], "_slice": group[1], "_end": None if held is None else list(held)})

        for batch in batches:
            places = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (0, 1)])
            cuts = np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0)) + 1
            for at, to in zip([0, *cuts], [*cuts, batch.num_rows]):
                if tuple(places[:, at].tolist()) != group:
                    if group:
                        end()
                    group, recent = tuple(places[:, at].tolist()), {}
                    start = batch.column(3)[int(at)].as_py()
                    held = None if start is None else dict.fromkeys(map(bytes.fromhex, start.split()))
                for i in batch.column(2).slice(at, to - at).to_pylist():
                    if held is None:
                        if i in recent:
                            # only what followed its last row is free of repeats
                            later = list(recent)
                            recent = dict.fromkeys(later[later.index(i) + 1 :])
                        recent[i] = None
                        if len(recent) == sure:
                            held = dict.fromkeys(list(recent)[-k:])
                    elif i not in held:
                        if len(held) >= k:
                            del held[next(iter(held))]
                        held[i] = None
            yield pa.RecordBatch.from_pylist(ends, kind)
            ends.clear()
        if group:
            end()
            yield pa.RecordBatch.from_pylist(ends, kind)

    nothing = F.array().cast("array<binary>")

    def ends_of(started: DataFrame) -> DataFrame:
        # a text goes to Python far faster than a list
        start = F.array_join(F.transform("_start", F.hex), " ").alias("_start")
        return (
            started.select(*on, "_id", start, *order).repartition(*on)
            .sortWithinPartitions(*on, *order).mapInArrow(run, schema)
        )

    unknown = F.when(~F.col("bucket").isin(large), nothing)
    state = store(ends_of(rows.withColumn("_start", unknown)), "buckets")
    if large:
        state = state.unionByName(_tails(rows.filter(F.col("bucket").isin(large)), state, large, order, k, whole_rows, ends_of))
    final = state.filter(F.col("_end").isNotNull()).groupBy("bucket").agg(
        F.max_by("_end", "_slice").alias("_end")
    ).select("bucket", F.posexplode("_end").alias("_at", node))
    # at most k rows per bucket
    kept = store(final.select("bucket", node, (F.col("_at") + 1).alias("position")), "buckets")
    if not rest:
        return kept
    # the address of a kept id is the one it was last seen with
    latest = latest_rows(
        nodes.join(kept.select(node), node, "left_semi").select(node, *order, *rest), [node], order
    )
    return kept.join(latest.select(node, *rest), node).select("bucket", node, "position", *rest)
