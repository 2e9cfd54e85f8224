"""Embedding near-dedup with a forest of random-projection trees.

Equal vectors are folded into one first. Each tree splits recursively along a random direction;
vectors near the cut go to both sides (spill). How near is a distance: the projected gap of two
vectors at the threshold, so linked vectors stay together at every depth and table size. The cut is
placed where the two sides have the fewest pairs, and a node no cut of which saves pairs (its spread
is of the size of the gap: a near-copy group) stays a leaf, however many vectors it holds.
Directions and cuts are fitted on a sample of at most ``sample`` vectors; every vector is then sent
down every tree. Vectors that share a leaf are compared in double precision; a pair is counted only
in the first leaf the two share, so no pair is ever written: a leaf reports per vector the number of
its links and one root. Roots are joined to components. A leaf of more than ``tile`` vectors is
compared tile by tile, so one task holds two tiles at most, whatever a leaf's share of the rows;
its vectors that share one earlier leaf anyway (a group that stays whole in several trees) meet the
others only.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are their own component; a shorter vector counts as padded with zeros; a row without id
takes no part (0 links, null component, not kept); repeated rows are vectors of their own that link
with each other; an empty table gives an empty table. Recall against brute force is measured in
the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sightline.llm.components import components
from sightline.llm.registry import query
from sightline.llm.vectors import matrix, usable
from sightline.session import store


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safely for very large and very small components."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


#: Pairs left by a split, as a share of the node's: up to WORTH it is made, at GOOD no other is drawn.
WORTH, GOOD, DRAWS = 0.9, 0.7, 8


def cheapest_cut(along: np.ndarray, gap: float) -> tuple[float, float]:
    """(share of pairs left, cut) of the cut between the outer fifths that leaves the fewest pairs."""
    along = np.sort(along)
    cuts = np.quantile(along, np.linspace(0.2, 0.8, 25))
    left = np.searchsorted(along, cuts + gap / 2, "right") / len(along)
    right = 1 - np.searchsorted(along, cuts - gap / 2, "left") / len(along)
    pairs = left**2 + right**2
    at = int(pairs.argmin())
    return float(pairs[at]), float(cuts[at])


class Tree:
    """Complete tree of ``depth`` levels: per inner node a direction and the cuts for each side.

    A node that is not split hands everything to the left.
    """

    def __init__(self, sample: np.ndarray, depth: int, gap: float, least: int, seed: int):
        draw = np.random.default_rng(seed)
        self.depth, width = depth, sample.shape[1]
        self.directions = np.zeros((1 << depth, width), np.float32)
        self.low, self.high = np.full(1 << depth, np.inf), np.full(1 << depth, np.inf)
        inside = {1: np.arange(len(sample))}
        for node in range(1, 1 << depth):
            rows = inside.pop(node, np.zeros(0, int))
            if len(rows) <= least:
                continue
            best = WORTH
            for _ in range(DRAWS):
                direction = draw.standard_normal(width).astype(np.float32)
                direction *= np.sqrt(width) / np.linalg.norm(direction)
                along = sample[rows] @ direction
                pairs, at = cheapest_cut(along, gap)
                if pairs < best:
                    best, self.directions[node], kept = pairs, direction, along
                    self.low[node], self.high[node] = at - gap / 2, at + gap / 2
                if best <= GOOD:
                    break
            if best < WORTH:
                inside[2 * node] = rows[kept <= self.high[node]]
                inside[2 * node + 1] = rows[kept >= self.low[node]]

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs; a row is in every leaf it spills into."""
        rows, nodes = np.arange(len(vectors)), np.ones(len(vectors), np.int64)
        for _ in range(self.depth):
            along = np.einsum("ij,ij->i", vectors[rows], self.directions[nodes])
            left, right = along <= self.high[nodes], along >= self.low[nodes]
            rows = np.concatenate([rows[left], rows[right]])
            nodes = np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
        return rows, nodes - (1 << self.depth)


def linked(
    left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], code: int, least: float, itself: bool
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, first) of pairs at or over ``least``; ``first`` if ``code`` is the first leaf shared."""
    (a, a_leaves), (b, b_leaves) = left, right
    for at in range(0, len(a), 128):
        i, j = np.nonzero(a[at : at + 128] @ b.T >= least)
        i = i + at
        if itself:
            i, j = i[i < j], j[i < j]
        for cut in range(0, len(i), 1 << 16):
            p, q = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
            earlier = np.zeros(len(p), bool)
            for column in range(a_leaves.shape[1]):
                own = a_leaves[p, column]
                live = (own >= 0) & (own < code) & ~earlier
                if live.any():
                    earlier[live] = (b_leaves[q[live]] == own[live, None]).any(axis=1)
            yield p, q, ~earlier


def labels(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place reachable in the graph of the pairs."""
    label = np.arange(count)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def tiles_of(count: str, tile: int) -> Column:
    return F.when(F.col(count) > 0, F.floor(F.col(count) / tile) + 1).otherwise(F.lit(0)).cast("long")


def near_duplicates(
    vectors: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding",
    trees: int = 6, spill: float = 1.0, leaf: int = 512, sample: int = 8192, tile: int = 1024,
    seed: int = 7,
) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``vectors``.

    ``spill``: what goes to both sides of a cut, in projected gaps of a pair at the threshold.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = rows.filter(F.col("id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0))
    classes = store(
        good.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("weight")), "vectors"
    )
    total = classes.count()
    picked = classes.orderBy(F.xxhash64("node")).limit(sample).select("v").toPandas()
    fitted = unit(matrix(picked["v"])) if len(picked) else np.zeros((0, 1))
    depth = max(0, min(int(np.ceil(np.log2(max(1, total) / leaf))), int(np.log2(max(1, sample) / 16))))
    # two unit vectors at the threshold are this far apart, and so are on average their projections
    gap = spill * float(np.sqrt(max(0.0, 2 - 2 * least)))
    fewest = max(32, int(leaf * len(fitted) / max(1, total)))
    forest = spark.sparkContext.broadcast(
        [Tree(fitted, depth, gap, fewest, seed + n) for n in range(trees)]
    )

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                v = unit(matrix(batch.column("v")))
                width = forest.value[0].directions.shape[1]
                along = np.zeros((len(v), width))
                along[:, : min(width, v.shape[1])] = v[:, :width]
                found = [tree.leaves(along) for tree in forest.value]
                row = np.concatenate([f[0] for f in found])
                code = np.concatenate([f[1] + (n << depth) for n, f in enumerate(found)])
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                ends = np.searchsorted(row, np.arange(len(v) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").take(pa.array(row)), batch.column("weight").take(pa.array(row)),
                        pa.array([x.tobytes() for x in v], pa.binary()).take(pa.array(row)),
                        pa.array(code, pa.int32()), lists.take(pa.array(row)),
                    ],
                    ["node", "weight", "unit", "code", "leaves"],
                )

    placed = store(
        classes.mapInArrow(descend, "node long, weight long, unit binary, code int, leaves array<int>"),
        "leaves",
    )
    # of a leaf of several tiles: the earlier leaf that most of its vectors share. Those were compared
    # there with each other, so their tiles meet the tiles of the other vectors only
    sizes = placed.groupBy("code").count()
    large = sizes.filter(F.col("count") > tile).select("code")
    usual = placed.join(large, "code").select(
        "code", F.explode(F.filter("leaves", lambda x: x < F.col("code"))).alias("earlier")
    ).groupBy("code", "earlier").count().groupBy("code").agg(
        F.max(F.struct("count", "earlier"))["earlier"].alias("earlier")
    )
    seen = F.coalesce(F.array_contains("leaves", F.col("earlier")), F.lit(False))
    placed = placed.join(F.broadcast(usual), "code", "left").withColumn("seen", seen).drop("earlier")
    # tiles of a leaf: a vector of part p meets parts 0..p as (other, p) and p.. as (p, other)
    parts = placed.groupBy("code").agg(
        F.count_if("seen").alias("n_seen"), F.count_if(~F.col("seen")).alias("n_new")
    ).select(
        "code", tiles_of("n_seen", tile).alias("seen_parts"), tiles_of("n_new", tile).alias("new_parts")
    )
    hashed = F.xxhash64("node")
    tiles = placed.join(parts, "code").withColumn(
        "part", F.when(F.col("seen"), F.pmod(hashed, F.col("seen_parts")))
        .otherwise(F.col("seen_parts") + F.pmod(hashed, F.col("new_parts")))
    ).withColumn("from", F.when(F.col("seen"), F.col("seen_parts")).otherwise(F.lit(0))).withColumn(
        "upto", F.col("seen_parts") + F.col("new_parts") - 1
    ).filter(F.col("from") <= F.col("upto")).select(
        "*", F.explode(F.sequence("from", "upto")).alias("other")
    ).select(
        "code", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"),
        (F.col("part") <= F.col("other")).alias("is_left"), "node", "weight", "unit", "leaves",
    )

    def compare(pairs: pd.DataFrame) -> pd.DataFrame:
        itself = bool(pairs["first"].iloc[0] == pairs["second"].iloc[0])
        code = int(pairs["code"].iloc[0])
        v = [np.frombuffer(x) for x in pairs["unit"]]
        v = matrix(v)
        leaves = np.full((len(v), max(map(len, pairs["leaves"]))), -1, np.int64)
        for at, own in enumerate(pairs["leaves"]):
            leaves[at, : len(own)] = own
        is_left = pairs["is_left"].to_numpy(bool)
        left = np.arange(len(v)) if itself else np.flatnonzero(is_left)
        right = left if itself else np.flatnonzero(~is_left)
        weight, node = pairs["weight"].to_numpy(), pairs["node"].to_numpy()
        links, root = np.zeros(len(v), np.int64), np.arange(len(v))
        for i, j, first in linked((v[left], leaves[left]), (v[right], leaves[right]), code, least, itself):
            i, j = left[i], right[j]
            np.add.at(links, i[first], weight[j[first]])
            np.add.at(links, j[first], weight[i[first]])
            apart = root[i] != root[j]
            if apart.any():
                i, j = i[apart], j[apart]
                root = labels(len(v), np.concatenate([i, np.arange(len(v))]), np.concatenate([j, root]))
        hit = (links > 0) | (root != np.arange(len(v)))
        return pd.DataFrame({"node": node[hit], "links": links[hit], "root": node[root[hit]]})

    found = store(
        tiles.groupBy("code", "first", "second").applyInPandas(compare, "node long, links long, root long"),
        "links",
    )
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed(
        "node", "n"
    )
    sums = found.groupBy(F.col("node").alias("m")).agg(F.sum("links").alias("links"))
    by_class = store(
        classes.join(sums, F.col("node") == F.col("m"), "left").join(roots, F.col("node") == F.col("n"), "left")
        .select(
            F.col("v").alias("class_v"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("component_id"),
        ),
        "classes",
    )
    joined = rows.join(by_class, (F.col("v") == F.col("class_v")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )


@query("op9_forest", "embeddings")
def op9(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings).withColumnRenamed("id", "vec_id")
