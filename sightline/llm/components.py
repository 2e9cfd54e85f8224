"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.session import store


def components(edges: DataFrame, limit: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b longs) that is not its component's smallest.

    Each step is one aggregation and one join; no neighbour list is ever gathered. Edges are
    written after each round.
    """
    now = store(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(), "edges",
    )
    seen = None
    for _ in range(limit):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a"), F.least("a", "m").alias("m")
        )
        large = both.filter("b > a").join(least, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b")
        ).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = store(small.union(low).distinct(), "edges")
    raise RuntimeError(f"components did not settle within {limit} rounds")
