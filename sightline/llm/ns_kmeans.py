"""Exact k-means with norm-of-sum bounds.

Lloyd's rounds on integer vectors. Of each vector the table of a round keeps, for every centroid, the
exact squared distance when it was last evaluated and the round of that evaluation. All centroids of
all rounds are kept, so a stored distance is loosened by the norm of the centroid's total displacement
since then, which is at most the sum of its moves round by round and mostly far less. A centroid whose
loosened distance stays above the (loosened) distance to the own one cannot be nearest. For the
vectors where this fails, the own distance is evaluated first, then exactly those centroids that still
may be nearer; ties go to the smaller number.

A round reads one table and writes the next below the shared folder; the one before goes when the new
one is complete. New centroids come from the old sums and the vectors that moved, added up in
each task and then in one small aggregation; ``k`` times the width sums reach the driver.

Distances are exact: floats hold them below 2^53 exactly, wider values are taken as 64-bit integers, and
values whose distances may not fit a long are an error. Bounds are compared with a margin for
rounding.

Defined results: vectors that are null, of another width or hold null or non-finite components are
left out; fewer vectors than ``k`` make fewer centroids; equal vectors may all be centroids, the
smaller number gets them and the others keep their place; rows with repeated or null ids are vectors of
their own; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.llm.registry import query
from sightline.llm.vectors import usable
from sightline.session import work_path

#: Distances below this are exact in floats.
EXACT = 1 << 53
#: Relative margin of bounds, far above their rounding.
MARGIN = 1e-9


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls, all of one width, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists_of(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1)))


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centres, as long."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centres).max(initial=0)))
    if 4 * most * most * x.shape[1] < EXACT:
        a, b = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    if 4 * most * most * x.shape[1] >= 1 << 63:
        raise ValueError("components are too large: squared distances do not fit a long")
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


class History:
    """The centroids of all rounds so far."""

    def __init__(self, rounds: list[np.ndarray]):
        self.rounds = rounds
        # moved[t, j]: norm of the way of centroid j from round t until now
        way = np.stack(rounds).astype(np.float64) - rounds[-1].astype(np.float64)
        self.moved = np.sqrt((way * way).sum(axis=2)) * (1 + MARGIN)

    def assign(
        self, x: np.ndarray, own: np.ndarray, dist: np.ndarray, seen: np.ndarray, settle: bool = False
    ) -> int:
        """Renew ``own`` in place, with the distances and rounds of what is evaluated; their number.

        ``settle`` also evaluates all own distances that are of an earlier round.
        """
        now, centres = len(self.rounds) - 1, self.rounds[-1]
        every, k = np.arange(len(x)), len(centres)
        root = np.sqrt(dist.astype(np.float64))
        way = self.moved[seen, np.arange(k)]
        low = root * (1 - MARGIN) - way
        high = root[every, own] * (1 + MARGIN) + way[every, own]
        low[every, own] = np.inf
        open_ = np.flatnonzero(low.min(axis=1) <= high) if k > 1 else every[:0]
        # the own distance first: it settles most of them
        count = 0
        for j in range(k):
            rows = open_[own[open_] == j]
            count += self._evaluate(x, rows, j, dist, seen, now)
        high[open_] = np.sqrt(dist[open_, own[open_]].astype(np.float64)) * (1 + MARGIN)
        may = low[open_] <= high[open_, None]
        for j in range(k):
            count += self._evaluate(x, open_[may[:, j]], j, dist, seen, now)
        may[np.arange(len(open_)), own[open_]] = True
        near = np.where(may, dist[open_].astype(np.int64), np.iinfo(np.int64).max)
        own[open_] = near.argmin(axis=1)
        for j in range(k if settle else 0):
            count += self._evaluate(x, np.flatnonzero((own == j) & (seen[:, j] < now)), j, dist, seen, now)
        return count

    def _evaluate(self, x, rows, j, dist, seen, now) -> int:
        if len(rows):
            dist[rows, j] = squared(x[rows], self.rounds[-1][j : j + 1])[:, 0]
            seen[rows, j] = now
        return len(rows)


def first_centres(vectors: DataFrame, key: str, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and id, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = vectors.select(mark.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


STATE = "key {kind}, v array<{part}>, own int, before int, dist array<{dist}>, seen array<byte>"


def _round(rows: DataFrame, history: History, width: int, wide: str, first: bool, last: bool) -> DataFrame:
    """The state of all vectors after one assignment; ``before`` is the centroid until then."""
    k, now = len(history.rounds[-1]), len(history.rounds) - 1
    part = rows.schema["v"].dataType.elementType.simpleString()
    kind = rows.schema["key"].dataType.simpleString()
    numbers = np.int32 if wide == "int" else np.int64

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column(1), width).astype(np.int64)
            if first:
                dist = squared(x, history.rounds[-1])
                own, before = dist.argmin(axis=1), np.full(len(x), -1, np.int64)
                seen = np.zeros(dist.shape, np.int8)
            else:
                before = batch.column(2).to_numpy()
                own, dist = before.astype(np.int64), rows_of(batch.column(4), k).copy()
                seen = rows_of(batch.column(5), k).copy()
                history.assign(x, own, dist, seen, last)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(before, pa.int32()),
                 lists_of(dist.astype(numbers)), lists_of(seen)],
                ["key", "v", "own", "before", "dist", "seen"],
            )

    assert now < 127, "rounds are counted in one byte"
    return rows.mapInArrow(work, STATE.format(kind=kind, part=part, dist=wide))


def _moves(rows: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What the moved vectors add to the sums and counts of the clusters, as exact integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), object)
        for batch in batches:
            x = rows_of(batch.column(0), width).astype(np.int64)
            x = np.hstack([x, np.ones((len(x), 1), np.int64)])
            for column, sign in ((1, 1), (2, -1)):
                at = batch.column(column).to_numpy()
                for j in np.unique(at[at >= 0]):
                    total[j] += sign * x[at == j].sum(axis=0).astype(object)
        used = np.flatnonzero((total != 0).any(axis=1))
        for j in used:
            yield pa.RecordBatch.from_arrays(
                [pa.array([j] * (width + 1), pa.int32()), pa.array(range(width + 1), pa.int32()),
                 pa.array([str(v) for v in total[j]])],
                ["own", "at", "part"],
            )

    found = (
        rows.filter("own <> before").select("v", "own", "before").mapInArrow(work, "own int, at int, part string")
        .groupBy("own", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect()
    )
    out = np.zeros((k, width + 1), object)
    for r in found:  # k times (width + 1) rows at most
        out[r["own"], r["at"]] = int(r["part"])
    return out[:, :width], out[:, width]


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _discard(spark: SparkSession, path: str) -> None:
    """Take away a table of this run that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cluster(
    vectors: DataFrame, k: int, rounds: int, key: str = "vec_id", vector: str = "embedding",
    width: int = 64, scale: int = 256, seed: int = 2,
) -> tuple[DataFrame, np.ndarray]:
    """(key, own, distance) of every kept vector after ``rounds`` rounds, and the last centroids.

    A component x counts as the integer floor(``scale`` * x).
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    kept, older = _written(
        vectors.filter(usable(F.col(vector)) & (F.size(vector) == width))
        .select(F.col(key).alias("key"), whole.alias("v")), "vectors",
    )
    most = kept.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0] or 0
    wide = "int" if 4 * most * most * width < 1 << 31 else "long"
    state = kept.withColumn("v", F.col("v").cast("array<short>" if most < 1 << 15 else "array<long>"))
    centres = first_centres(kept, "key", k, seed)
    if not len(centres):
        empty = kept.select(F.col("key").alias(key), F.lit(0).alias("own"), F.lit(0).cast("long").alias("distance"))
        return empty, np.zeros((0, width), np.int64)
    history, sums, counts = [centres], np.zeros(centres.shape, object), np.zeros(len(centres), object)
    for n in range(rounds + 1):
        state, path = _written(_round(state, History(history), width, wide, n == 0, n == rounds), f"round-{n}")
        _discard(spark, older)
        older = path
        if n < rounds:
            more, times = _moves(state, len(centres), width)
            sums, counts = sums + more, counts + times
            new = [
                [s // c for s in row] if c else old.tolist() for row, c, old in zip(sums, counts, history[-1])
            ]
            history.append(np.array(new, np.int64))
    own = F.get("dist", F.col("own")).cast("long").alias("distance")
    return state.select(F.col("key").alias(key), "own", own), history[-1]


def digest(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centre).encode()).hexdigest()


def _sql(k: int, rounds: int, width: int) -> str:
    steps = [f"""
    v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r,
                       list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
          WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), e) - 1)::INTEGER AS j, e
           FROM v QUALIFY j < {k})"""]
    nearest = """
    a{n} AS MATERIALIZED (SELECT r, vec_id, v.e AS e, arg_min(j, d * 1000 + j) AS j, min(d) AS d FROM (
               SELECT v.*, c.j, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS d
               FROM v, c{n} c) v GROUP BY r, vec_id, v.e)"""
    moved = """
    m{n} AS (SELECT j, list(f ORDER BY pos) AS e FROM (
               SELECT j, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS f
               FROM (SELECT j, unnest(e) AS x, unnest(range(len(e))) AS pos FROM a{n}) GROUP BY j, pos) GROUP BY j),
    c{m} AS MATERIALIZED (SELECT c.j, coalesce(m.e, c.e)::BIGINT[] AS e FROM c{n} c LEFT JOIN m{n} m ON c.j = m.j)"""
    for n in range(rounds + 1):
        steps.append(nearest.format(n=n))
        if n < rounds:
            steps.append(moved.format(n=n, m=n + 1))
    return "WITH" + ",".join(steps) + f"""
    SELECT vec_id, a.j AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia,
           (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c ON a.j = c.j
    """


@query("op13_ns_kmeans", "embeddings", sql=_sql(40, 5, 64))
def op13(embeddings: DataFrame) -> DataFrame:
    rows, centres = cluster(embeddings, 40, 5)
    within = rows.groupBy("own").agg(F.sum("distance").alias("cluster_inertia"))
    digests = rows.sparkSession.createDataFrame([(j, digest(c)) for j, c in enumerate(centres)], "own int, centroid_sha256 string")
    # at most k rows
    sums = digests.join(within, "own").withColumn(
        "inertia", F.lit(rows.agg(F.sum("distance")).first()[0]).cast("long")
    )
    return rows.join(F.broadcast(sums), "own").select(
        "vec_id", F.col("own").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
