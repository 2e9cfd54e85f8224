"""Nearest vectors by cosine, from an inverted file on disk.

Centroids are fitted on a bounded sample (k-means on vectors of length one). Every vector is stored under
its nearest centroid: the table is partitioned by that list, so a search reads only the lists it
probes. A query probes the ``probes`` lists with the nearest centroids and compares itself with
all their vectors in double precision.

Lists are cut into parts of about ``PART_ROWS`` rows; queries go to the parts of their lists and are
streamed past each, so a list of any size is searched by many tasks, each holding one part. What is kept
on the driver are the centroids (``lists`` times the width) and the numbers of the lists to read.

With ``exact`` no list is left out: all stored vectors, packed into blocks in the order of their lists, are streamed
past every query. A task holds up to ``TASK_ROWS`` queries and the best ``k`` so far of each, so a stored vector
is neither copied per query nor shuffled per task. Products are formed in single precision; all that could be among
the best within its error bound are formed again in double precision. A block that lies too far away by the triangle
inequality is not multiplied.

Scores are rounded to nine digits, ties go to the smaller id. Vectors that are null, of another width,
zero or not finite are not stored and find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.session import store, work_path

PART_ROWS = 4096
#: Rows that the centroids are fitted on, at most, and the most lists there may be.
SAMPLE_ROWS, MOST_LISTS = 50_000, 4096
DIGITS = 9
#: Vectors that a task compares with all centroids at once, and probes that it hands on at once.
ASKED_ROWS, PROBE_ROWS = 256, 8192
#: Rows of a block, queries that a task holds at most and at least (while cores are idle), and queries multiplied with a block at once.
BLOCK_ROWS, TASK_ROWS, LEAST_ROWS, TILE_ROWS = 1024, 16_384, 512, 256
#: Blocks in a file and a packing task, and bytes of them on their way to Python at once.
FILE_BLOCKS, BATCH_BYTES = 64, 4 << 20
#: How far apart two scores may be that are rounded to the same one.
TIE = 10.0 ** -DIGITS


def _usable(vector: Column, width: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == width) & ~bad & F.exists(vector, lambda x: x != 0)


def _unit(column: pa.Array, width: int) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows, no more than ``rows`` at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _probes(part: pa.RecordBatch, at: np.ndarray, lists: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(query_id, v, list) of row ``at`` for each list, in batches of bounded size."""
    for first in range(0, len(at), PROBE_ROWS):
        taken = pa.array(at[first : first + PROBE_ROWS])
        yield pa.RecordBatch.from_arrays(
            [part.column(0).take(taken), part.column(1).take(taken), pa.array(lists[first : first + PROBE_ROWS].astype(np.int32))],
            ["query_id", "v", "list"],
        )


def _rows(vectors: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    as_double = F.col(vector).cast("array<double>")
    return vectors.select(F.col(key).alias("id"), as_double.alias("v")).filter(
        F.col("id").isNotNull() & _usable(F.col("v"), width)
    )


class InvertedFile:
    """Vectors below ``path``, listed by nearest centroid."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        self.centroids, self.kind = np.array([r.c for r in rows], np.float64), rows[0].kind

    @classmethod
    def build(
        cls, vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", width: int = 64,
        lists: int | None = None, seed: int = 1,
    ) -> InvertedFile:
        """Fit the centroids (``lists`` of them, by default the root of the number of rows) and store all rows."""
        spark, rows = vectors.sparkSession, _rows(vectors, key, vector, width)
        total = rows.count()
        lists = min(lists or max(1, round(total ** 0.5)), MOST_LISTS, max(1, total))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE_ROWS).select(
            array_to_vector(F.transform("v", lambda x: x / norm)).alias("features")
        )
        if total:
            model = KMeans(k=lists, seed=seed, maxIter=10, initSteps=2).fit(store(sample, "sample"))
            centres = [c.tolist() for c in model.clusterCenters()]
        else:
            centres = [[1.0] + [0.0] * (width - 1)]
        kind = rows.schema["id"].dataType.simpleString()
        spark.createDataFrame([(n, c, kind) for n, c in enumerate(centres)], "list int, c array<double>, kind string").coalesce(
            1).write.mode("overwrite").parquet(f"{path}/centroids")
        index = cls(spark, path)
        index.add(vectors, 0, key, vector)
        return index

    def add(self, vectors: DataFrame, batch: int, key: str = "vec_id", vector: str = "embedding") -> None:
        """Store one more batch of rows; a batch that is written again replaces itself."""
        centroids, width = self.centroids, self.centroids.shape[1]
        rows = _rows(vectors, key, vector, width)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _cut(batches, ASKED_ROWS):
                unit = _unit(part.column(1), width)
                # nearest by distance: |c|^2 - 2 u.c
                far = (centroids ** 2).sum(axis=1) - 2 * unit @ centroids.T
                near = far.argmin(axis=1)
                away = np.linalg.norm(unit - centroids[near], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(away), pa.array(near.astype(np.int32))],
                    ["id", "v", "away", "list"],
                )

        listed = rows.mapInArrow(assign, f"id {self.kind}, v array<double>, away double, list int")
        # several tasks a list, so that one large list is not one task
        salted = listed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(8)))
        salted.repartition("list", "salt").drop("salt").write.mode("overwrite").partitionBy("list").parquet(
            f"{self.path}/vectors/batch={batch}")

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """Stored rows of all batches; of some lists only, if these are given."""
        found = self.spark.read.schema(
            f"id {self.kind}, v array<double>, away double, batch int, list int"
        ).parquet(f"{self.path}/vectors")
        return found if lists is None else found.filter(F.col("list").isin(lists))

    def nearest(
        self, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False, key: str = "vec_id",
        vector: str = "embedding",
    ) -> DataFrame:
        """(query_id, rank, id, score): the ``k`` nearest stored vectors of each query, its own id left out."""
        centroids, width = self.centroids, self.centroids.shape[1]
        asked = _rows(queries, key, vector, width).select(F.col("id").alias("query_id"), "v")
        kind = asked.schema["query_id"].dataType.simpleString()

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _cut(batches, ASKED_ROWS):
                far = (centroids ** 2).sum(axis=1) - 2 * _unit(part.column(1), width) @ centroids.T
                near = np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield from _probes(part, np.repeat(np.arange(len(near)), near.shape[1]), near.reshape(-1))

        if exact:
            return self._exact(asked, k, kind)
        first = store(asked.mapInArrow(probe, f"query_id {kind}, v array<double>, list int"), "probes")
        return self._compared(first, k, kind)

    def _exact(self, asked: DataFrame, k: int, kind: str) -> DataFrame:
        """The ``k`` nearest of each query among all stored rows."""
        width, spark = self.centroids.shape[1], self.spark
        rows = self.rows().select("list", F.col("id").cast(kind).alias("id"), "v")
        writers = max(1, -(-rows.count() // (FILE_BLOCKS * BLOCK_ROWS)))
        near = rows.repartitionByRange(writers, "list", "id").sortWithinPartitions("list", "id").select("id", "v")
        blocks, path = _packed(near, kind, width, BLOCK_ROWS), work_path(spark, "blocks")
        blocks.write.option("maxRecordsPerFile", FILE_BLOCKS).parquet(path)
        stored = spark.read.schema(blocks.schema).parquet(path).coalesce(1)  # every task reads all blocks, one after the other

        asks = asked.count()
        tasks = max(1, -(-asks // TASK_ROWS), min(-(-asks // LEAST_ROWS), 4 * spark.sparkContext.defaultParallelism))
        held = _packed(asked.select(F.col("query_id").alias("id"), "v").repartition(tasks), kind, width, BLOCK_ROWS)
        pairs = stored.hint("shuffle_replicate_nl").crossJoin(held.select(*(F.col(c).alias(f"asked_{c}") for c in held.columns)))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, _Asked] = {}
            of = None
            for batch in batches:
                of = batch.schema.field("ids").type.value_type
                for at in range(batch.num_rows):
                    cell = {c: batch.column(c)[at] for c in batch.schema.names}
                    number = cell["asked_block"].as_py()
                    if number not in best:
                        best[number] = _Asked(_ids(cell["asked_ids"].values), _floats(cell["asked_unit"], width), k)
                    best[number].meet(
                        _ids(cell["ids"].values), _floats(cell["unit"], width), _floats(cell["centre"], width)[0], cell["radius"].as_py()
                    )
            for one in best.values():
                for row, other, score in one.found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one.ids[row], of), pa.array(other, of), pa.array(score)], ["query_id", "id", "score"]
                    )

        bound = "spark.sql.execution.arrow.maxBytesPerBatch"
        was = spark.conf.get(bound, None)
        spark.conf.set(bound, str(BATCH_BYTES))
        try:
            found = store(pairs.mapInArrow(compare, f"query_id {kind}, id {kind}, score double"), "found")
        finally:
            if was is None:
                spark.conf.unset(bound)
            else:
                spark.conf.set(bound, was)
        return _ranked(found, k)

    def _compared(self, probes: DataFrame, k: int, kind: str) -> DataFrame:
        """The ``k`` nearest of each query in the lists it probes."""
        width = self.centroids.shape[1]
        lists = sorted(r["list"] for r in probes.select("list").distinct().collect())  # at most MOST_LISTS
        rows = self.rows(lists)
        parts = rows.groupBy("list").agg((F.floor(F.count(F.lit(1)) / PART_ROWS) + 1).alias("parts"))
        sides = rows.join(F.broadcast(parts), "list").select(
            "list", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.lit(False).alias("asks"),
            F.col("id").cast(kind).alias("id"), "v",
        ).unionByName(
            probes.join(F.broadcast(parts), "list").select(
                "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                F.lit(True).alias("asks"), F.col("query_id").alias("id"), "v",
            )
        )

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, ids, held = None, [], []
            for batch in batches:
                keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(3)])
                cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
                for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                    place, piece = tuple(keys[:2, start]), batch.slice(start, end - start)
                    if place != now:
                        now, ids, held = place, [], []
                    if not keys[2, start]:
                        ids += piece.column(3).to_pylist()
                        held.append(_unit(piece.column(4), width))
                        continue
                    if not ids:
                        continue
                    held, own = [np.concatenate(held)], np.array(ids)
                    asked = piece.column(3).to_pylist()
                    unit = _unit(piece.column(4), width)
                    for at in range(0, len(asked), 256):
                        scores = np.round(unit[at : at + 256] @ held[0].T, DIGITS)
                        out: list[tuple] = []
                        for query, row in zip(asked[at : at + 256], scores):
                            row = np.where(own == query, -np.inf, row)
                            best = np.lexsort((own, -row))[:k] if len(row) <= 4 * k else _best(row, own, k)
                            out += [(query, ids[b], float(row[b])) for b in best if row[b] > -np.inf]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (piece.schema.field(3).type,) * 2 + (pa.float64(),))],
                            ["query_id", "id", "score"],
                        )

        found = sides.repartition("list", "part").sortWithinPartitions("list", "part", "asks").mapInArrow(
            compare, f"query_id {kind}, id {kind}, score double"
        )
        return _ranked(found, k)


def _ids(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False) if pa.types.is_integer(values.type) else np.array(values.to_pylist())


def _floats(packed: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), np.float64).reshape(-1, width)


def _packed(rows: DataFrame, kind: str, width: int, most: int) -> DataFrame:
    """Rows (id, v) of each partition in blocks of up to ``most``: ids in order, vectors of length one, a ball around them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, number = [], 0, 0
        for part in _cut(batches, most):
            while part.num_rows:
                held.append(part.slice(0, most - count))
                part, count = part.slice(held[-1].num_rows), count + held[-1].num_rows
                if count == most:
                    yield block(held, number)
                    held, count, number = [], 0, number + 1
        if held:
            yield block(held, number)

    def block(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        table = table.take(pc.sort_indices(table.column(0)))
        ids, unit = table.column(0).combine_chunks(), _unit(table.column(1).combine_chunks(), width)
        centre = unit.mean(axis=0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([unit.tobytes()], pa.binary()), pa.array([centre.tobytes()], pa.binary()),
                pa.array([np.linalg.norm(unit - centre, axis=1).max()], pa.float64()),
            ],
            ["block", "ids", "unit", "centre", "radius"],
        )

    return rows.mapInArrow(pack, f"block int, ids array<{kind}>, unit binary, centre binary, radius double")


class _Asked:
    """The best ``k`` so far of a block of queries, tile by tile: rows of the block, ids and scores found."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, k: int):
        self.ids, self.unit, self.short, self.k = ids, unit.copy(), unit.astype(np.float32), k
        self.floor = np.full(len(ids), -np.inf)  # the k-th score, once there is one
        self.found = [(np.zeros(0, np.int64), ids[:0], np.zeros(0)) for _ in range(0, len(ids), TILE_ROWS)]

    def meet(self, ids: np.ndarray, unit: np.ndarray, centre: np.ndarray, radius: float) -> None:
        """One more block of stored vectors, its ids in order."""
        width, short = unit.shape[1], unit.astype(np.float32)
        away = np.sqrt(np.maximum(0, 1 + centre @ centre - 2 * self.unit @ centre))
        # distance of unit vectors from their cosine; no k-th one yet: anything may be nearer
        limit = np.sqrt(np.maximum(0, 2 - 2 * self.floor + 4 * TIE))
        near = ~(away - radius > limit + 1e-6)
        # a product of ``width`` terms is off by less than width + 4 units in the last place of single precision
        floor = (self.floor - (width + 4) * 2.0 ** -23 - TIE).astype(np.float32)
        for tile in range(len(self.found)):
            rows = tile * TILE_ROWS + np.flatnonzero(near[tile * TILE_ROWS : (tile + 1) * TILE_ROWS])
            hit = self.short[rows] @ short.T >= floor[rows, None]
            hits = np.count_nonzero(hit)
            if hits > 4 * self.k * len(rows):
                scores = np.round(self.unit[rows] @ unit.T, DIGITS)
                scores[self.ids[rows, None] == ids] = -np.inf
                at, other = _largest(scores, self.k)
                score = scores[at, other]
            elif hits:
                at, other = np.nonzero(hit)
                score = np.round(np.einsum("ij,ij->i", self.unit[rows[at]], unit[other]), DIGITS)
                score[self.ids[rows[at]] == ids[other]] = -np.inf
            else:
                continue
            kept = score > -np.inf
            self._add(tile, rows[at[kept]], ids[other[kept]], score[kept])

    def _add(self, tile: int, *more: np.ndarray) -> None:
        row, other, score = (np.concatenate(both) for both in zip(self.found[tile], more))
        order = np.lexsort((other, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.floor[row[last]] = score[order][last]
        kept = place < self.k
        self.found[tile] = row[kept], other[order][kept], score[order][kept]


def _largest(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` largest of each row; of equal ones, the first."""
    rows, width = scores.shape
    steps = np.where(np.isfinite(scores), np.rint(scores * 10 ** DIGITS), -4.0 * 10 ** DIGITS).astype(np.int64)
    if width > k:
        other = np.argpartition(steps * width - np.arange(width), width - k, axis=1)[:, width - k :]
    else:
        other = np.broadcast_to(np.arange(width), scores.shape)
    return np.repeat(np.arange(rows), other.shape[1]), other.ravel()


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    floor = np.partition(scores, len(scores) - k)[len(scores) - k]
    near = np.flatnonzero(scores >= floor)
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score"
    )
