"""Exact top-k search by inner product with MaxScore.

A dimension is a query term; its postings in a shard are the shard's values of that dimension,
shifted to be non-negative contributions (weights may have either sign). Terms are ordered by their
greatest contribution in the shard. The threshold is the k-th best score known so far for the
query in this shard; terms whose bounds together cannot lift a row over it are non-essential. Rows
are scored on the essential terms, and the others are probed one by one, only for rows whose score
so far plus the bounds left still reaches the threshold. Rows that tie with the threshold are kept,
so ties go to the smaller id. Every shard gives its own top k; these are merged.

Candidates are dealt into shards of about ``shard_rows`` rows; queries are sent to every shard and
streamed past it, batch by batch. Memory: one shard and one batch.

Defined results: vectors that are null, empty or hold null or non-finite components take no part;
a shorter vector counts as padded with zeros; a query never finds rows that carry its own id;
repeated rows are rows of their own; an empty table gives an empty table. Scores are exact while
they fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.llm.registry import query
from sightline.llm.vectors import matrix, usable
from sightline.session import store

#: Beyond this, sums of products are taken in Python's own integers.
WIDE = 1 << 27


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def integers(column) -> np.ndarray:
    out = matrix(column, np.int64)
    return out.astype(object) if out.size and np.abs(out).max() > WIDE else out


class Shard:
    """Postings of one shard: per dimension its values, least and greatest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.postings = ids, np.ascontiguousarray(vectors.T)
        self.low, self.high = self.postings.min(axis=1), self.postings.max(axis=1)

    @classmethod
    def of(cls, batches: list[pa.RecordBatch]) -> Shard:
        table = pa.Table.from_batches(batches).combine_chunks()
        return cls(table.column("id").to_numpy(), integers(table.column("v")))

    def answers(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        ids, weights = queries.column("id").to_numpy(), integers(queries.column("v"))
        found = [self.top(own, w, k) for own, w in zip(ids, weights)]
        columns = [
            np.repeat(ids, [len(f[0]) for f in found]), np.concatenate([f[0] for f in found]),
            np.concatenate([f[1] for f in found]).astype(np.int64),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "id", "score"])

    def top(self, own: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows other than those with the id ``own``."""
        width = min(len(weights), len(self.postings))
        weights = weights[:width]
        low, high = self.low[:width], self.high[:width]
        # contribution above the least possible one: in [0, bound]
        floor = np.where(weights >= 0, weights * low, weights * high)
        bound = np.abs(weights) * (high - low)
        order = np.argsort(-bound, kind="stable")
        left = bound[order][::-1].cumsum()[::-1]  # bounds of a term and all after it
        base = floor.sum()
        others = np.flatnonzero(self.ids != own)
        # threshold: the k-th best of a first stretch of rows, scored in full
        first = others[: 32 * k]
        sample = weights @ self.postings[:width, first] if len(first) else np.zeros(0, self.postings.dtype)
        rest = others[len(first):]
        if len(sample) < k or not len(rest):
            keep = best(sample, self.ids[first], k)
            return self.ids[first][keep], sample[keep]
        need = np.partition(sample, len(sample) - k)[len(sample) - k]
        # essential: the longest head whose tail alone could still pass the threshold
        essential = int(np.searchsorted(-(base + left), -need, side="right"))
        head = order[: max(1, essential)]
        score = weights[head] @ self.postings[np.ix_(head, rest)]
        spent = floor[head].sum()
        for place in range(len(head), width):
            alive = score + (base - spent) + left[place] >= need
            rest, score = rest[alive], score[alive]
            if not len(rest):
                break
            term = order[place]
            score = score + weights[term] * self.postings[term, rest]
            spent = spent + floor[term]
        rows, scores = np.concatenate([first, rest]), np.concatenate([sample, score])
        keep = best(scores, self.ids[rows], k)
        return self.ids[rows][keep], scores[keep]


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def top_k(
    vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding",
    scale: int = 256, shard_rows: int = 4096,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` best other rows of each row that ``is_query`` selects."""
    rows = store(
        vectors.filter(usable(F.col(vector))).select(
            F.col(key).alias("id"), quantised(F.col(vector), scale).alias("v"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        ).filter(F.col("id").isNotNull()),
        "quantised",
    )
    shards = rows.count() // shard_rows + 1
    # dealt by row number: repeated rows spread as well
    sides = rows.select(
        F.pmod(F.monotonically_increasing_id(), F.lit(shards)).alias("shard"),
        F.lit(False).alias("asks"), "id", "v",
    ).unionByName(
        rows.filter("asks").select(
            F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "asks", "id", "v"
        )
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, shard = None, [], None
        for batch in batches:
            number, asks = batch.column("shard").to_numpy(), np.asarray(batch.column("asks"))
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(number)]):
                if number[start] != current:
                    current, held, shard = number[start], [], None
                part = batch.slice(start, end - start)
                if not asks[start]:
                    held.append(part)
                    continue
                if shard is None:
                    shard = Shard.of(held) if held else False
                if shard:
                    yield shard.answers(part, k)

    found = sides.repartition(int(shards), "shard").sortWithinPartitions("shard", "asks").mapInArrow(
        search, "query_id long, id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "id", "score"
    )


@query("op10_maxscore", "embeddings", sql="""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(embedding) > 0
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def op10(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.col("vec_id") % 50 == 0, 5).withColumnRenamed("id", "vec_id")
