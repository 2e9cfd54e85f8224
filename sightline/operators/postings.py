"""Search by a stored posting table instead of a scan of all names.

Two kinds of pieces are stored. A *window* is the run of up to three characters of the lower-cased
name that starts at a position; it answers whether a name contains a term. A *word piece* is a trigram of
a padded word; it answers how similar a name is. Ids are dealt into blocks of about ``block_rows``
by hash, and one row holds the postings of one piece in one block, sorted: parallel lists of ids and of
positions (for word pieces: of the number of pieces the name has). So no list grows with the
table, and a frequent piece is many rows of many files.

Names, not their pieces, are shuffled: a task gets whole blocks and cuts their names itself. A block
whose names are long is written in runs of about ``RUN_CHARS`` characters, each with rows of its own.

Files are partitioned by a hash bucket of the piece and sorted by piece: a term reads only the
buckets of its own pieces. Windows of a term of three and more characters must be found at matching
positions; a shorter term reads the windows that start with it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import term_trigrams, trigrams
from sightline.vocab import SIMILARITY_THRESHOLD

WINDOW, WORD = 0, 1
#: Characters and word pieces whose postings a task holds at once, beyond those of one name, and
#: characters of names dealt to one task.
RUN_CHARS, TASK_CHARS = 1 << 21, 32 << 20


def _listed(pieces: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pieces, where their lists start, ids, numbers), lists sorted by id and number as they came."""
    order = np.argsort(pieces, kind="stable")
    pieces = pieces[order]
    starts = np.flatnonzero(np.concatenate([[True], pieces[1:] != pieces[:-1]]))
    return pieces[starts], np.append(starts, len(pieces)), ids[order], numbers[order]


def _windows(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece as three code points of 21 bits, number of the name, position) of every character."""
    lengths = np.array([len(n) for n in names])
    chars = np.frombuffer("".join(names).encode("utf-32-le"), "<u4").astype(np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(chars))
    # one more than the code point, so that 0 says that the name has ended
    codes = np.concatenate([chars + 1, [0, 0]])
    second = np.where(at + 1 < ends, codes[1:-1], 0)
    third = np.where(at + 2 < ends, codes[2:], 0)
    owner = np.repeat(np.arange(len(names)), lengths)
    return (codes[:-2] << 42) | (second << 21) | third, owner, at - (ends - lengths[owner])


def _texts(windows: np.ndarray) -> list[str]:
    parts = [((windows >> shift) & 0x1FFFFF).tolist() for shift in (42, 21, 0)]
    return ["".join(chr(c - 1) for c in piece if c) for piece in zip(*parts)]


def _bucket(kind: Column, piece: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(kind, piece), F.lit(buckets)).cast("int")


def write_postings(
    items: DataFrame, path: str, key: str, name: str = "name", *, buckets: int = 64, block_rows: int = 4096,
    words: bool = True,
) -> PostingTable:
    """Build the table below ``path`` from all rows with a name; without ``words`` for containment only."""
    named = items.filter(F.col(name).isNotNull()).select(F.col(key).alias("id"), F.lower(name).alias("low"), *(
        [trigrams(F.col(name)).alias("words")] if words else []
    ))
    sizes = named.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("low")), F.lit(0)).alias("chars")).first()
    tasks = max(items.sparkSession.sparkContext.defaultParallelism, sizes["chars"] // TASK_CHARS + 1)
    # no fewer blocks than tasks, but for a few names
    blocks = max(sizes["n"] // block_rows + 1, min(tasks, sizes["n"] // 256))
    kind = items.schema[key].dataType.simpleString()
    placed = named.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    # names are dealt out by block; what is cut from them stays in the task
    dealt = placed.repartition(min(tasks, blocks), "block").sortWithinPartitions("block", "id").select("block", "id", "low", *(["words"] if words else []))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, names, grams, held = None, [], [], [], 0

        def made() -> Iterator[pa.RecordBatch]:
            owned = pa.concat_arrays(ids)
            found = [(WINDOW, *_windows(names))]
            if words:
                flat = [(piece, n, len(own)) for n, own in enumerate(grams) for piece in own or ()]
                known = sorted({piece for piece, _, _ in flat})
                number = {piece: n for n, piece in enumerate(known)}
                found.append((WORD, *(np.array(c, np.int64) for c in (
                    [number[piece] for piece, _, _ in flat], [n for _, n, _ in flat], [size for _, _, size in flat]
                ))))
            for what, pieces, owners, numbers in found:
                if not len(pieces):
                    continue
                distinct, cuts, owners, numbers = _listed(pieces, owners, numbers)
                texts = _texts(distinct) if what == WINDOW else [known[n] for n in distinct]
                # rows go out before they are too many for one batch
                first = 0
                while first < len(texts):
                    last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + 100_000, "right")) - 1)
                    last = min(last, len(texts), first + 10_000)
                    offsets = pa.array((cuts[first : last + 1] - cuts[first]).astype(np.int32))
                    run = slice(cuts[first], cuts[last])
                    size = last - first
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(size, what, np.int32)), pa.array(texts[first:last], pa.string()),
                        pa.array(np.full(size, block, np.int64)),
                        pa.ListArray.from_arrays(offsets, owned.take(pa.array(owners[run]))),
                        pa.ListArray.from_arrays(offsets, pa.array(numbers[run].astype(np.int32))),
                    ], ["kind", "piece", "block", "ids", "numbers"])
                    first = last

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ((0, 2, 3) if words else (0, 2))]
            start = 0
            for at in range(batch.num_rows):
                if columns[0][at] != block or held >= RUN_CHARS:
                    if at > start:
                        ids.append(batch.column(1).slice(start, at - start))
                    if names:
                        yield from made()
                    block, start, ids, names, grams, held = columns[0][at], at, [], [], [], 0
                names.append(columns[1][at])
                held += len(columns[1][at])
                if words:
                    grams.append(columns[2][at])
                    held += len(columns[2][at] or ())
            ids.append(batch.column(1).slice(start))
        if names:
            yield from made()

    rows = dealt.mapInArrow(lists, f"kind int, piece string, block bigint, ids array<{kind}>, numbers array<int>")
    rows.select(
        _bucket(F.col("kind"), F.col("piece"), buckets).alias("bucket"), "kind", "piece", "block", "ids", "numbers"
    ).sortWithinPartitions("bucket", "kind", "piece", "block").write.mode("overwrite").partitionBy("bucket").parquet(
        f"{path}/postings"
    )
    spark = items.sparkSession
    facts = {"words": words, "key": kind, "buckets": buckets, "blocks": blocks}
    spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")
    return PostingTable(spark, path)


class PostingTable:
    """A posting table on disk and the terms it answers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        self.key, self.buckets, self.blocks = facts["key"], facts["buckets"], facts["blocks"]
        self.words = facts["words"]

    def rows(self) -> DataFrame:
        return self.spark.read.schema(
            f"kind int, piece string, block bigint, ids array<{self.key}>, numbers array<int>, bucket int"
        ).parquet(f"{self.path}/postings")

    def _lowered(self, term: str) -> str:
        """Lower case as Spark writes it, so that term and names agree."""
        return self.spark.range(1).select(F.lower(F.lit(term))).first()[0]

    def _pieces(self, kind: int, pieces: list[str]) -> DataFrame:
        """Postings of whole pieces; only their buckets are read."""
        asked = self.spark.range(1).select(
            F.explode(F.array(*[F.lit(p) for p in pieces])).alias("p")
        ).select(_bucket(F.lit(kind), F.col("p"), self.buckets).alias("b")).distinct()
        buckets = sorted(r.b for r in asked.collect())  # at most one per piece of the term
        return self.rows().filter(
            F.col("bucket").isin(buckets) & (F.col("kind") == kind) & F.col("piece").isin(pieces)
        )

    def containing(self, term: str) -> DataFrame:
        """(id) of the names that contain the term, case ignored."""
        low = self._lowered(term)
        if len(low) < 3:
            found = self.rows().filter((F.col("kind") == WINDOW) & F.col("piece").startswith(low))
            return found.select(F.explode("ids").alias("id")).distinct()
        places: dict[str, list[int]] = {}
        for at in range(len(low) - 2):
            places.setdefault(low[at : at + 3], []).append(at)
        offsets = F.create_map(*[
            F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in places.items() for x in pair
        ])
        # where the term would have to start for a window to be in its place
        starts = (
            self._pieces(WINDOW, sorted(places))
            .select(F.element_at(offsets, F.col("piece")).alias("offsets"), F.explode(F.arrays_zip("ids", "numbers")).alias("e"))
            .select(F.col("e.ids").alias("id"), F.col("e.numbers").alias("number"), F.explode("offsets").alias("offset"))
            .select("id", (F.col("number") - F.col("offset")).alias("start"))
        )
        return (
            starts.groupBy("id", "start").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") == len(low) - 2).select("id").distinct()
        )

    def similar(self, term: str, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
        """(id, similarity) of the names whose trigram similarity reaches the threshold."""
        if not self.words:
            raise ValueError("the table was written without word pieces")
        pieces = term_trigrams(term)
        if not pieces:
            return self.rows().select(F.explode("ids").alias("id"), F.lit(0.0).alias("similarity")).limit(0)
        shared = (
            self._pieces(WORD, pieces)
            .select(F.explode(F.arrays_zip("ids", "numbers")).alias("e"))
            .groupBy(F.col("e.ids").alias("id"), F.col("e.numbers").alias("grams"))
            .agg(F.count(F.lit(1)).alias("shared"))
        )
        score = F.col("shared") / (F.col("grams") + F.lit(len(pieces)) - F.col("shared"))
        return shared.select("id", score.alias("similarity")).filter(F.col("similarity") >= threshold)

    def matching(self, term: str) -> DataFrame:
        """(id) of the names that contain the term or are similar to it."""
        return self.containing(term).union(self.similar(term).select("id")).distinct()
