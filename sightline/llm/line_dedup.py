"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches. Each batch becomes a run: a table of (line hash, documents), bucketed
and sorted by hash. Before it is written, the batch is merge-anti-joined with the runs: hashes that
already reach the wanted count need no more counting. When a level holds ``fanout`` runs they are
merged into one run of the next level, again bucket by bucket without a shuffle. All columns are
native expressions.

Defined results: a null or empty text is one empty line; an empty key never counts; every row is a
document of its own (repeated rows count each); a line's key is its 64-bit hash; rows that agree in
``doc_id`` and text get the same answer; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sightline.llm.common import SPACE, ascii_lower, fresh, same
from sightline.llm.registry import query
from sightline.session import store


class LineRuns:
    """Levelled runs of (hash, docs), as bucketed tables in the session's warehouse."""

    def __init__(self, spark: SparkSession, enough: int, fanout: int = 2):
        self.spark, self.enough, self.fanout = spark, enough, fanout
        # as many buckets as shuffle partitions: each bucket is then written as one sorted file
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame | None:
        out = None
        for name in names:
            run = self.spark.table(name)
            if out is None:
                out = run
                continue
            run = run.select("hash", F.col("docs").alias("more"))
            total = F.coalesce(F.col("docs"), F.lit(0)) + F.coalesce(F.col("more"), F.lit(0))
            out = out.join(run, "hash", "full").select("hash", total.alias("docs"))
        return out

    def add(self, counts: DataFrame) -> None:
        """Add a batch of (hash, docs); compact every level that is full."""
        for name in self.names():
            done = self.spark.table(name).filter(F.col("docs") >= self.enough)
            counts = counts.join(done, "hash", "left_anti")
        new, level = self._write(counts), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            new, level = self._write(self._merged(full)), level + 1
            self._drop(full)

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def frequent(self) -> DataFrame:
        """The hashes found in enough documents, written as a table of their own."""
        rows = self._merged(self.names()).filter(F.col("docs") >= self.enough)
        return store(rows.select("hash"), "frequent-lines")

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        self._drop(self.names())
        self.levels = []


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column) -> Column:
    """One hash per line, null for lines whose key is empty."""

    def one(line: Column) -> Column:
        trimmed = F.btrim(line, F.lit(SPACE))
        return F.when(trimmed != "", F.xxhash64(ascii_lower(trimmed)))

    return F.transform(lines_of(text), one)


def frequent_lines(
    docs: DataFrame, text: str, key: str, min_docs: int, batches: int, fanout: int
) -> DataFrame:
    """Hashes of the lines found in at least ``min_docs`` rows, counted batch by batch."""
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    batch = F.coalesce(F.pmod(F.xxhash64(F.col(key)), F.lit(batches)), F.lit(0))
    for n in range(batches):
        found = docs.filter(batch == n).select(
            F.explode(F.array_distinct(line_hashes(F.col(text)))).alias("hash")
        )
        runs.add(
            found.filter(F.col("hash").isNotNull()).groupBy("hash").agg(F.count("*").alias("docs"))
        )
    out = runs.frequent()
    runs.close()
    return out


def drop_frequent_lines(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    min_docs: int = 10,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """``docs`` with every line found in ``min_docs`` documents removed from ``text``.

    Adds ``n_lines`` (before) and ``n_dropped``; under other names if ``docs`` has these already.
    """
    total, dropped, crc, at, out_at, cut = fresh(
        docs, "n_lines", "n_dropped", "_crc", "_key", "_at", "_lines"
    )
    hot = frequent_lines(docs, text, key, min_docs, batches, fanout)
    marked = docs.withColumn(crc, F.crc32(F.col(text).cast("binary")))
    places = (
        marked.select(
            F.col(key).alias("k"), F.col(crc).alias("c"),
            F.posexplode(line_hashes(F.col(text))).alias("at", "hash"),
        )
        .filter(F.col("hash").isNotNull())
        .join(hot, "hash", "left_semi")
        .groupBy("k", "c")
        .agg(F.collect_set("at").alias(out_at))
        .withColumnsRenamed({"k": at, "c": f"{crc}_r"})
    )
    joined = marked.join(
        places, same(F.col(key), F.col(at)) & same(F.col(crc), F.col(f"{crc}_r")), "left"
    )
    # a column of its own: inside a lambda the split would run once per line
    joined = joined.withColumn(cut, lines_of(F.col(text)))
    gone = F.coalesce(F.col(out_at), F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), gone)
    rebuilt = F.when(F.col(out_at).isNull(), F.col(text)).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col(cut), i)), "\n")
    )
    return joined.select(
        *[rebuilt.alias(text) if c == text else F.col(c) for c in docs.columns],
        F.size(cut).cast("long").alias(total),
        F.size(gone).cast("long").alias(dropped),
    )


@query("op5_line_dedup", "documents", sql="""
    WITH doc AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l
                 FROM documents),
    line AS (SELECT r, doc_id, unnest(l) AS v, unnest(range(len(l))) AS pos FROM doc),
    keyed AS (SELECT *, translate(trim(v, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
              FROM line),
    hot AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
    marked AS (SELECT keyed.*, hot.k IS NOT NULL AS gone FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
    SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(v, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY r, doc_id
""")
def op5(documents: DataFrame) -> DataFrame:
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return drop_frequent_lines(documents.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256")
    )
