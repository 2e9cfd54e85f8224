"""A training-data pipeline over ``documents``; every stage's result is written and read again.

Language ID drops documents without a letter or without a language above ``LEAST_SCORE``; line dedup
takes out lines found in ten documents and more; the Jaccard join leaves the smallest id of each group
of near duplicates; mixing takes each source's words up to its target, a document once per round; packing
cuts what is left into sequences. ``n_chars`` follows the text.

Defined results: null and empty texts are rejected by the first stage; rows with a null id are documents of
their own, which are near duplicates of none; of rows that agree in id and text one stays; other columns
pass through, but for ``n_chars``; an empty table gives an empty table.

Memory: an Arrow batch to a Python worker holds ``BATCH`` bytes of rows (or one row), however long the texts
are; the stages with Python set this for the session, and it stays set. It changes no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.llm.common import fresh
from sightline.llm.langid import UND, predict, train
from sightline.llm.line_dedup import drop_frequent_lines
from sightline.llm.mixing import mixed_documents
from sightline.llm.packing import packed_documents
from sightline.llm.parity_join import jaccard_components
from sightline.session import prepare, store

#: Stages that SQL cannot express are tested against brute force instead.
ORACLE_SQL = None
#: A document whose best language has less than this share of the probability is rejected.
LEAST_SCORE = 0.3
#: Rows of an Arrow batch, in bytes; a task holds a batch several times over, in the JVM and in Python.
BATCH = "1m"
#: Pieces in a generation of a worker's cache when packing; the workers outlive the stage with what they hold.
KNOWN = 60_000


def counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    (found,) = fresh(docs, "_language")
    model = train(docs, F.lit(True))
    kept = docs.withColumn(found, predict(docs, model)).filter(
        (F.col(f"{found}.lang_pred") != UND) & (F.col(f"{found}.score") >= LEAST_SCORE)
    )
    return kept.select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(drop_frequent_lines(docs).select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays (of several rows with that
    id, the one with the smallest text hash). Rows are told apart by id and text hash, so a text under an
    id that a copy carries, too, is judged for itself."""
    small_batches(spark)
    gone_id, mark, gone_mark = fresh(docs, "_gone", "_mark", "_gone_mark")
    digest = F.unhex(F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), 1, 32))
    groups = store(
        jaccard_components(docs, mark=digest).filter(F.col("class").isNotNull())
        .select("class", F.struct("id", "mark").alias("row")), "groups",
    )
    kept = groups.groupBy("class").agg(F.min("row").alias("stays"), F.max("row").alias("last"))
    gone = groups.join(kept.filter("stays <> last").drop("last"), "class").filter("row <> stays").select(
        F.col("row.id").alias(gone_id), F.col("row.mark").alias(gone_mark)
    ).distinct()
    # rows that agree in id and text are copies of one document; the join has dealt them out already
    return (
        docs.withColumn(mark, digest)
        .join(store(gone, "copies"), (F.col("doc_id") == F.col(gone_id)) & (F.col(mark) == F.col(gone_mark)), "left_anti")
        .dropDuplicates(["doc_id", mark]).select(docs.columns)
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(mixed_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packed_documents(docs, known=KNOWN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language id", language_id),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("mixing to target weights", mix_sources),
    ("vector packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
