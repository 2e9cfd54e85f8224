"""Classification of metadata rows: embeddings, anchors, cascade, text-model output."""

from __future__ import annotations

import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.ids import to_hex
from sightline.functions.text import xml_record
from sightline.functions.vectors import once, rounded, unit
from sightline.vocab import CATEGORIES, FALLBACK_CATEGORY, RETRY_SUFFIX

# Anchor vectors sent to the tasks at once: at most this many bytes as doubles.
ANCHOR_BLOCK_BYTES = 32 * 1024 * 1024


def embed(items: DataFrame, text: str, model: Callable[[], Callable[[list[str]], list]], batch_size: int = 64,
          output: str = "embedding") -> DataFrame:
    """Add an embedding column.

    ``model`` is called once per task and returns a function from a list of texts to vectors.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for texts in batches:
            texts = texts.fillna("").tolist()
            out: list = []
            for at in range(0, len(texts), batch_size):
                out.extend(np.asarray(v, dtype="float32") for v in encode(texts[at:at + batch_size]))
            yield pd.Series(out)

    return items.withColumn(output, run(F.col(text)))


def hashed_embedding(items: DataFrame, text: str, size: int = 64, output: str = "embedding") -> DataFrame:
    """Model-free embedding: hashed word counts scaled to unit length (all in the JVM)."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    slots = F.transform(
        words,
        lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(size)).cast("int"),
    )
    counts = once(slots, lambda found: F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(found) - F.size(F.array_remove(found, i))
    ))
    return items.withColumn(output, unit(counts).cast("array<float>"))


def _anchor_blocks(anchors: DataFrame, vector: str, order: str) -> Iterator[tuple[list[str], np.ndarray]]:
    """Anchor vectors in file order, in blocks of bounded size."""
    first = anchors.select(F.size(vector).alias("n")).first()
    if first is None:
        return
    per_block = max(1, ANCHOR_BLOCK_BYTES // (8 * max(1, first["n"])))
    rows = anchors.select("category", vector).orderBy(order).toLocalIterator()
    names, vectors = [], []
    for row in rows:
        names.append(row["category"])
        vectors.append(row[vector])
        if len(names) == per_block:
            yield names, np.asarray(vectors, dtype="float64")
            names, vectors = [], []
    if names:
        yield names, np.asarray(vectors, dtype="float64")


def anchor_scores(
    items: DataFrame, anchors: DataFrame, key: str, vector: str = "embedding", *,
    order: str, top: int = 1, normalize: bool = False,
) -> DataFrame:
    """Per item the ``top`` categories by dot product with their best anchor.

    Returns (key, candidates: array<category, confidence>), best first, ties to the anchor that
    comes first. Anchors travel in blocks of bounded size and each task multiplies its item
    batches with the block; per item and block only ``top`` scores leave the task. An item
    without a vector, or with a null or non-finite component in it, has no candidates.
    """
    kind = items.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, candidates array<struct<category:string,confidence:double,place:bigint>>"
    parts, offset = None, 0
    usable = F.coalesce(
        (F.size(vector) > 0)
        & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False)
    )
    nothing = F.array().cast("array<struct<category:string,confidence:double>>").alias("candidates")

    for names, matrix in _anchor_blocks(anchors, vector, order):
        labels = list(dict.fromkeys(names))
        groups = [np.flatnonzero(np.array(names) == n) for n in labels]

        def score(batches: Iterator[pa.RecordBatch], matrix=matrix, labels=labels, groups=groups,
                  offset=offset) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, vectors = batch.column(0), batch.column(1)
                data = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64")
                data = data.reshape(len(ids), -1)
                if normalize:
                    data = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-300)
                sims = data @ matrix.T
                best = np.stack([sims[:, g].max(axis=1) for g in groups], axis=1)
                where = np.stack([g[sims[:, g].argmax(axis=1)] for g in groups], axis=1)
                chosen = np.lexsort((where, -best))[:, :top]
                width = chosen.shape[1]
                found = pa.StructArray.from_arrays(
                    [
                        pa.array(labels, pa.string()).take(pa.array(chosen.ravel())),
                        pa.array(np.take_along_axis(best, chosen, 1).ravel(), pa.float64()),
                        pa.array(np.take_along_axis(where, chosen, 1).ravel() + offset, pa.int64()),
                    ],
                    names=["category", "confidence", "place"],
                )
                ends = pa.array(np.arange(0, (len(ids) + 1) * width, width), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.ListArray.from_arrays(ends, found)], names=[key, "candidates"]
                )

        part = items.select(key, vector).filter(usable).mapInArrow(score, schema)
        parts = part if parts is None else parts.unionByName(part)
        offset += len(names)

    if parts is None:
        return items.select(key, nothing)
    scored = parts
    if offset > 0 and parts is not part:
        # several blocks: best anchor per category, then the best categories
        flat = parts.select(key, F.explode("candidates").alias("c")).select(key, "c.*")
        best = flat.groupBy(key, "category").agg(
            F.max(F.struct("confidence", (-F.col("place")).alias("back"))).alias("s")
        )
        scored = best.groupBy(key).agg(
            F.slice(
                F.sort_array(F.collect_list(F.struct("s.confidence", "s.back", "category")), False), 1, top
            ).alias("candidates")
        )
    return scored.select(
        key,
        F.transform(
            "candidates",
            lambda c: F.struct(c["category"].alias("category"), c["confidence"].alias("confidence")),
        ).alias("candidates"),
    ).unionByName(items.filter(~usable).select(key, nothing))


def cascade(
    items: DataFrame, *, linear: Column | None = None, anchor: Column | None = None,
    linear_threshold: float = 0.6, anchor_threshold: float = 0.5, model: str = "", classifier: str = "none",
) -> DataFrame:
    """Add category, confidence and method.

    ``linear`` is an array of (category, confidence) from a trained model, best first;
    ``anchor`` one (category, confidence). The first that reaches its threshold decides, else
    the row is Other with 0.
    """
    nothing = F.lit(None).cast("struct<category:string,confidence:double>")
    best = F.try_element_at(linear, F.lit(1)) if linear is not None else nothing
    near = anchor if anchor is not None else nothing
    use_linear = F.coalesce(best["confidence"] >= linear_threshold, F.lit(False))
    use_anchor = ~use_linear & F.coalesce(near["confidence"] >= anchor_threshold, F.lit(False))

    def pick(a: Column, b: Column, c: Column) -> Column:
        return F.when(use_linear, a).when(use_anchor, b).otherwise(c)

    out = items.select(
        "*",
        pick(best["category"], near["category"], F.lit(FALLBACK_CATEGORY)).alias("category"),
        pick(
            rounded(best["confidence"]), rounded(near["confidence"]), F.lit(0.0)
        ).alias("confidence"),
        pick(F.lit("linear"), F.lit("anchor"), F.lit("fallback")).alias("method"),
        F.lit(model).alias("model"),
        F.lit(classifier).alias("classifier"),
    )
    if linear is not None:
        top = F.transform(
            F.slice(linear, 1, 3),
            lambda c: F.struct(
                c["category"].alias("category"), rounded(c["confidence"]).alias("confidence")
            ),
        )
        out = out.withColumn("top_candidates", top)
    return out


def method_mix(predictions: DataFrame) -> DataFrame:
    """Count and percentage of each method."""
    total = predictions.agg(F.count(F.lit(1))).scalar()
    return predictions.groupBy("method").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "percent", F.col("n") * 100.0 / total
    )


# ---- text-model mode -------------------------------------------------------------------

_PLAIN = (
    r"(?s)^<classification>\s*<category>([^<&]*)</category>\s*"
    r"<confidence>([^<&]*)</confidence>\s*</classification>$"
)
_NUMBER = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"
# How a block and, in a cut answer, the two tags are found.
_BLOCK = r"(?s)<classification>.*?</classification>"
_CATEGORY_TAG = r"(?U)<category>\s*(\w+)\s*</category>"
_CONFIDENCE_TAG = r"(?U)<confidence>\s*([\d.]+)\s*</confidence>"


DOCUMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("root", "category", "confidence")])


def document_fields(text: str | None) -> tuple:
    """Root tag, category text and confidence text of an XML document; nulls if it is none."""
    try:
        root = ET.fromstring(text)
    except (ET.ParseError, TypeError, ValueError):
        return None, None, None
    return root.tag, root.findtext("category"), root.findtext("confidence")


@F.pandas_udf(DOCUMENT)
def xml_documents(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        [document_fields(t) for t in texts], columns=DOCUMENT.names, dtype=object
    )


def _both(category: Column, confidence: Column) -> Column:
    def strip(c: Column) -> Column:
        return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    return F.struct(strip(category).alias("category"), strip(confidence).alias("number"))


def parse_answers(
    df: DataFrame, raw: str, aliases: dict[str, str] | None = None,
    categories: list[str] | None = None,
) -> DataFrame:
    """Add category, confidence and parse_status to raw model answers.

    Fences are dropped first. An answer is read as a plain block, else as an XML document, else
    as the first block in it, else by its two tags. Only the XML of answers that are no plain
    block goes through Python; whichever way the two texts were found, the same expressions
    check and round them. ``aliases`` maps further category spellings to allowed ones.
    """
    allowed = list(categories or CATEGORIES)
    names = {**{c: c for c in allowed}, **(aliases or {})}
    text = F.trim(F.regexp_replace(F.trim(F.col(raw)), r"(?i)```(?:xml)?\s*", ""))
    text = F.regexp_replace(text, r"^\s+|\s+$", "")

    def extract(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract("_text", pattern, group)

    def answer(document: str) -> Column:
        return F.when(
            F.col(f"{document}.root") == "classification",
            _both(F.col(f"{document}.category"), F.col(f"{document}.confidence")),
        )

    plain, whole = F.col("_text").rlike(_PLAIN), F.col("_whole.root").isNotNull()
    block = F.nullif(extract(_BLOCK, 0), F.lit(""))
    read = (
        df.withColumn("_text", text)
        .withColumn("_whole", xml_documents(F.when(~plain, F.col("_text"))))
        .withColumn("_block", xml_documents(F.when(~plain & ~whole, block)))
        .withColumn(
            "_found",
            F.when(plain, _both(extract(_PLAIN, 1), extract(_PLAIN, 2)))
            .when(whole, answer("_whole"))
            .when(F.col("_block.root").isNotNull(), answer("_block"))
            .otherwise(_both(extract(_CATEGORY_TAG), extract(_CONFIDENCE_TAG))),
        )
    )
    number = F.col("_found.number")
    value = F.when(number.rlike(_NUMBER), F.replace(number, F.lit("_"), F.lit("")).try_cast("double"))
    ok = F.coalesce(F.col("_found.category").isin(list(names)) & value.between(0.0, 1.0), F.lit(False))
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return read.select(
        *df.columns,
        F.when(ok, F.element_at(lookup, F.col("_found.category")))
        .otherwise(F.lit(FALLBACK_CATEGORY)).alias("category"),
        F.when(ok, rounded(value)).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(ok, F.lit("success")).otherwise(F.lit("parse_fail")).alias("parse_status"),
    )


def messages(
    system: str, fewshot: list[tuple[str, str]], record: Column, retry: bool = False
) -> Column:
    """Chat messages: system text, example pairs, then the record below a fixed heading."""
    def entry(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    turns = [entry("system", F.lit(system + (RETRY_SUFFIX if retry else "")))]
    for user, assistant in fewshot:
        turns += [entry("user", F.lit(user)), entry("assistant", F.lit(assistant))]
    turns.append(entry("user", F.concat(F.lit("Torrent metadata:\n"), record)))
    return F.array(*turns)


def _shown(items: DataFrame, key: str) -> Column:
    """An id as text; binary ids in hex."""
    return to_hex(F.col(key)) if items.schema[key].dataType == T.BinaryType() else F.col(key).cast("string")


def classify_with_model(
    items: DataFrame, generate: Callable[[], Callable[[list[dict]], str]], *, system: str,
    fewshot: list[tuple[str, str]] = (), key: str = "infohash", retry: bool = False,
    model: str = "unknown", aliases: dict[str, str] | None = None, table_path: str | None = None,
) -> DataFrame:
    """Classify rows with a text model.

    ``items`` has key, name, file_count, total_size and top_dirs. ``generate`` is called once
    per task and returns a function from messages to text. With ``retry``, the answers are
    written to a table first, so the second pass runs the model on failures only.
    """
    record = xml_record(
        _shown(items, key), F.col("name"), F.col("file_count"), F.col("total_size"),
        F.col("top_dirs"),
    )
    fields = f"`{key}` {items.schema[key].dataType.simpleString()}, raw_output string, latency_ms double"

    def ask(rows: DataFrame, again: bool) -> DataFrame:
        prompts = rows.select(key, messages(system, fewshot, record, again).alias("messages"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reply = generate()
            for pdf in batches:
                out, spent = [], []
                for turns in pdf["messages"]:
                    began = time.perf_counter()
                    out.append(reply([dict(t) if isinstance(t, dict) else t.asDict() for t in turns]))
                    spent.append((time.perf_counter() - began) * 1000)
                yield pd.DataFrame({key: pdf[key], "raw_output": out, "latency_ms": spent})

        answers = prompts.mapInPandas(run, fields)
        return parse_answers(answers, "raw_output", aliases).withColumn("retry_used", F.lit(again))

    answers = ask(items, False)
    if retry:
        from sightline.session import work_path

        path = table_path or work_path(items.sparkSession, "answers")
        answers.write.mode("overwrite").parquet(path)
        first = items.sparkSession.read.parquet(path)
        failed = first.filter(F.col("parse_status") == "parse_fail").select(
            key, F.col("latency_ms").alias("_before")
        )
        second = (
            ask(items.join(failed.select(key), key, "left_semi"), True)
            .join(failed, key)
            .withColumn("latency_ms", F.col("latency_ms") + F.col("_before"))
            .drop("_before")
        )
        answers = first.filter(F.col("parse_status") == "success").unionByName(second)
    return answers.select(
        key, "category", "confidence", F.lit("llm").alias("method"), F.lit(model).alias("model"),
        F.lit("llm").alias("classifier"), "raw_output", "parse_status", "retry_used",
        F.round("latency_ms", 1).alias("latency_ms"),
    )


def run_summary(predictions: DataFrame) -> DataFrame:
    """Totals, parse failures and average latency of a text-model run."""
    return predictions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("parse_status") == "success").alias("success"),
        F.count_if(F.col("parse_status") != "success").alias("parse_fail"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )


def valid_predictions(predictions: DataFrame) -> DataFrame:
    """Rows with a known category and a confidence from 0 to 1."""
    return predictions.filter(
        F.col("category").isin(CATEGORIES) & F.col("confidence").between(0.0, 1.0)
    )
