"""Language identification by sparse multinomial logistic regression.

Features are hashed character 1- to 3-grams of the lower-cased text (everything that is no letter
is one space), log-scaled counts times inverse document frequency, scaled to length one. Document
frequencies are counted over all training rows. Weights are learned by follow-the-regularised-
leader with elastic-net penalties: a bounded sample of about ``per_class`` rows per language is
dealt to ``learners`` tasks, each runs a few epochs, and the weights are averaged. A temperature is
then chosen on other training rows by mean log loss over a grid.

Bounds: ``per_class`` rows per language are trained on (four to one for calibration), at most
``max_classes`` languages, ``2^bits`` features; the model is broadcast and is at most
``2^bits x max_classes`` floats. Texts are read whole, in stretches.

Defined results: null text and text without a letter is ``und`` with score 1; without any labelled
row every text is ``und`` with score 0; equal scores go to the first language by code point; null
languages are never learned; repeated rows are rows of their own; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sightline.llm.registry import query

BITS = 15
STRETCH = 1 << 20
UND = "und"
GRID = np.round(np.geomspace(0.05, 5.0, 41), 6)

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Per code point: is it a letter? Built once per process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams; all zero if there is no letter."""
    counts = np.zeros(1 << bits, np.int64)
    tail = np.array([32], np.uint64)
    for at in range(0, len(text), STRETCH):
        codes = np.frombuffer(text[at : at + STRETCH].lower().encode("utf-32-le", "replace"), "<u4")
        codes = np.where(letters()[codes], codes, 32).astype(np.uint64)
        codes = np.concatenate([tail, codes])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        new = len(tail)
        grams = [codes[new:][codes[new:] != 32]]
        for n in (2, 3):
            if len(codes) >= n:
                hashed = np.zeros(len(codes) - n + 1, np.uint64)
                for k in range(n):
                    hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k]
                # those that begin in the carried tail were counted before, unless they end here
                ends = np.arange(n - 1, len(codes))
                grams.append((hashed + np.uint64(n))[ends >= new])
        hashed = np.concatenate(grams) * np.uint64(0xBF58476D1CE4E5B9)
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0x94D049BB133111EB)
        counts += np.bincount((hashed >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        tail = codes[-2:]
    return counts


def has_letter(text: str) -> bool:
    return any(
        letters()[np.frombuffer(text[at : at + STRETCH].encode("utf-32-le", "replace"), "<u4")].any()
        for at in range(0, len(text), STRETCH)
    )


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, values) of length one."""
    at = np.flatnonzero(counts)
    value = np.log1p(counts[at]) * idf[at]
    norm = np.sqrt((value * value).sum())
    return at, value / norm if norm else value


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader, per coordinate, with l1 and l2 penalties."""

    def __init__(self, features: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        scale = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / scale, 0.0)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        weights = self.weights(at)
        miss = softmax(value @ weights)
        miss[label] -= 1.0
        step = value[:, None] * miss
        more = self.n[at] + step * step
        self.z[at] += step - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * weights
        self.n[at] = more


class Model:
    """Languages, inverse document frequencies, weights (the last row is the bias), temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.languages, self.idf = languages, idf.astype(np.float32)
        self.weights, self.temperature = weights.astype(np.float32), temperature

    def logits(self, text: str) -> np.ndarray:
        at, value = weighted(gram_counts(text, int(np.log2(len(self.idf)))), self.idf)
        return value @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not has_letter(text):
            return UND, 1.0
        if not self.languages:
            return UND, 0.0
        chance = softmax(self.logits(text).astype(float) / self.temperature)
        best = int(chance.argmax())
        return self.languages[best], float(chance[best])


def train(
    docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id",
    per_class: int = 2000, learners: int = 8, epochs: int = 2, max_classes: int = 256,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.001, bits: int = BITS,
) -> Model:
    """A model from the rows for which ``learn`` holds and the language is known."""
    spark = docs.sparkSession
    rows = docs.filter(learn & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"),
        F.pmod(F.xxhash64(F.col(key), F.col(lang)), F.lit(1 << 30)).alias("draw"),
    ).filter(F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().orderBy("lang").limit(max_classes + 1).collect()
    if len(sizes) > max_classes:
        raise ValueError(f"more than {max_classes} languages")
    languages = [row[0] for row in sizes]
    if not languages:
        return Model([], np.zeros(1 << bits), np.zeros(((1 << bits) + 1, 0)), 1.0)
    place = {name: n for n, name in enumerate(languages)}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs_seen = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for value in batch.column("text"):
                seen += gram_counts(value.as_py(), bits) > 0
                docs_seen += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(seen[at], docs_seen))], ["feature", "docs"]
        )

    counted = rows.select("text").mapInArrow(frequencies, "feature long, docs long")
    found = counted.groupBy("feature").agg(F.sum("docs").alias("docs")).toPandas()
    total = found.docs[found.feature == -1].sum()
    df = np.zeros(1 << bits)
    real = found[found.feature >= 0]
    df[real.feature] = real.docs
    idf = np.where(df > 0, np.log((1 + total) / (1 + df)) + 1, 0.0)

    share = F.create_map(
        *[x for row in sizes for x in (F.lit(row[0]), F.lit(min(1.0, per_class / row[1])))]
    )[F.col("lang")]
    drawn = F.col("draw") < share * 0.8 * (1 << 30)
    tested = (F.col("draw") >= share * 0.8 * (1 << 30)) & (F.col("draw") < share * (1 << 30))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = []
        for batch in batches:
            for value, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                at, weight = weighted(gram_counts(value, bits), idf)
                sample.append((np.append(at, 1 << bits), np.append(weight, 1.0), place[name]))
        if not sample:
            return
        ftrl = Ftrl((1 << bits) + 1, len(languages), alpha, beta, l1, l2)
        order = np.random.default_rng(0)
        for _ in range(epochs):
            for n in order.permutation(len(sample)):
                ftrl.learn(*sample[n])
        weights = ftrl.weights()
        at, kind = np.nonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(at, -1)), pa.array(np.append(kind, -1)),
                pa.array(np.append(weights[at, kind], 1.0)),
            ],
            ["feature", "kind", "weight"],
        )

    learned = (
        rows.filter(drawn).repartition(learners, "draw").sortWithinPartitions("draw", "text")
        .mapInArrow(descend, "feature long, kind long, weight double")
        .groupBy("feature", "kind").agg(F.sum("weight").alias("weight")).toPandas()
    )
    runs = max(1.0, learned.weight[learned.feature == -1].sum())
    weights = np.zeros(((1 << bits) + 1, len(languages)))
    real = learned[learned.feature >= 0]
    weights[real.feature, real.kind] = real.weight / runs
    model = spark.sparkContext.broadcast(Model(languages, idf, weights, 1.0))

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros(len(GRID))
        for batch in batches:
            for value, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                scaled = model.value.logits(value)[None, :].astype(float) / GRID[:, None]
                loss -= np.log(np.maximum(softmax(scaled)[:, place[name]], 1e-300))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(GRID))), pa.array(loss)], ["step", "loss"])

    tried = (
        rows.filter(tested).mapInArrow(losses, "step long, loss double")
        .groupBy("step").agg(F.sum("loss").alias("loss")).toPandas()
    )
    best = tried.sort_values(["loss", "step"]).step.iloc[0] if len(tried) and tried.loss.max() > 0 else None
    return Model(languages, idf, weights, 1.0 if best is None else float(GRID[best]))


def predict(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct (lang_pred, score) per row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return of(F.col(text))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op3_langid", "documents")
def op3(documents: DataFrame) -> DataFrame:
    model = train(documents, ~held_out())
    found = predict(documents, model)
    return documents.select("doc_id", held_out().alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score"
    )
