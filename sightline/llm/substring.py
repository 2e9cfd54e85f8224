"""Substring dedup: suffix automata decide which windows of ``length`` words occur twice.

Every window of a text has an anchor: the least hash of its word grams (leftmost on ties). Runs of
windows with one anchor form a region; every window lies in exactly one region, and equal windows
have equal anchors, so all occurrences of a window lie in regions of one anchor. Regions whose anchor
occurs once in the corpus are done. Equal regions are folded into one with a weight. For each anchor
with different regions, a suffix automaton of its regions counts occurrences; the regions are streamed
past it for their matching statistics, and a window counted twice or more is marked. An anchor of more
than ``SHARD`` regions is not gathered: the windows of its different regions are counted by a 128-bit
hash in a plain aggregation, so a task holds at most ``SHARD`` regions of at most 62 words. Marked
spans go back to the documents, which lose every covered word.

The automata are not sent to all tasks: with the corpus as its own reference that would stream every
document past every shard; the anchor decides which shards a region can match at all.

Very common grams (a bounded table, found on a sample) are the last choice as anchors, so that the
anchor of a window at the edge of a common passage is one of its own words' grams and groups stay
small. The table changes speed alone: any order of grams gives the same windows.

Words are compared by 64-bit hashes, windows of large anchors by two of them. Defined results: null and empty texts have no words; texts
shorter than a window lose none; repeated rows are documents of their own (their windows repeat);
rows that agree in id and text get the same answer; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightline.llm.common import same
from sightline.llm.registry import query
from sightline.llm.words import PRIME, gram_hashes, mixed, word_hashes, words_of
from sightline.session import store

LENGTH, GRAM = 35, 8
SHARD = 4096
COMMON, COMMON_DOCS, SAMPLE_DOCS = 200_000, 4, 5_000
INVERSE = np.uint64(pow(int(PRIME), -1, 1 << 64))


class SuffixAutomaton:
    """Of several sequences, with the weighted number of occurrences of every state's strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.count = [-1], [0], [0]

    def _state(self, size: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(link)
        self.count.append(0)
        return len(self.size) - 1

    def _split(self, state: int, word: int, old: int) -> int:
        """A copy of ``old`` for the strings that ``state`` extends by ``word``."""
        copy = self._state(self.size[state] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = copy
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extended(self, last: int, word: int) -> int:
        there = self.next[last].get(word)
        if there is not None:
            return there if self.size[there] == self.size[last] + 1 else self._split(last, word, there)
        new, state = self._state(self.size[last] + 1, {}, 0), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            there = self.next[state][word]
            fits = self.size[there] == self.size[state] + 1
            self.link[new] = there if fits else self._split(state, word, there)
        return new

    def add(self, words: list[int], weight: int) -> None:
        last = 0
        for word in words:
            last = self._extended(last, word)
            self.count[last] += weight

    def finish(self) -> None:
        """Carry the counts from longer strings to their suffixes."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def occurrences(self, words: list[int], length: int) -> np.ndarray:
        """Per window of ``length`` words: how often it occurs here."""
        out = np.zeros(max(0, len(words) - length + 1), np.int64)
        state, matched = 0, 0
        for at, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.size[state]
            there = self.next[state].get(word)
            if there is None:
                continue
            state, matched = there, matched + 1
            if matched >= length:
                while self.size[self.link[state]] >= length:
                    state = self.link[state]
                matched = length
                out[at - length + 1] = self.count[state]
        return out


def anchors(keys: np.ndarray, span: int) -> np.ndarray:
    """Per run of ``span`` keys: the place of its least one, leftmost on ties."""
    best, width = np.arange(len(keys)), 1
    while 2 * width <= span:
        left, right = best[:-width], best[width:]
        best = np.where(keys[left] <= keys[right], left, right)
        width *= 2
    count = len(keys) - span + 1
    left, right = best[:count], best[span - width : span - width + count]
    return np.where(keys[left] <= keys[right], left, right)


def regions(hashes: np.ndarray, common: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, words, anchor, content) of a text's regions."""
    if len(hashes) < length:
        return (np.zeros(0, np.int64),) * 4
    grams = gram_hashes(hashes, GRAM)
    keys = mixed(grams, 8) >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        keys |= (common[at] == grams).astype(np.uint64) << np.uint64(63)
    chosen = anchors(keys, length - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    words = np.diff(np.append(first, len(chosen))) + length - 1
    power = np.full(len(hashes), PRIME)
    power[0] = 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * np.multiply.accumulate(power), dtype=np.uint64)])
    undo = np.full(len(hashes), INVERSE)
    undo[0] = 1
    undo = np.multiply.accumulate(undo)
    content = mixed((sums[first + words] - sums[first]) * undo[first] + words.astype(np.uint64), 9)
    return first, words, grams[chosen[first]].view(np.int64), content.view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def hashes_of(text: str | None) -> np.ndarray:
    return word_hashes(words_of(text))


def common_grams(docs: DataFrame) -> np.ndarray:
    """Grams found in several documents of a sample; sorted."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    picked = docs.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [np.unique(gram_hashes(hashes_of(t), GRAM)) for t in part.column("text").to_pylist()]
            found, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["gram", "n"])

    counted = picked.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= COMMON_DOCS).orderBy(F.col("n").desc(), "gram").limit(COMMON)
    return np.sort(top.select("gram").toPandas()["gram"].to_numpy(np.int64).view(np.uint64))


def region_table(docs: DataFrame, length: int) -> DataFrame:
    """(id, mark, start, words, anchor, content): all regions of all documents."""
    known = docs.sparkSession.sparkContext.broadcast(common_grams(docs))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [regions(hashes_of(t), known.value, length) for t in part.column("text").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            columns = [np.concatenate([f[k] for f in found]) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(row), part.column("mark").take(row),
                    pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
                    pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()),
                ],
                ["id", "mark", "start", "words", "anchor", "content"],
            )

    return docs.mapInArrow(
        find, "id long, mark long, start int, words int, anchor long, content long"
    )


def region_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, content, weight, hashes): the words of one region of each content."""
    lists = wanted.groupBy(F.col("rep.id").alias("i"), F.col("rep.mark").alias("m")).agg(
        F.collect_list(F.struct(F.col("rep.start").alias("start"), "words", "anchor", "content", "weight")).alias("found")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            out: list[tuple] = []
            for text, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist()):
                hashes = hashes_of(text)
                for f in found:
                    own = hashes[f["start"] : f["start"] + f["words"]].tobytes()
                    out.append((f["anchor"], f["content"], f["weight"], own))
            columns = list(zip(*out)) if out else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor", "content", "weight", "hashes"]
            )

    return (
        docs.join(lists, same(docs.id, F.col("i")) & same(docs.mark, F.col("m"))).select("text", "found")
        .mapInArrow(cut, "anchor long, content long, weight long, hashes binary")
        .dropDuplicates(["anchor", "content"])
    )


def spans_of(marked: np.ndarray, length: int) -> list[dict]:
    """Maximal runs of words covered by marked windows."""
    if not marked.any():
        return []
    starts = np.flatnonzero(marked)
    cut = np.flatnonzero(np.diff(starts) > length)
    firsts, lasts = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]
    return [{"from": int(a), "upto": int(b) + length} for a, b in zip(firsts, lasts)]


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, content, spans): the words of each region covered by repeated windows."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def closed() -> pa.RecordBatch:
            sequences = [np.frombuffer(r["hashes"], np.uint64).tolist() for r in rows]
            automaton = SuffixAutomaton()
            for row, words in zip(rows, sequences):
                automaton.add(words, row["weight"])
            automaton.finish()
            spans = []
            for row, words in zip(rows, sequences):
                if row["weight"] < 2:
                    repeats = automaton.occurrences(words, length) >= 2
                else:  # all windows repeat
                    repeats = np.ones(max(0, len(words) - length + 1), bool)
                spans.append(spans_of(repeats, length))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r["anchor"] for r in rows], pa.int64()),
                    pa.array([r["content"] for r in rows], pa.int64()),
                    pa.array(spans, SPANS),
                ],
                ["anchor", "content", "spans"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                if row["anchor"] != group and rows:
                    yield closed()
                    rows = []
                group = row["anchor"]
                rows.append(row)
        if rows:
            yield closed()

    return texts.repartition("anchor").sortWithinPartitions("anchor", "content").mapInArrow(
        decide, "anchor long, content long, spans array<struct<from:int,upto:int>>"
    )


def window_spans(texts: DataFrame, length: int) -> DataFrame:
    """What ``repeated_spans`` returns, without gathering an anchor's regions."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            row, place, low, high = [], [], [], []
            for at, own in enumerate(part.column("hashes").to_pylist()):
                words = np.frombuffer(own, np.uint64)
                low.append(gram_hashes(words, length))
                high.append(gram_hashes(mixed(words, 11), length))
                row.append(np.full(len(low[-1]), at))
                place.append(np.arange(len(low[-1])))
            rows = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("anchor").take(rows), part.column("content").take(rows),
                    part.column("weight").take(rows), pa.array(np.concatenate(place), pa.int32()),
                    pa.array(np.concatenate(low).view(np.int64)), pa.array(np.concatenate(high).view(np.int64)),
                ],
                ["anchor", "content", "weight", "place", "low", "high"],
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            spans = []
            for places in part.column("places").to_pylist():
                marked = np.zeros(max(places) + 1, bool)
                marked[places] = True
                spans.append(spans_of(marked, length))
            yield pa.RecordBatch.from_arrays(
                [part.column("anchor"), part.column("content"), pa.array(spans, SPANS)],
                ["anchor", "content", "spans"],
            )

    windows = store(
        texts.mapInArrow(cut, "anchor long, content long, weight long, place int, low long, high long"), "windows"
    )
    twice = windows.groupBy("low", "high").agg(F.sum("weight").alias("n")).filter("n > 1").drop("n")
    return windows.join(twice, ["low", "high"]).groupBy("anchor", "content").agg(
        F.collect_list("place").alias("places")
    ).mapInArrow(join, "anchor long, content long, spans array<struct<from:int,upto:int>>")


SPANS = pa.list_(pa.struct([("from", pa.int32()), ("upto", pa.int32())]))


def drop_repeats(
    docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH
) -> DataFrame:
    """(id, n_words, n_removed, kept) per row of ``docs``: kept words joined by one space."""
    docs = docs.select(
        F.col(key).alias("id"), F.col(text).alias("text"), F.crc32(F.col(text).cast("binary")).alias("mark")
    )
    found = store(region_table(docs, length), "regions")
    repeated = store(
        found.groupBy("anchor").agg(
            F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high")
        ).filter("n > 1").select(
            "anchor", (F.col("low") != F.col("high")).alias("several"), (F.col("n") > SHARD).alias("large")
        ),
        "anchors",
    )
    candidates = store(found.join(repeated, "anchor"), "candidates")
    wanted = candidates.filter("several").groupBy("anchor", "content", "large").agg(
        F.count("*").alias("weight"), F.first("words").alias("words"),
        F.min(F.struct("id", "mark", "start")).alias("rep"),
    )
    decided = repeated_spans(region_words(docs, wanted.filter("not large")), length)
    if not repeated.filter("several and large").isEmpty():
        decided = decided.union(window_spans(region_words(docs, wanted.filter("large")), length))
    decided = store(decided, "decided").filter(F.size("spans") > 0)
    spans = candidates.filter("several").join(decided, ["anchor", "content"]).select(
        "id", "mark", F.explode(
            F.transform("spans", lambda s: F.struct(
                (F.col("start") + s["from"]).alias("from"), (F.col("start") + s["upto"]).alias("upto")
            ))
        ).alias("span"),
    ).union(
        candidates.filter("not several").select(
            "id", "mark", F.struct(F.col("start").alias("from"), (F.col("start") + F.col("words")).alias("upto"))
        )
    )
    gone = spans.groupBy(F.col("id").alias("i"), F.col("mark").alias("m")).agg(
        F.collect_set("span").alias("spans")
    )

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            total, lost, kept = [], [], []
            for value, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                words = words_of(value)
                total.append(len(words))
                if spans:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [s["from"] for s in spans], 1)
                    np.add.at(change, [s["upto"] for s in spans], -1)
                    stay = np.cumsum(change[:-1]) == 0
                    words = [words[n] for n in np.flatnonzero(stay)]
                lost.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())],
                ["id", "n_words", "n_removed", "kept"],
            )

    return docs.join(gone, same(docs.id, F.col("i")) & same(docs.mark, F.col("m")), "left").select(
        "id", "text", "spans"
    ).mapInArrow(rebuild, "id long, n_words long, n_removed long, kept string")


@query("op8_substring", "documents", sql=r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT r, unnest(range(1, greatest(len(w) - 33, 1)::BIGINT)) AS i, w FROM d),
    h AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM s),
    t AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
    m AS (SELECT DISTINCT r, i FROM h JOIN t USING (h)),
    g AS (SELECT DISTINCT r, i + unnest(range(0, 35)) AS p FROM m),
    u AS (SELECT r, doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d),
    k AS (SELECT u.*, g.p IS NOT NULL AS gone FROM u LEFT JOIN g ON u.r = g.r AND u.p = g.p),
    a AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE gone) AS x,
                 string_agg(v, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY r)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(x, 0)::BIGINT AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN a USING (r)
""")
def op8(documents: DataFrame) -> DataFrame:
    return drop_repeats(documents).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
