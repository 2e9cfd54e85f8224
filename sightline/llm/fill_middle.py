"""Fill-in-middle transformation, with a learned rank index over the line ends.

A text is cut at two of its line ends, drawn by a hash of its id, into prefix, middle and suffix, which
are put in another order behind marks. Where the k-th line ends comes from an index over the offsets
of all boundaries of a block of texts: straight segments, each fitted by narrowing the slopes that
keep every offset within ``error`` bytes, predict the offset from the rank; the stored residual, one
byte, makes it exact. All cuts of a block are predicted at once.

Work runs in Arrow batches, without a shuffle; a task holds a block of about 8 MB, or one text if that
is longer. ``restored`` rebuilds the text from the output and its form in column expressions.

Defined results: null and empty texts, and texts that hold a mark, stay as they are (``plain``, null
lengths); a null id is drawn like an empty one; repeated rows are transformed alike; an empty table
gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sightline.llm.common import slices
from sightline.llm.registry import query

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Greatest distance in bytes between a prediction and its offset; residuals take one byte.
ERROR = 120


class RankIndex:
    """Rank to offset: error-bounded segments and one residual per offset."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        first, slope = self._segments(offsets.tolist(), error)
        self.first = np.array(first, np.int64)
        self.base, self.slope = offsets[self.first], np.array(slope, np.float64)
        left = offsets - self.predicted(np.arange(len(offsets)))
        self.residual = left.astype(np.int8 if error < 127 else np.int64)

    @staticmethod
    def _segments(offsets: list[int], error: int) -> tuple[list[int], list[float]]:
        """First ranks and slopes: a segment goes on while some slope keeps all its offsets near."""
        first, slope = [], []
        start, low, high = 0, 0.0, float("inf")
        for rank in range(1, len(offsets)):
            run, rise = rank - start, offsets[rank] - offsets[start]
            least, most = (rise - error) / run, (rise + error) / run
            if least > high or most < low:
                first.append(start)
                slope.append(low if high == float("inf") else (low + high) / 2)
                start, low, high = rank, 0.0, float("inf")
            else:
                low, high = max(low, least), min(high, most)
        if offsets:
            first.append(start)
            slope.append(low if high == float("inf") else (low + high) / 2)
        return first, slope

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.first, ranks, side="right") - 1
        return self.base[segment] + np.rint(self.slope[segment] * (ranks - self.first[segment])).astype(np.int64)

    def offset(self, ranks: np.ndarray) -> np.ndarray:
        return self.predicted(ranks) + self.residual[ranks]


def boundaries(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of all boundaries of texts that lie one after the other, and of each text its first
    rank and its number of lines. A text's boundaries are its start and the end of each line."""
    ends = np.cumsum(sizes)
    lines = np.flatnonzero(data == 10) + 1
    full = ends[sizes > 0]
    lines = np.concatenate([lines, full[data[full - 1] != 10]])  # a last line without a line end
    owner = np.concatenate([np.arange(len(sizes)), np.searchsorted(ends, lines, side="left")])
    offsets = np.concatenate([ends - sizes, lines])
    order = np.lexsort((offsets, owner))
    first = np.searchsorted(owner[order], np.arange(len(sizes)))
    return offsets[order], first, np.bincount(owner, minlength=len(sizes)) - 1


def code_points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


class Rearranger:
    def __init__(self, marks: tuple[str, str, str] = MARKS, rate: int = 100, spm: int = 50, error: int = ERROR):
        self.marks, self.rate, self.spm, self.error = [m.encode() for m in marks], rate, spm, error

    def __call__(self, texts: list[bytes], draws: np.ndarray) -> list[tuple]:
        """(n, form, prefix_chars, middle_chars, output) of each text; ``draws`` has four numbers a row."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets, first, n = boundaries(data, sizes)
        index = RankIndex(offsets, self.error)
        ranks = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
        starts = np.cumsum(sizes) - sizes
        cuts = index.offset(first[:, None] + ranks) - starts[:, None]
        mixes = (draws[:, 2] % 100 < self.rate) & (sizes > 0)
        backward = draws[:, 3] % 100 < self.spm
        return [
            self._one(*row) for row in zip(texts, n.tolist(), cuts.tolist(), mixes.tolist(), backward.tolist())
        ]

    def _one(self, text: bytes, n: int, cuts: list[int], mixes: bool, backward: bool) -> tuple:
        if not mixes or any(mark in text for mark in self.marks):
            return n, "plain", None, None, text
        head, tail, hole = self.marks
        prefix, middle, suffix = text[: cuts[0]], text[cuts[0] : cuts[1]], text[cuts[1] :]
        sizes = [code_points(np.frombuffer(part, np.uint8)) for part in (prefix, middle)]
        if backward:
            return n, "spm", *sizes, b"".join([tail, suffix, head, prefix, hole, middle])
        return n, "psm", *sizes, b"".join([head, prefix, tail, suffix, hole, middle])


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers from the first 32 digits of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7, rate: int = 100, spm: int = 50,
    marks: tuple[str, str, str] = MARKS, error: int = ERROR,
) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every text.

    ``rate`` percent of the texts are rearranged, ``spm`` percent of these with the suffix first.
    """
    kind = docs.schema[key].dataType.simpleString()
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rearrange = Rearranger(marks, rate, spm, error)
        for part in slices(batches, 1, 8 << 20):
            texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
            drawn = np.stack([part.column(k).to_numpy() for k in range(2, 6)], axis=1)
            out = [pa.array(c, t) for c, t in zip(zip(*rearrange(texts, drawn)), types)]
            out[-1] = out[-1].view(pa.string())
            names = ["key", "n", "form", "prefix_chars", "middle_chars", "output"]
            yield pa.RecordBatch.from_arrays([part.column(0), *out], names)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *draws(F.col(key), seed))
    return rows.mapInArrow(
        work, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    ).withColumnRenamed("key", key)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, rebuilt. No text holds a mark and no mark begins inside another, so each is found once."""
    head, tail, hole = marks

    def before(part: Column, mark: str) -> Column:
        return F.substring_index(part, mark, 1)

    def after(part: Column, mark: str) -> Column:
        return F.substring_index(part, mark, -1)

    middle = after(output, hole)
    psm = F.concat(after(before(output, tail), head), middle, before(after(output, tail), hole))
    spm = F.concat(before(after(output, head), hole), middle, after(before(output, head), tail))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


@query("op12_fill_middle", "documents", sql="""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
               FROM documents),
    u AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS l, ('0x' || h[1:8])::BIGINT AS h1,
                 ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
          FROM d),
    c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a,
                 greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                           OR h3 % 100 >= 100 THEN 'plain'
                      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS prefix,
                 coalesce(array_to_string(l[a + 1:b], ''), '') AS middle,
                 coalesce(array_to_string(l[b + 1:], ''), '') AS suffix FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t
                            WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p
""")
def op12(documents: DataFrame) -> DataFrame:
    return fill_in_middle(documents).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
