"""Exact SentencePiece encoding of merge-type models by backtracking, and decoding.

A merge-type model joins, again and again, the two neighbours whose joined piece scores best (the
leftmost of equals). A row of pieces is that result exactly if each piece merges to itself and each
two neighbours, merged anew, come out as the same two pieces. So no merge is
replayed over a text: from left to right the longest piece that starts here is tried, then its
shorter prefixes, until one is compatible with the piece before it; when none is, the position is
marked in a bitfield as failed, the last piece is taken back and its shorter prefixes follow. A failed
position is never entered again, which keeps the work linear. Longest pieces come from one
Aho-Corasick sweep. Whether two pieces are compatible is found by merging anew along their seam: a
part at the end of the left one and a part at the start of the right one would join, if that merge
comes before the merges that take these parts up within their pieces. The answer is remembered.

Texts are cut where no piece of the vocabulary reaches across (before a run of space marks, and around
line ends); the ids of a cut are remembered, too. Both memories are bounded. Work runs in Arrow batches, without a shuffle; a task
holds a part of a batch and one text.

Defined results: null and empty texts have no ids and decode to the empty text; characters outside the
vocabulary become byte pieces; repeated rows are encoded each; an empty table gives an empty table;
other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightline.llm.common import slices
from sightline.llm.registry import query

#: Fixed value: the mark that stands for a space in pieces.
MARK = "▁"
#: A run of marks with what follows it.
CUTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Characters of a line that are cut at a time, and where a longer one is parted: a space on its own.
STRETCH = 1 << 20
SEAM = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")


class Remembered(dict):
    """A cache of two generations: when the newer holds ``limit`` entries it becomes the older."""

    def __init__(self, make: Callable, limit: int):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        out = self.older.pop(key, None)
        if out is None:
            out = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


def merged(text: str, score: dict[str, float], down_to: int = 1) -> list[str]:
    """What merging makes of a short text: the best-scored pair first, the leftmost of equals.

    It stops at ``down_to`` parts.
    """
    parts = list(text)
    while len(parts) > down_to:
        found = [
            (-score[pair], at) for at, pair in enumerate(map("".join, zip(parts, parts[1:])))
            if pair in score
        ]
        if not found:
            break
        at = min(found)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class PieceCodec:
    """Texts to ids, and back, by a SentencePiece model file of the merge type with byte pieces."""

    _open: dict[str, PieceCodec] = {}

    def __init__(self, path: str, remember: int = 150_000):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" a  b ") != f"{MARK}{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("only models that keep white space and put a mark in front are known")
        every = range(model.get_piece_size())
        byte = [n for n in every if model.is_byte(n)]
        if len(byte) != 256 or any(model.is_unused(n) for n in every):
            raise ValueError("only models with all byte pieces and no unused ones are known")
        self.bytes = [model.piece_to_id(f"<0x{n:02X}>") for n in range(256)]
        self.piece = {
            n: model.id_to_piece(n) for n in every
            if not (model.is_byte(n) or model.is_control(n) or model.is_unknown(n))
        }
        self.score = {p: model.get_score(n) for n, p in self.piece.items()}
        # a piece that its own characters do not merge to never comes out
        self.id = {p: n for n, p in self.piece.items() if merged(p, self.score) == [p]}
        letters = set("".join(self.piece.values()))
        if not letters <= self.id.keys():
            raise ValueError("every character of a piece must be a piece")
        self.size, self.shorter = [0] * len(every), [-1] * len(every)
        for p, n in self.id.items():
            self.size[n] = len(p)
            self.shorter[n] = next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), -1)
        self.halves = {p: merged(p, self.score, 2) if len(p) > 1 else [] for p in self.id}
        # pieces all of whose merges score less than the merges inside them
        self.falling = {
            n for p, n in self.id.items()
            if all(len(half) == 1 or self.score[half] > self.score[p] for half in self.halves[p])
        }
        self.falling = {n for n in self.falling if self._falls(self.piece[n])}
        self.sweep = ahocorasick.Automaton()
        for p, n in self.id.items():
            self.sweep.add_word(p, n)
        self.sweep.make_automaton()
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.piece.values())
        self.seams: dict[tuple[int, int], list[tuple[str, float, float]]] = {}
        self.goes = Remembered(self._goes, 2 * remember)
        self.bare = Remembered(self._cut_ids, remember)
        self.marked = Remembered(lambda word: self._cut_ids(MARK + word), remember)
        self.line_end = self._cut_ids("\n")

    def _falls(self, p: str) -> bool:
        return self.id[p] in self.falling and all(map(self._falls, self.halves[p]))

    @classmethod
    def of(cls, path: str) -> PieceCodec:
        """One per Python worker."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _seam(self, n: int, side: int) -> list[tuple[str, float, float]]:
        """The parts of a piece at its start (side 0) or end (1), each with the scores of the merges
        that make it and take it up."""
        if (n, side) not in self.seams:
            part, taken, out = self.piece[n], -math.inf, []
            while part:
                halves = self.halves[part]
                made = self.score[part] if halves else math.inf
                out.append((part, made, taken))
                part, taken = (halves[-side] if halves else None), made
            self.seams[n, side] = out
        return self.seams[n, side]

    def _goes(self, pair: tuple[int, int]) -> bool:
        """Do two neighbours stay apart?"""
        if not (pair[0] in self.falling and pair[1] in self.falling):
            both = [self.piece[n] for n in pair]
            return merged("".join(both), self.score) == both
        score = self.score
        for left, left_made, left_taken in self._seam(pair[0], 1):
            for right, right_made, right_taken in self._seam(pair[1], 0):
                if left + right in score:
                    when = min(score[left + right], left_made, right_made)
                    # of equal merges the leftmost comes first
                    if when > left_taken and when >= right_taken:
                        return False
        return True

    def _cut_ids(self, cut: str) -> bytes:
        size, longest = self.size, [-1] * len(cut)
        for end, n in self.sweep.iter(cut):
            longest[end - size[n] + 1] = n  # ends ascend: the longest comes last
        if -1 not in longest:
            return array("i", self._backtrack(longest, 0, len(cut))).tobytes()
        ids, start = [], 0
        for at, n in enumerate(longest):
            if n < 0:  # a character outside the vocabulary merges with nothing
                ids += self._backtrack(longest, start, at)
                ids += [self.bytes[b] for b in cut[at].encode("utf-8", "surrogatepass")]
                start = at + 1
        return array("i", ids + self._backtrack(longest, start, len(cut))).tobytes()

    def _backtrack(self, longest: list[int], start: int, stop: int) -> list[int]:
        size, shorter, goes = self.size, self.shorter, self.goes
        out, at, last, failed = [], start, -1, None
        while at < stop:
            tried = longest[at]
            while True:
                if tried >= 0:
                    end = at + size[tried]
                    if (last < 0 or goes[last, tried]) and (
                        failed is None or not failed[(end - start) >> 3] >> ((end - start) & 7) & 1
                    ):
                        break
                else:  # nothing fits here: take the last piece back and go on with its prefixes
                    if failed is None:
                        failed = bytearray((stop - start) // 8 + 1)
                    failed[(at - start) >> 3] |= 1 << ((at - start) & 7)
                    tried = out.pop()
                    at -= size[tried]
                    last = out[-1] if out else -1
                tried = shorter[tried]
            out.append(tried)
            at, last = end, tried
        return out

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if not self.cuts:
            return np.frombuffer(self._cut_ids(MARK + text.replace(" ", MARK)), np.int32)
        lines = text.split("\n")
        found = self._line(lines[0], True)
        for line in lines[1:]:
            found.append(self.line_end)
            if line:
                found += self._line(line, False)
        return np.frombuffer(b"".join(found), np.int32)

    def _line(self, line: str, marked: bool) -> list[bytes]:
        """Ids of a line, with a mark in front or not."""
        if len(line) > STRETCH:
            seam = SEAM.search(line, STRETCH)
            if seam:
                return [
                    b"".join(self._line(line[: seam.start()], marked)),
                    *self._line(line[seam.end():], True),
                ]
        if "  " in line or MARK in line or (marked and line[0:1] == " "):
            whole = MARK * marked + line.replace(" ", MARK)
            return [self.bare[cut] for cut in CUTS.findall(whole)]
        words = line.split(" ")
        if marked:
            return list(map(self.marked.__getitem__, words))
        head = [self.bare[words[0]]] if words[0] else []
        return head + list(map(self.marked.__getitem__, words[1:]))

    def text(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist()) if len(ids) else ""


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(
    docs: DataFrame, text: str = "text", key: str = "doc_id", model: str | None = None, decode: bool = False
) -> DataFrame:
    """(key, ids) of every whole text; with ``decode``, also what the ids decode to."""
    model = model or model_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.of(model)
        for part in slices(batches, 1):
            ids = [codec.ids(value) for value in part.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32())
            out = [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
            if decode:
                out.append(pa.array(map(codec.text, ids), pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["key", "ids", "decoded"][: len(out)])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        work, f"key {kind}, ids array<int>" + (", decoded string" if decode else "")
    ).withColumnRenamed("key", key)


def decode(rows: DataFrame, ids: str = "ids", key: str = "doc_id", model: str | None = None) -> DataFrame:
    """(key, decoded) of rows of ids; null ids decode to the empty text."""
    model = model or model_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.of(model)
        for batch in batches:
            texts = [codec.text(np.array(v or [], np.int32)) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "decoded"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(
        work, f"key {kind}, decoded string"
    ).withColumnRenamed("key", key)


@query("op11_sentence_pieces", "documents")
def op11(documents: DataFrame) -> DataFrame:
    return encode(documents, decode=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
