"""Vector bin packing of token pieces into sequences.

A piece has a demand vector: tokens, segments (1) and loss-bearing tokens. A sequence has a limit in
each. One sequence is filled at a time: of the pieces in a bounded pool that still fit, the one with
the greatest weighted dot product of its demand and the room left is placed (weights: one over the
mean demand of the pool); when nothing fits the sequence is closed and the pool refilled.

Pieces are dealt by hash of their id into groups of about ``group_rows``, packed one group after the
other in each task, from a stream: a task holds one pool, however large a group is.

Documents become ids by a public tokenizer, plus an end id, cut every ``limit`` ids. Texts
of ASCII and Latin-1 letters are split by the tokenizer's own rule, the new pieces of a block of texts are
encoded in one call, and the ids of each piece are kept in a bounded cache; of other texts, words of other characters go to the tokenizer as they are (it
drops white space and never merges across it).

Defined results: null and empty texts are the end id alone; a piece over a limit by itself gets a
sequence of its own; repeated rows are packed each; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightline.llm.common import fresh, slices
from sightline.llm.registry import query
from sightline.session import store

LIMIT = 4096
END_ID = 2
SEGMENTS = 128
#: Pieces in a generation of a worker's cache.
KNOWN = 120_000

#: The split rule of the tokenizer, restricted to ASCII and Latin-1 letters.
SAFE = re.compile(r"[\t-\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r\x20]+")


class Encoder:
    """Texts to ids (as little-endian unsigned 32-bit bytes) by a tokenizers file.

    Texts of a block are cut first; the pieces that are new are then encoded in one call. Known pieces
    are kept in two generations: when the newer one is full it becomes the older.
    """

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str, limit: int = KNOWN):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        words = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(words.values()) + 1, bool)
        self.word_end[[n for word, n in words.items() if word.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, limit: int = KNOWN) -> Encoder:
        """One per Python worker, with the limit of the task at work."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        cls._open[path].limit = limit
        return cls._open[path]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        cut = [self._pieces(text or "") for text in texts]
        self._learn(set(chain.from_iterable(cut)))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]

    def _pieces(self, text: str) -> list[str]:
        if SAFE.fullmatch(text) and "<|" not in text:
            return PIECES.findall(text.lower())
        out = []
        for raw in text.encode().split():
            word = raw.decode()
            safe = SAFE.fullmatch(word) and "<|" not in word
            # a line end marks what goes to the tokenizer as it is: no piece holds one
            out += PIECES.findall(word.lower()) if safe else ["\n" + word]
        return out

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        new = []
        for piece in pieces.difference(self.known):
            ids = self.older.get(piece)
            if ids is None:
                new.append(piece)
            else:
                self.known[piece] = ids
        raw = [piece for piece in new if piece[0] == "\n"]
        if raw:
            found = self.tokenizer.encode_batch_fast([p[1:] for p in raw], add_special_tokens=False)
            self.known.update((p, array("I", e.ids).tobytes()) for p, e in zip(raw, found))
            new = [piece for piece in new if piece[0] != "\n"]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            self.known.update(zip(part, self._encoded(part)))

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of one word each, encoded as one text: the last token of every word says so."""
        ids = np.array(self.tokenizer.encode(" ".join(pieces), add_special_tokens=False).ids, "<u4")
        ends = (4 * np.flatnonzero(self.word_end[ids]) + 4).tolist()
        if len(ends) != len(pieces):
            found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
            return [array("I", e.ids).tobytes() for e in found]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(
    docs: DataFrame, text: str = "text", key: str = "doc_id", limit: int = LIMIT,
    end_id: int = END_ID, tokenizer: str | None = None, known: int = KNOWN,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the ids of every text cut at ``limit``."""
    tokenizer = tokenizer or tokenizer_path()
    names = [field.split()[0] for field in PIECE.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer, known), np.array([end_id], "<u4").tobytes()
        for part in slices(batches, 1, 4 << 20):
            out: list[tuple] = []
            for doc, ids in zip(part.column(0).to_pylist(), encoder.ids(part.column(1).to_pylist())):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, limit):
                    own = ids[4 * start : 4 * (start + limit)]
                    out.append((doc, start, len(own) // 4, zlib.crc32(own), total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names
            )

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECE)


class Packer:
    """Fills one sequence at a time from a pool of pieces."""

    def __init__(self, limits: np.ndarray, pool: int):
        self.limits, self.pool = limits.astype(float), pool
        self.demand, self.tag = np.zeros((0, len(limits))), np.zeros(0, np.int64)
        self.number = 0

    def add(self, demand: np.ndarray, tag: np.ndarray, last: bool) -> Iterator[tuple[int, list[int]]]:
        """Take pieces in; (sequence, tags in order) of every sequence that can be closed."""
        self.demand, self.tag = np.vstack([self.demand, demand]), np.concatenate([self.tag, tag])
        while len(self.tag) > (0 if last else self.pool):
            yield self.number, self._fill()
            self.number += 1

    def _fill(self) -> list[int]:
        near = min(len(self.tag), self.pool)
        need = self.demand[:near] / self.limits
        weight = 1 / np.maximum(need.mean(axis=0), 1e-12)
        room, free, out = np.ones(need.shape[1]), np.ones(near, bool), []
        while True:
            fits = free & (need <= room + 1e-9).all(axis=1)
            if not fits.any():
                if not out:  # over a limit by itself
                    out, free[0] = [0], False
                break
            score = np.where(fits, need @ (weight * room), -1.0)
            best = int(score.argmax())
            out.append(best)
            free[best] = False
            room = room - need[best]
        tags = self.tag[out].tolist()
        keep = np.concatenate([free, np.ones(len(self.tag) - near, bool)])
        self.demand, self.tag = self.demand[keep], self.tag[keep]
        return tags


def pack(
    pieces: DataFrame, tokens: str = "length", loss: str | None = None,
    limits: tuple[int, int, int] = (LIMIT, SEGMENTS, LIMIT), group_rows: int = 16_384, pool: int = 1024,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (tokens ahead of the piece in its sequence).

    ``loss`` names the column of loss-bearing tokens; without it every token bears loss.
    """
    rows = store(pieces, "pieces")
    columns = rows.columns
    (group_name,) = fresh(rows, "_group")
    groups = max(1, rows.count() // group_rows)
    keyed = rows.withColumn(group_name, F.pmod(F.xxhash64(*columns), F.lit(groups)).cast("long"))
    at_tokens, at_loss = columns.index(tokens), columns.index(loss or tokens)
    caps = np.array(limits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, group, held = None, None, {}

        def closed(found) -> Iterator[pa.RecordBatch]:
            taken, numbers, offsets = [], [], []
            for number, tags in found:
                offset = 0
                for tag in tags:
                    row = held.pop(tag)
                    taken.append(row)
                    numbers.append((group << 32) + number)
                    offsets.append(offset)
                    offset += row[tokens] or 0
                if len(taken) >= 4096:
                    yield out_batch(taken, numbers, offsets)
                    taken, numbers, offsets = [], [], []
            if taken:
                yield out_batch(taken, numbers, offsets)

        def out_batch(taken, numbers, offsets):
            batch = pa.RecordBatch.from_pylist(taken, schema=kind)
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())],
                [*kind.names, "sequence_id", "offset"],
            )

        kind, tag = None, 0
        for batch in batches:
            kind = kind or pa.schema([f for f in batch.schema if f.name != group_name])
            numbers = batch.column(batch.num_columns - 1).to_numpy()
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(numbers)]):
                if numbers[start] != group:
                    if packer is not None:
                        yield from closed(packer.add(np.zeros((0, 3)), np.zeros(0, np.int64), True))
                    packer, group = Packer(caps, pool), int(numbers[start])
                part = batch.slice(start, end - start).select(kind.names)
                want = [
                    np.nan_to_num(part.column(at).to_numpy(zero_copy_only=False).astype(float))
                    for at in (at_tokens, at_loss)
                ]
                demand = np.stack([want[0], np.ones(len(want[0])), want[1]], axis=1)
                tags = np.arange(tag, tag + len(demand))
                held.update(zip(tags.tolist(), part.to_pylist()))
                tag += len(demand)
                yield from closed(packer.add(demand, tags, False))
        if packer is not None:
            yield from closed(packer.add(np.zeros((0, 3)), np.zeros(0, np.int64), True))

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return keyed.repartition(int(groups), group_name).sortWithinPartitions(group_name, *columns).mapInArrow(
        place, f"{out}, sequence_id long, offset long"
    )


def packed_documents(docs: DataFrame, known: int = KNOWN) -> DataFrame:
    return pack(token_pieces(docs, known=known))


@query("op2_packing", "documents")
def op2(documents: DataFrame) -> DataFrame:
    return packed_documents(documents)
