"""Record files: a 20-byte id, the payload's length in four bytes (big-endian), the payload, and again.

A record can only be found from the one before it, so a file is read in two passes. The first hops from
header to header without reading payloads (a task per file) and writes down where ranges of about
``range_bytes`` begin; ranges begin with a record. In the second, ranges are dealt over all tasks and
read in parallel, whatever the number and size of the files. A task holds a few megabytes, or one
payload.

A cut header at a file's end is passed over, a cut payload is an error. Files are opened by their
address, which the executors must reach.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from sightline.schemas import PAYLOADS
from sightline.session import store

HEADER = 24
#: Bytes of payloads after which a batch goes out, and how many are read at once.
BATCH_BYTES, READ_BYTES = 4 << 20, 1 << 20


class _Ahead:
    """A file read forward through one buffer; payloads may be hopped over."""

    def __init__(self, source, at: int, end: int):
        self.source, self.at, self.end, self.data, self.first = source, at, end, b"", at

    def take(self, size: int, most: int = READ_BYTES) -> bytes:
        inside = self.at - self.first
        if inside > len(self.data) or inside + size > len(self.data):
            want = min(max(size, most), self.end - self.at)
            self.data, self.first, inside = self.source.read_at(want, self.at), self.at, 0
        out = self.data[inside : inside + size]
        self.at += len(out)
        return out

    def header(self, most: int = READ_BYTES) -> tuple[bytes, int] | None:
        """(id, length) of the next record, None at the end; the payload must be whole."""
        if self.at + HEADER > self.end:
            return None
        raw = self.take(HEADER, most)
        size = int.from_bytes(raw[20:], "big")
        if self.at + size > self.end:
            raise ValueError(f"payload of {size} bytes is cut at byte {self.at}")
        return raw[:20], size


def _opened(address: str):
    store_, inner = fs.FileSystem.from_uri(address)
    return store_.open_input_file(inner)


def record_ranges(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """(file, start, end) of ranges that begin with a record and together hold all of them."""
    # the contents are not read here: only addresses and sizes are selected
    files = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file"), F.col("length").alias("size")
    )

    def hop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                edges = [0]
                with _opened(row["file"]) as source:
                    ahead = _Ahead(source, 0, row["size"])
                    # headers of large payloads are read alone, those of small ones many at a time
                    most = 4096
                    while (found := ahead.header(most)) is not None:
                        ahead.at += found[1]
                        most = 4096 if found[1] > 4096 else READ_BYTES
                        if ahead.at - edges[-1] >= range_bytes:
                            edges.append(ahead.at)
                    if ahead.at > edges[-1]:
                        edges.append(ahead.at)
                out = [(row["file"], a, b) for a, b in zip(edges, edges[1:])]
                columns = zip(*out) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
                    ["file", "start", "end"],
                )

    # a task per file: a file is one row, and a partition of its own
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(parts, "file").mapInArrow(hop, "file string, start bigint, end bigint")


def read_records(spark: SparkSession, path: str, range_bytes: int = 64 << 20, places: bool = False) -> DataFrame:
    """(infohash, payload) of one record file or a folder of them; with ``places`` also (file, at)."""
    ranges = store(record_ranges(spark, path, range_bytes), "record-ranges")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["file"]) as source:
                    ahead, out, held = _Ahead(source, row["start"], row["end"]), [], 0
                    while (at := ahead.at) < row["end"]:
                        key, size = ahead.header()
                        out.append((key, ahead.take(size), row["file"], at))
                        held += size
                        if held >= BATCH_BYTES or len(out) >= 4096:
                            yield batch_of(out)
                            out, held = [], 0
                    if out:
                        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.binary(), pa.string(), pa.int64())
        columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
        return pa.RecordBatch.from_arrays(columns, ["infohash", "payload", "file", "at"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = ranges.repartition(parts, "file", "start").mapInArrow(
        read, "infohash binary, payload binary, file string, at bigint"
    )
    return found if places else found.select("infohash", "payload")


@dataclass
class _Written(WriterCommitMessage):
    part: str
    rows: int


class _RecordWriter(DataSourceWriter):
    """Each task writes a hidden file; only a whole job's files get their names, and a repeated task's
    are left out."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, rows) -> _Written:
        store_, inner = fs.FileSystem.from_uri(self.path)
        store_.create_dir(inner, recursive=True)
        part, count = f"{uuid.uuid4().hex}.bin", 0
        with store_.open_output_stream(f"{inner}/.{part}") as out:
            for key, payload in rows:
                key, payload = bytes(key), bytes(payload)
                if len(key) != 20:
                    raise ValueError("ids of records have 20 bytes")
                out.write(key + len(payload).to_bytes(4, "big") + payload)
                count += 1
        return _Written(part, count)

    def commit(self, messages) -> None:
        store_, inner = fs.FileSystem.from_uri(self.path)
        for message in filter(None, messages):
            if message.rows:
                store_.move(f"{inner}/.{message.part}", f"{inner}/{message.part}")
            else:
                store_.delete_file(f"{inner}/.{message.part}")

    def abort(self, messages) -> None:
        store_, inner = fs.FileSystem.from_uri(self.path)
        for message in filter(None, messages):
            store_.delete_file(f"{inner}/.{message.part}")


class RecordFiles(DataSource):
    """``df.write.format("record_files").mode("append").save(path)`` for rows (infohash, payload)."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self):
        return PAYLOADS

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("record files are only appended")
        return _RecordWriter(self.options["path"])


def write_records(df: DataFrame, path: str) -> None:
    """Append rows (infohash, payload) as record files below ``path``, one per task that has rows."""
    df.sparkSession.dataSource.register(RecordFiles)
    df.select("infohash", "payload").write.format("record_files").mode("append").save(path)
