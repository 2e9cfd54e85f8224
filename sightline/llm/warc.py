"""WARC archives: one gzip member per record, and a splittable reader.

Writing: of records with equal payloads of at least ``min_bytes`` the one with the largest id is a
``response``, the others ``revisit`` records that name it. Archives are written by Spark's text
writer, whose line separator is a zero byte: a member ends with its length as four little-endian
bytes, so the last byte of every member below 16 MiB is zero and is left to the writer; a larger
member is followed by an empty one.

Reading: files are cut into byte ranges. A task scans its range for the gzip magic, takes a place
for a member only if what is there inflates to a WARC header, owns every record that starts inside
the range and reads on past the end to finish the last one. Memory: one range and one record.
Files are reached through ``pyarrow.fs``, so archives may lie in any store it knows; the rows to
write may come from any store Spark knows.

Defined results: null payload is empty; a null id gives a record without id, never a revisit's
target if another row has one; equal payloads whose largest id is repeated are responses in each of
these rows; payloads below ``min_bytes`` are always responses; bytes that are no record are skipped;
an empty table writes no record and reads none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.llm.registry import query
from sightline.session import store, work_path

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" + "0300" + "00000000" * 2)
RANGE = 8 << 20
DATE = "2024-01-01T00:00:00Z"

RECORD = (
    "file string, offset long, record_type string, record_id string, target_uri string, "
    "payload_digest string, refers_to string, payload_length long, payload binary"
)


def member(record: bytes) -> bytes:
    """One gzip member (and an empty one where needed), without its last byte, which is zero."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = squeeze.compress(record) + squeeze.flush()
    return (out if out[-1] == 0 else out + EMPTY_MEMBER)[:-1]


def record_bytes(
    kind: str, record_id: str | None, uri: str | None, digest: str, refers_to: str | None,
    payload: bytes,
) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Date", DATE),
        ("WARC-Record-ID", record_id and f"<urn:record:{record_id}>"),
        ("WARC-Target-URI", uri and " ".join(uri.split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload))),
        ("WARC-Refers-To", refers_to and f"<urn:record:{refers_to}>"),
        ("WARC-Profile", kind == "revisit" and "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def write_warc(
    pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html",
    min_bytes: int = 1000,
) -> None:
    """Write one record per row below ``path``."""
    rows = pages.select(
        F.col(key).alias("id"), F.col(uri).cast("string").alias("uri"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    groups = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(
        F.max("id").alias("first_id"), F.count("*").alias("copies")
    )
    # written first: its true size then decides how it is joined
    copied = store(
        groups.filter((F.col("copies") > 1) & F.col("first_id").isNotNull()).drop("copies"),
        "copied-payloads",
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    decided = rows.join(copied, "digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.col("id").cast("string").alias("id"), "uri", "digest",
        F.when(revisit, F.col("first_id")).cast("string").alias("refers_to"), "payload",
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("kind", "id", "uri", "digest", "refers_to", "payload")]
            for at in range(0, batch.num_rows, 64):
                part = [c.slice(at, 64).to_pylist() for c in columns]
                out = [member(record_bytes(*row)) for row in zip(*part)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    decided.mapInArrow(members, "value binary").select(
        F.col("value").cast("string").alias("value")
    ).write.option("lineSep", "\0").text(path)


def parsed(record: bytes) -> dict | None:
    """Header fields and payload of an inflated record; None if it is none."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit() or int(fields["content-length"]) > len(rest):
        return None
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith(
        "application/http"
    ) else block
    return {"fields": fields, "payload": payload}


class Window:
    """A file seen through a buffer that starts at a range's start and grows when asked."""

    def __init__(self, source, start: int, size: int):
        self.source, self.start, self.size, self.data = source, start, size, b""

    def upto(self, length: int) -> bytes:
        """At least ``length`` bytes of the buffer, or all up to the file's end."""
        want = min(max(length, len(self.data)), self.size - self.start)
        while len(self.data) < want:
            more = self.source.read_at(max(want - len(self.data), 1 << 20), self.start + len(self.data))
            if not more:
                break
            self.data += more
        return self.data


def inflated(window: Window, at: int) -> tuple[bytes, int] | None:
    """The member at ``at`` and where it ends; None if no whole WARC record starts there."""
    data = window.upto(at + 4096)
    probe = zlib.decompressobj(31)
    try:
        head = probe.decompress(data[at : at + 4096], 64)
        if not (head.startswith(b"WARC/1.") or (probe.eof and not head)):
            return None
        whole, out, end = zlib.decompressobj(31), [], at
        while not whole.eof:
            data = window.upto(end + 65536)
            piece = data[end : end + 65536]
            if not piece:
                return None
            out.append(whole.decompress(piece))
            end += len(piece)
        return b"".join(out), end - len(whole.unused_data)
    except zlib.error:
        return None


def records_in(source, size: int, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(offset, record) of every record that starts in [start, end)."""
    window, at = Window(source, start, size), 0
    while True:
        data = window.upto(end - start + len(MAGIC))
        at = data.find(MAGIC, at)
        if at < 0 or at >= end - start:
            return
        found = inflated(window, at)
        record = parsed(found[0]) if found else None
        if record:
            yield start + at, record
        at = found[1] if found and (record or not found[0]) else at + 1


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """All records of the archives below ``path``, one row each (schema ``RECORD``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.col("path").alias("file"), F.col("length").alias("size")
    )
    ranges = files.filter(F.col("size") > 0).select(
        "*", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / range_bytes))).alias("n")
    ).select("file", "size", (F.col("n") * range_bytes).alias("start"))
    # one task per few ranges: dealt by their names, not by the files' order
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store_, inner = fs.FileSystem.from_uri(row["file"])
                end = min(row["size"], row["start"] + range_bytes)
                with store_.open_input_file(inner) as source:
                    rows: list[dict] = []
                    held = 0
                    for offset, found in records_in(source, row["size"], row["start"], end):
                        f, payload = found["fields"], found["payload"]
                        rows.append({
                            "file": row["file"], "offset": offset, "record_type": f.get("warc-type"),
                            "record_id": f.get("warc-record-id"), "target_uri": f.get("warc-target-uri"),
                            "payload_digest": f.get("warc-payload-digest"),
                            "refers_to": f.get("warc-refers-to"),
                            "payload_length": int(f["warc-payload-length"]) if "warc-payload-length" in f else None,
                            "payload": payload if f.get("warc-type") == "response" else None,
                        })
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 512:
                            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return ranges.repartition(parts, "file", "start").mapInArrow(scan, RECORD)


ARROW = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()),
    ("record_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()),
    ("refers_to", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary()),
])


def id_of(column: str):
    return F.regexp_extract(column, "^<urn:record:(.*)>$", 1)


@query("op4_warc", "pages", sql="""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
    SELECT page_id, n AS payload_bytes, h AS payload_digest,
           CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
    FROM m
""")
def op4(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write_warc(pages, path)
    response = F.col("record_type") == "response"
    return read_warc(spark, path).select(
        F.nullif(id_of("record_id"), F.lit("")).cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long")
        .alias("payload_bytes"),
        F.when(response, F.sha1("payload"))
        .otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        F.nullif(id_of("refers_to"), F.lit("")).cast("long").alias("refers_to"),
    )
