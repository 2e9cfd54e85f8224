"""Metadata payloads: splitting of record files, decoding, ingest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.ids import sha1_matches
from sightline.schemas import PARSED_PAYLOAD

MAX_DEPTH = 64
I64_MAX = 2**63 - 1
_HEADER = 24


class _Bad(ValueError):
    pass


def decode(data: bytes):
    """First bencoded value of a byte string: int, bytes, list or dict. Raises on bad input."""
    value, _ = _value(data, 0, 1)
    return value


def _digits(data: bytes, at: int, stop: bytes) -> tuple[int, int]:
    """(number, position behind its stop byte); at least one digit, at most a bigint."""
    end = data.find(stop, at)
    text = data[at:end] if end >= 0 else b""
    if not text.isdigit() or len(text.lstrip(b"0")) > 19 or int(text) > I64_MAX:
        raise _Bad(at)
    return int(text), end + 1


def _text(data: bytes, at: int) -> tuple[bytes, int]:
    size, start = _digits(data, at, b":")
    if start + size > len(data):
        raise _Bad(at)
    return data[start:start + size], start + size


def _value(data: bytes, at: int, depth: int):
    if depth > MAX_DEPTH:
        raise _Bad(at)
    mark = data[at:at + 1]
    if mark.isdigit():
        return _text(data, at)
    if mark == b"i":
        minus = data[at + 1:at + 2] == b"-"
        number, at = _digits(data, at + 1 + minus, b"e")
        return (-number if minus else number), at
    if mark not in (b"l", b"d"):
        raise _Bad(at)
    items, pairs, at = [], {}, at + 1
    while data[at:at + 1] != b"e":
        if mark == b"d":
            name, at = _text(data, at)
            pairs[name], at = _value(data, at, depth + 1)
        else:
            item, at = _value(data, at, depth + 1)
            items.append(item)
    return (pairs if mark == b"d" else items), at + 1


def describe(data: bytes | None) -> dict:
    """Fields of an info dictionary; all null when the bytes do not hold one."""
    empty = dict.fromkeys(PARSED_PAYLOAD.fieldNames())
    try:
        info = decode(data or b"")
    except _Bad:
        return empty
    if isinstance(info, dict) and isinstance(info.get(b"info"), dict):
        info = info[b"info"]
    if not isinstance(info, dict):
        return empty

    def typed(source: dict, name: bytes, kind: type):
        value = source.get(name)
        return value if isinstance(value, kind) else None

    name = typed(info, b"name", bytes)
    listed = typed(info, b"files", list)
    files, total, count = None, typed(info, b"length", int), 1
    if listed is not None:
        files = [
            {
                "length": max(typed(entry, b"length", int) or 0, 0),
                "path": [
                    part.decode("utf-8", "replace")
                    for part in typed(entry, b"path", list) or []
                    if isinstance(part, bytes)
                ],
            }
            for entry in listed
            if isinstance(entry, dict)
        ]
        count, total = len(files), min(sum(f["length"] for f in files), I64_MAX)
    return {
        "name": None if name is None else name.decode("utf-8", "replace"),
        "piece_length": typed(info, b"piece length", int),
        "total_size": total,
        "file_count": count,
        "files": files,
    }


def decode_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add the decoded fields to rows with a payload column."""

    @F.pandas_udf(PARSED_PAYLOAD)
    def run(payloads: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([describe(p) for p in payloads], columns=PARSED_PAYLOAD.fieldNames())
        for column in ("piece_length", "total_size", "file_count"):
            found[column] = found[column].astype("Int64")
        return found

    return df.withColumn("_info", run(F.col(payload))).select("*", "_info.*").drop("_info")


def split_records(data: bytes) -> list[tuple[bytes, bytes]]:
    """(id, payload) records of one file: a cut header ends it, a cut payload is an error."""
    out, at = [], 0
    while at + _HEADER <= len(data):
        size = int.from_bytes(data[at + 20:at + _HEADER], "big")
        start = at + _HEADER
        if start + size > len(data):
            raise ValueError(f"payload of {size} bytes is cut at byte {start}")
        out.append((data[at:at + 20], data[start:start + size]))
        at = start + size
    return out


def ingest(payloads: DataFrame, ts: str, key: str = "infohash", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(metadata rows, failed outcome rows) of fetched payloads.

    Only payloads whose SHA-1 is their id reach the decoder.
    """
    good = sha1_matches(F.col(key), F.col(payload))
    passed = decode_payloads(payloads.filter(good), payload)
    metadata = passed.select(
        key, "name", "piece_length", "total_size", F.col("file_count").cast("int").alias("file_count"),
        "files", F.lit(0).alias("fetch_attempts"), F.col(ts).alias("verified_at"),
    )
    failed = payloads.filter(~F.coalesce(good, F.lit(False))).select(
        key, F.lit("failed").alias("outcome"), F.lit("sha1_mismatch").alias("error"), F.col(ts).alias("ts")
    )
    return metadata, failed
