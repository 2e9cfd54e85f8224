"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str, show: int = 3) -> str | None:
    """None when names and rows agree, else a short account of what differs."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    expected = rows_of(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == expected:
        return None
    return (
        f"{sum(got.values())} rows vs {sum(expected.values())}; "
        f"only here {list((got - expected).items())[:show]}; "
        f"only in SQL {list((expected - got).items())[:show]}"
    )
