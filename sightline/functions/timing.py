"""Time arithmetic that treats TIMESTAMP and TIMESTAMP_NTZ columns alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(ts.cast("timestamp"))


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def time_chunk(ts: Column, seconds: int) -> Column:
    """Number of the fixed-width time slice a row falls into."""
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def seconds_between(earlier: Column, later: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def hours_between(earlier: Column, later: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(3_600_000_000.0)


def plus_seconds(ts: Column, seconds: Column | int) -> Column:
    """Shift a timestamp by whole seconds, keeping its type."""
    amount = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return ts + F.make_dt_interval(secs=amount.cast("decimal(18,6)"))


def truncate(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts.cast("timestamp"))
