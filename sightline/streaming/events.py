"""Event-time operators on streams: dedupe, counts, replies, throttle, suppression.

All take a stream with a TIMESTAMP event time and set the watermark themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline.operators.requests import TIMEOUT, walk
from sightline.operators.throttle import Bucket

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedupe(stream: DataFrame, key: str, ts: str, within: str = "10 minutes") -> DataFrame:
    """Let an id through once per stretch of event time; state is dropped with the watermark."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, name: str, ts: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events per name and tumbling window, final once the watermark passed it."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, width).alias("w"), F.col(name).alias("metric_name"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("ts"), "metric_name", "n")
    )


class _InOrder(StatefulProcessor):
    """Walks the events of a key in the order of (time, tie), whatever order they come in.

    Events wait in a list until the watermark has passed them; one value is kept between them. So
    results do not depend on how the input was cut into micro-batches. Rows whose last field is null
    only move the watermark. The input has key and event time ahead of the ``fields``; the list holds
    up to ``TOGETHER`` events per entry, as each entry is sent and stored by itself.
    """

    TOGETHER = 1024

    def __init__(self, fields: T.StructType, state: T.StructType):
        self.fields, self.state = fields, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.state)
        packed = T.StructType()
        for f in self.fields:
            packed = packed.add(f.name, T.ArrayType(f.dataType))
        self.waiting = handle.getListState("waiting", packed)

    def _packed(self, events: list[tuple]) -> list[tuple]:
        return [
            tuple(map(list, zip(*events[at : at + self.TOGETHER]))) for at in range(0, len(events), self.TOGETHER)
        ]

    def walk(self, key, kept: tuple | None, ready: list[tuple], passed: int) -> tuple[list[Row], tuple | None, int | None]:
        """(rows to give out, what is kept, when to look again at the latest) after the ready events."""
        raise NotImplementedError

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows, timerValues):
        new = [e for e in (tuple(r)[2:] for r in rows) if e[-1] is not None]
        if new:
            self.waiting.appendList(self._packed(new))
            self._wake(min(e[0] for e in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [e for entry in self.waiting.get() for e in zip(*entry)] if self.waiting.exists() else []
        events = sorted(waiting, key=lambda e: e[:2])
        ready = [e for e in events if e[0] <= passed]
        later = events[len(ready):]
        before = tuple(self.kept.get()) if self.kept.exists() else None
        out, after, again = self.walk(key[0], before, ready, passed)
        if ready and later:
            self.waiting.put(self._packed(later))
        elif ready:
            self.waiting.clear()
        if later:
            self._wake(later[0][0])
        if after is None:
            self.kept.clear()
        else:
            self.kept.update(after)
        if again is not None:
            self._wake(again)
        return iter(out)

    def close(self) -> None:
        pass


class _Correlation(_InOrder):
    """Keeps the open request of a transaction id."""

    def __init__(self, timeout_us: int, tie: T.DataType):
        super().__init__(
            T.StructType().add("us", "long").add("tie", tie).add("asks", "boolean"),
            T.StructType().add("sent", "long").add("tie", tie),
        )
        self.timeout_us = timeout_us

    def walk(self, key, kept, ready, passed):
        out, steps = [], walk(kept, ready, self.timeout_us)
        while True:
            try:
                outcome, sent, tie, reply = next(steps)
            except StopIteration as end:
                kept = end.value
                break
            out.append(Row(key=key, sent=sent, tie=tie, outcome=outcome, reply=reply))
        if kept is not None and kept[0] + self.timeout_us <= passed:
            out.append(Row(key=key, sent=kept[0], tie=kept[1], outcome=TIMEOUT, reply=None))
            kept = None
        return out, kept, None if kept is None else kept[0] + self.timeout_us


AVERAGED = Row("key", "us", "tie", "x", "ema")


class _Average(_InOrder):
    """Keeps the moving average of a key."""

    def __init__(self, rate: float, tie: T.DataType):
        super().__init__(
            T.StructType().add("us", "long").add("tie", tie).add("x", "double"), T.StructType().add("ema", "double")
        )
        self.rate = rate

    def walk(self, key, kept, ready, passed):
        out, ema = [], kept[0] if kept else None
        for us, tie, x in ready:
            ema = x if ema is None else (1 - self.rate) * ema + self.rate * x
            out.append(AVERAGED(key, us, tie, x, ema))
        return out, None if ema is None else (ema,), None


def moving_average(
    log: DataFrame, key: str, ts: str, value: str, rate: float, *, tie: str, late: str = "30 seconds", output: str = "ema",
) -> DataFrame:
    """(key, ts, tie, value, ema) of each event, once the watermark has passed it: what
    ``operators.reputation.moving_average`` gives. State is one number a key; rows without a value only
    move the watermark. Sets the state store that has timers for the session."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kinds = [log.schema[c].dataType for c in (key, tie)]
    rows = log.withWatermark(ts, late).select(
        F.col(key).alias("key"), F.col(ts), F.unix_micros(ts).alias("us"), F.col(tie).alias("tie"), F.col(value).cast("double").alias("x")
    )
    made = rows.groupBy("key").transformWithState(
        _Average(rate, kinds[1]),
        T.StructType().add("key", kinds[0]).add("us", "long").add("tie", kinds[1]).add("x", "double").add("ema", "double"),
        outputMode="Append", timeMode="EventTime",
    )
    return made.select(
        F.col("key").alias(key), F.timestamp_micros("us").alias(ts), F.col("tie").alias(tie), F.col("x").alias(value),
        F.col("ema").alias(output),
    )


def correlate(
    log: DataFrame, key: str, ts: str, asks: str, tie: str, timeout_seconds: float, late: str = "30 seconds",
) -> DataFrame:
    """Outcome of each request: answered, timeout, or refused while another of its id is open.

    ``log`` holds requests and replies, told apart by the boolean column ``asks``; rows in which that is
    null only move the watermark. The rule is that of :mod:`sightline.operators.requests`, the result that
    of the batch operator. Needs the state store that has timers, which is set here for the session.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kinds = [log.schema[c].dataType for c in (key, tie)]
    rows = log.withWatermark(ts, late).select(
        F.col(key).alias("key"), F.col(ts), F.unix_micros(ts).alias("us"), F.col(tie).alias("tie"), F.col(asks).alias("asks")
    )
    made = rows.groupBy("key").transformWithState(
        _Correlation(int(timeout_seconds * 1_000_000), kinds[1]),
        T.StructType().add("key", kinds[0]).add("sent", "long").add("tie", kinds[1])
        .add("outcome", "string").add("reply", "long"),
        outputMode="Append", timeMode="EventTime",
    )
    return made.select(
        F.col("key").alias(key), F.timestamp_micros("sent").alias(ts), F.col("tie").alias(tie), "outcome",
        F.timestamp_micros("reply").alias("reply_ts"),
    )


def _with_types(stream: DataFrame, added: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields) + ", " + added


def expire(state: GroupState, at_us: int) -> None:
    """Drop the state once the watermark passes a time."""
    state.setTimeoutTimestamp(max(at_us // 1000, state.getCurrentWatermarkMs()) + 1)


def rate_limit(
    stream: DataFrame, key: str, ts: str, rate: float = 8.0, burst: float = 64.0,
    idle_seconds: float = 600.0, late: str = "1 minute",
) -> DataFrame:
    """Add ``allowed`` by a token bucket per key; state is two numbers and expires when idle."""
    stream = stream.withWatermark(ts, late)
    bucket = Bucket.of(rate, burst, idle_seconds)

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        units, last = state.get if state.exists else (bucket.full, None)
        rows = pd.concat(list(parts)).sort_values(ts, kind="stable")
        allowed = []
        for now in rows[ts].astype("datetime64[us]").astype("int64"):
            last = int(now) if last is None else last
            ok, units = bucket.take(bucket.refilled(units, max(0, int(now) - last)))
            last = max(int(now), last)
            allowed.append(ok)
        state.update((units, last))
        expire(state, last + bucket.idle_us)
        yield rows.assign(allowed=allowed)

    return stream.groupBy(key).applyInPandasWithState(
        run, _with_types(stream, "allowed boolean"), "units bigint, last bigint", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def suppress_bad(
    stream: DataFrame, addr: str, ts: str, is_mark: str, ttl_seconds: float = 600.0,
    late: str = "1 minute",
) -> DataFrame:
    """Checks that do not follow a bad mark of their address within the time to live.

    ``stream`` holds marks and checks, told apart by the boolean column ``is_mark``; the state
    of an address is the time of its latest mark.
    """
    stream = stream.withWatermark(ts, late)
    ttl_us = int(ttl_seconds * 1e6)

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        marked = state.get[0] if state.exists else None
        rows = pd.concat(list(parts))
        rows = rows.sort_values([ts, is_mark], ascending=[True, False], kind="stable")
        keep = []
        for now, mark in zip(rows[ts].astype("datetime64[us]").astype("int64"), rows[is_mark]):
            if mark:
                marked = now
            keep.append(not mark and (marked is None or now - marked >= ttl_us))
        if marked is not None:
            state.update((int(marked),))
            expire(state, marked + ttl_us)
        yield rows[keep]

    return stream.groupBy(addr).applyInPandasWithState(
        run, _with_types(stream, "")[:-2], "marked bigint", "append",
        GroupStateTimeout.EventTimeTimeout,
    )
