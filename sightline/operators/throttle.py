"""Token-bucket throttle over a hit log."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.timing import micros, time_chunk
from sightline.operators.scans import DEFAULT_SLICE_SECONDS
from sightline.session import store


@dataclass(frozen=True)
class Bucket:
    """A bucket in whole units: one token is ``token`` units and a microsecond adds ``gain``."""

    token: int
    gain: int
    full: int
    idle_us: int

    @classmethod
    def of(cls, rate: float | Fraction, burst: float, idle_seconds: float) -> Bucket:
        """``rate`` as a whole-number fraction: as given, or the simplest one equal to a float's precision."""
        share, limit = Fraction(rate), 100_000
        if isinstance(rate, float):
            exact, share = share, share.limit_denominator(limit)
            while abs(share - exact) * 10**12 > exact:
                limit *= 10
                share = exact.limit_denominator(limit)
        token = share.denominator * 1_000_000
        full = int(burst * token)
        if max(full, token) >= 1 << 62:
            raise ValueError(f"rate {rate} and burst {burst} do not fit into a long")
        return cls(token, share.numerator, full, int(idle_seconds * 1e6))

    def refilled(self, units: int, gap_us: int) -> int:
        """Units after a pause; a long idle bucket is replaced by a full one."""
        if gap_us > self.idle_us:
            return self.full
        return min(self.full, units + gap_us * self.gain)

    def take(self, units: int) -> tuple[bool, int]:
        return (True, units - self.token) if units >= self.token else (False, units)


def _slice_facts(bucket: Bucket, times: Iterator[int]) -> tuple:
    """What one slice says without knowing its start.

    ``full_end``: units left when it starts with a full bucket. ``exact_end``: units left
    whatever it started with, known if even an empty start fills up on the way. ``drained_us``:
    last hit at which even a full start has run dry, and the hits after it.
    """
    first = last = None
    full_x = high = bucket.full
    low, exact, drained, after, n = 0, None, None, 0, 0
    for now in times:
        gap = 0 if last is None else now - last
        full_x = bucket.take(bucket.refilled(full_x, gap))[1]
        if exact is not None:
            exact = bucket.take(bucket.refilled(exact, gap))[1]
        # low and high bound the units from below: a refused hit counts as leaving nothing
        risen = bucket.refilled(low, gap)
        if risen >= bucket.full:
            exact = bucket.full - bucket.token
        low = max(0, risen - bucket.token)
        high = max(0, bucket.refilled(high, gap) - bucket.token)
        n, after = n + 1, after + 1
        if high == 0:
            drained, after = now, 0
        first, last = now if first is None else first, now
    return first, last, n, full_x, exact, drained, after


def _tuples(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _guessed_starts(facts: DataFrame, key: str, bucket: Bucket) -> DataFrame:
    """Start of each slice: (key, _slice, _units, _since), null units for a full bucket.

    A drained bucket holds what refilled since it was last known exactly, less whole tokens,
    so only the remainder by one token is left; from there every hit takes a token.
    """
    along = Window.partitionBy(key).orderBy("_slice")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gain = F.lit(bucket.gain).cast("decimal(38,0)")
    token = F.lit(bucket.token).cast("decimal(38,0)")

    def later(units: Column, since: Column, now: Column, hits: Column) -> Column:
        return units + gain * (now - since) - token * hits

    pause = F.col("first") - F.lag("last").over(along)
    fresh = pause.isNull() | (pause > bucket.idle_us) | (gain * pause >= bucket.full)
    known = facts.withColumn("_fresh", fresh).withColumn(
        "_known", F.coalesce(F.col("exact_end"), F.when(F.col("_fresh"), F.col("full_end")))
    ).withColumn("_hits", F.sum("n").over(upto))
    anchored = known.withColumn(
        "_k", F.last(F.when(F.col("_known").isNotNull(), F.struct("_known", "last")), True).over(upto)
    )
    at_dry = F.pmod(
        later(F.col("_k._known"), F.col("_k.last"), F.col("drained_us"), F.lit(0)), token
    )
    settled = anchored.withColumn(
        "_settled",
        F.coalesce(F.col("_known").cast("decimal(38,0)"),
                   later(at_dry, F.col("drained_us"), F.col("last"), F.col("after"))),
    ).withColumn(
        "_s",
        F.last(F.when(F.col("_settled").isNotNull(), F.struct("_settled", "last", "_hits")), True).over(upto),
    )
    end = later(F.col("_s._settled"), F.col("_s.last"), F.col("last"), F.col("_hits") - F.col("_s._hits"))
    bounded = F.greatest(F.lit(0), F.least(end, F.lit(bucket.full))).cast("bigint")
    ended = settled.withColumn("_end", bounded)
    return ended.select(
        key, "_slice",
        F.when(~F.col("_fresh"), F.lag("_end").over(along)).alias("_units"),
        F.when(~F.col("_fresh"), F.lag("last").over(along)).alias("_since"),
    )


def rate_limit(
    hits: DataFrame, key: str, ts: str, rate: float = 8.0, burst: float = 64.0, *,
    tie: str, idle_seconds: float = 600.0, slice_seconds: int | None = None,
) -> DataFrame:
    """Add ``allowed`` to each hit, per key in time order, exactly.

    A key's hits are cut into time slices that run in parallel. What a slice starts with is
    first worked out from a summary of each slice: a bucket that filled up, or that ran dry,
    forgets its past but for a remainder. Then all slices run, and any slice that did not start
    with what the one before ended with is run again, so the result never rests on the guess.
    Units are whole numbers, so this comparison is exact. These rounds read the key and the time
    of hits and write one row per slice; the hits themselves are passed through once, at the end,
    as Arrow columns. No task reads more than a slice of a key as a stream, and keys hold no rows
    in memory. A slice is many refill times long, so that most slices tell where they end without
    knowing where they start. Hits without a key share one bucket.
    """
    bucket = Bucket.of(rate, burst, idle_seconds)
    slice_seconds = slice_seconds or max(DEFAULT_SLICE_SECONDS, int(16 * burst / rate))
    rows = hits.withColumn("_us", micros(F.col(ts))).withColumn(
        "_slice", time_chunk(F.col(ts), slice_seconds)
    )
    on = [key, "_slice"]
    kind = hits.schema[key].dataType.simpleString()
    long, columns = pa.int64(), hits.columns
    names = ["first", "last", "n", "full_end", "exact_end", "drained_us", "after"]
    ends = ["_units", "_since", "_end", "_final"]

    def longs(added: list[str]) -> str:
        return f"`{key}` {kind}, _slice bigint, " + ", ".join(f"{n} bigint" for n in added)

    def matched(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """Join on (key, slice), null keys included."""
        named = right.withColumnsRenamed({key: "_who", "_slice": "_no"})
        both = F.col(key).eqNullSafe(F.col("_who")) & (F.col("_slice") == F.col("_no"))
        return left.join(named, both, how).drop("_who", "_no")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out = [], []

        def hits_in_order() -> Iterator[tuple]:
            for batch in batches:
                kinds[:] = [batch.schema.field(key).type] + [long] * (1 + len(names))
                yield from _tuples(batch, key, "_slice", "_us")

        for group, found in groupby(hits_in_order(), key=lambda r: r[:2]):
            out.append((*group, *_slice_facts(bucket, (r[2] for r in found))))
            if len(out) == 10_000:
                yield _batch(out, [*on, *names], kinds)
                out = []
        if out:
            yield _batch(out, [*on, *names], kinds)

    facts = (
        rows.select(*on, "_us").repartition(*on).sortWithinPartitions(*on, "_us")
        .mapInArrow(summarise, longs(names))
    )
    starts = _guessed_starts(store(facts, "throttle"), key, bucket)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Each batch of sorted hits with their outcome and the units they leave."""
        group, units, last = None, 0, None
        for batch in batches:
            allowed, left = [], []
            for who, number, now, begin, since in _tuples(batch, *on, "_us", "_units", "_since"):
                if (who, number) != group:
                    group = (who, number)
                    units, last = (bucket.full, now) if begin is None else (begin, since)
                ok, units = bucket.take(bucket.refilled(units, now - last))
                last = now
                allowed.append(ok)
                left.append(units)
            yield batch, allowed, left

    def last_of_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kinds = None, []
        for batch, _, left in replay(batches):
            kinds = [batch.schema.field(key).type] + [long] * (1 + len(ends))
            out = []
            for (*start, now), units in zip(_tuples(batch, *on, "_units", "_since", "_us"), left):
                if held and held[:2] != tuple(start[:2]):
                    out.append(held)
                held = (*start, units, now)
            yield _batch(out, [*on, *ends], kinds)
        if held:
            yield _batch([held], [*on, *ends], kinds)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, allowed, _ in replay(batches):
            given = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*given, pa.array(allowed, pa.bool_())], names=[*columns, "allowed"]
            )

    def ends_of(some: DataFrame) -> DataFrame:
        return (
            matched(rows.select(*on, "_us"), some, "inner").repartition(*on)
            .sortWithinPartitions(*on, "_us").mapInArrow(last_of_slices, longs(ends))
        )

    state = store(ends_of(starts), "throttle")
    along = Window.partitionBy(key).orderBy("_slice")
    while True:
        wrong = store(
            state.select(
                *on, "_units", F.lag("_end").over(along).alias("_true"), F.lag("_final").over(along).alias("_at")
            )
            .filter(F.col("_units").isNotNull() & (F.col("_units") != F.col("_true")))
            .select(*on, F.col("_true").alias("_units"), F.col("_at").alias("_since")),
            "throttle",
        )
        if wrong.isEmpty():
            break
        right = matched(state, wrong.select(*on), "left_anti")
        state = store(right.unionByName(ends_of(wrong)), "throttle")
    schema = T.StructType([*hits.schema.fields, T.StructField("allowed", T.BooleanType())])
    return (
        matched(rows, state.select(*on, "_units", "_since"), "inner").repartition(*on)
        .sortWithinPartitions(*on, "_us", tie).mapInArrow(decide, schema)
    )
