"""Vector expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def once(x: Column, expression: Callable[[Column], Column]) -> Column:
    """``expression`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(x), expression)[0]


def unit(a: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays as it is."""

    def scaled(v: Column) -> Column:
        return once(norm(v), lambda n: F.when(n == 0, v.cast("array<double>")).otherwise(
            F.transform(v, lambda x: x.cast("double") / n)
        ))

    return once(a, scaled)


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """Quotient, or 0 when the divisor is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom)


def nearest_units(x: Column, digits: int, half_up: bool = False) -> Column:
    """How many units of the last of ``digits`` decimals are nearest to a value of 0 or more.

    Decided on the exact binary value; a tie goes to the even number, or up. The distance past
    the half is exact: the value is cut into two parts of at most 26 bits, whose products with
    the scale need no rounding.
    """
    double_scale = F.lit(2 * 10.0**digits)
    below = F.floor(x * F.lit(10.0**digits))
    wide = x * F.lit(2.0**27 + 1)
    high = wide - (wide - x)
    past_half = (high * double_scale - (2 * below + 1)) + (x - high) * double_scale
    at_half = F.lit(1).cast("bigint") if half_up else F.pmod(below, F.lit(2))
    return below + F.when(past_half > 0, 1).when(past_half == 0, at_half).otherwise(0)


def rounded(x: Column, digits: int = 4) -> Column:
    """Round the exact binary value, ties to the even digit."""
    scale = 10.0**digits

    def nearest(v: Column) -> Column:
        # larger values have no decimals that could be rounded away
        near = F.signum(v) * nearest_units(F.abs(v), digits) / F.lit(scale)
        return F.when(F.abs(v) < 2.0**51 / scale, near).otherwise(v)

    return once(x.cast("double"), nearest)


def top_scored(names: list[str], scores: Column, k: int, digits: int = 4) -> Column:
    """The k best (category, confidence) pairs of a score array, best first."""
    labels = F.array(*[F.lit(n) for n in names])
    pairs = F.zip_with(
        scores, labels, lambda s, n: F.struct(s.cast("double").alias("s"), n.alias("n"))
    )
    best = F.slice(F.sort_array(pairs, asc=False), 1, k)
    return F.transform(
        best,
        lambda p: F.struct(p["n"].alias("category"), rounded(p["s"], digits).alias("confidence")),
    )
