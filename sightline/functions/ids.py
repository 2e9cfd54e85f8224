"""Expressions over 20-byte ids and packed addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_BITS = 160
HEX_ID = "^[0-9a-f]{40}$"

# (first byte, byte count) of the three words an id is split into
_WORDS = [(1, 8), (9, 8), (17, 4)]


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def parse_hex_id(text: Column) -> Column:
    """Binary id of a 40-digit hex text in either case, else null."""
    low = F.lower(text)
    return F.when(low.rlike(HEX_ID), F.unhex(low))


def word(data: Column, first: int, size: int) -> Column:
    """Bytes of an id as a bigint (two's complement when the top bit is set)."""
    return F.conv(F.hex(F.substring(data, first, size)), 16, -10).cast("bigint")


def unsigned_order(value: Column) -> Column:
    """Flip the sign bit so that signed sorting of a 64-bit word follows unsigned order."""
    return value.bitwiseXOR(F.lit(-(2**63)).cast("bigint"))


def xor_distance(a: Column, b: Column) -> Column:
    """Struct of three words that sorts like the unsigned 160-bit XOR of two ids."""
    parts = [word(a, first, size).bitwiseXOR(word(b, first, size)) for first, size in _WORDS]
    return F.struct(
        unsigned_order(parts[0]).alias("d0"),
        unsigned_order(parts[1]).alias("d1"),
        parts[2].alias("d2"),
    )


def leading_zeros(a: Column, b: Column) -> Column:
    """Leading zero bits of the XOR of two ids; 160 when they are equal."""
    parts = [word(a, first, size).bitwiseXOR(word(b, first, size)) for first, size in _WORDS]

    def zeros(value: Column, bits: int) -> Column:
        return F.when(value == 0, F.lit(bits)).otherwise(F.lit(bits) - F.length(F.bin(value)))

    return (
        F.when(parts[0] != 0, zeros(parts[0], 64))
        .when(parts[1] != 0, F.lit(64) + zeros(parts[1], 64))
        .otherwise(F.lit(128) + zeros(parts[2], 32))
        .cast("int")
    )


def bucket_index(own: Column, other: Column) -> Column:
    """Routing bucket of an id as seen from the own id; equal ids share bucket 0."""
    zeros = leading_zeros(own, other)
    return F.when(zeros >= ID_BITS, F.lit(0)).otherwise(F.lit(ID_BITS - 1) - zeros)


def in_sample(data: Column, rate: float, always: Column | None = None) -> Column:
    """Keep ids whose first two bytes, read as a fraction, lie below the rate."""
    if rate <= 0:
        chosen = F.lit(False)
    elif rate >= 1:
        chosen = F.lit(True)
    else:
        chosen = word(data, 1, 2) / F.lit(65536.0) < F.lit(rate)
    return chosen if always is None else chosen | (data == always)


def sha1_matches(data: Column, payload: Column) -> Column:
    return F.unhex(F.sha1(payload)) == data


def is_public_ipv4(ip: Column) -> Column:
    """False for unspecified, loopback, private, link-local, broadcast, multicast and 100/8."""
    part = F.split(ip, r"\.")
    a, b, c, d = (part[i].cast("int") for i in range(4))
    blocked = (
        a.isin(10, 100, 127)
        | ((a == 0) & (b == 0) & (c == 0) & (d == 0))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
        | ((a == 255) & (b == 255) & (c == 255) & (d == 255))
        | a.between(224, 239)
    )
    return ~blocked


def ipv4_text(packed: Column, first: Column) -> Column:
    """Dotted text of the four bytes that start at a position."""
    return F.concat_ws(
        ".", *[F.conv(F.hex(F.substring(packed, first + i, F.lit(1))), 16, 10) for i in range(4)]
    )


def port_number(packed: Column, first: Column) -> Column:
    return F.conv(F.hex(F.substring(packed, first, F.lit(2))), 16, 10).cast("int")
