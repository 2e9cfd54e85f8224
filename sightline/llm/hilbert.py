"""Hilbert-curve sharding.

Each metadata dimension is quantised to ``2^bits`` steps by its own distribution: a value's step is
the share of rows below it, so a value that holds a third of all rows takes a third of the axis.
Rows are ordered by the Hilbert index of their cell, then by id, and the order is cut into runs of
equal rows (or bytes). Rows of one shard are then close in all dimensions at once, and the
minimum and maximum per shard (:func:`shard_bounds`) let a reader skip shards.

The order is computed by range partitions: any one cell or value may hold any share of the rows.

Defined results: null is a value, below all others; rows that tie in cell and id are ordered by
size and checksum, and full ties are interchangeable; null text has size 1 and a null checksum; an
empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.llm.common import same
from sightline.llm.registry import query
from sightline.session import store


def ranked(df: DataFrame, order: list[str], amount: str, label: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``amount`` over all rows ordered before this one.

    Rows are range-partitioned and written; only one sum per partition is combined.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = store(
        df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), label
    )
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.sum(amount).alias("total")).select(
        "part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("part_start")
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("inside", F.sum(amount).over(inside) - F.col(amount))
        .join(starts, "part")
        .withColumn("before", F.col("part_start") + F.col("inside"))
        .drop("part", "inside", "part_start")
    )


def curve_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of ``axes`` (Skilling's transform)."""
    x = axes.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        q = np.int64(1) << bit
        for axis in x:
            on = (axis & q) != 0
            swap = np.where(on, 0, (x[0] ^ axis) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= ((x[-1] >> bit) & 1) * ((np.int64(1) << bit) - 1)
    x ^= flip
    out = np.zeros_like(flip)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            out = (out << 1) | ((axis >> bit) & 1)
    return out


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """The index of a cell along the Hilbert curve through a ``2^bits`` grid."""

    @F.pandas_udf("long")
    def index(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(curve_index(cells.to_numpy(), bits))

    return index(F.struct(*[a.cast("long").alias(f"x{n}") for n, a in enumerate(axes)]))


def with_cells(rows: DataFrame, dimensions: list[str], bits: int) -> DataFrame:
    """``rows`` with ``cell``, the Hilbert index of the quantised dimensions."""
    total = max(1, rows.count())
    names = []
    for n, dim in enumerate(dimensions):
        counts = rows.groupBy(F.col(dim).alias("value")).agg(F.count("*").alias("n"))
        steps = ranked(counts, ["value"], "n", f"axis-{n}").select(
            F.col("value").alias(f"value_{n}"),
            F.floor(F.col("before") * (1 << bits) / total).alias(f"axis_{n}"),
        )
        rows = rows.join(steps, same(F.col(dim), F.col(f"value_{n}"))).drop(f"value_{n}")
        names.append(f"axis_{n}")
    return rows.withColumn("cell", hilbert_index([F.col(c) for c in names], bits)).drop(*names)


def hilbert_shards(
    docs: DataFrame, dimensions: list[str], shards: int, law: str = "rows", bits: int = 8,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """(id, size, text_crc32, the dimensions as d0.., cell, shard, slot).

    ``law`` is ``rows`` (shards differ by one row at most) or ``bytes`` (a row belongs to the shard
    in which its first byte falls).
    """
    narrow = store(
        docs.select(
            F.col(key).alias("id"),
            (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
            *[F.col(d).alias(f"d{n}") for n, d in enumerate(dimensions)],
        ),
        "shard-rows",
    )
    order = ["cell", "id", "size", "text_crc32"]
    cells = with_cells(narrow, [f"d{n}" for n in range(len(dimensions))], bits)
    amount = F.lit(1).cast("long") if law == "rows" else F.col("size")
    placed = store(ranked(cells.withColumn("amount", amount), order, "amount", "order"), "ordered")
    total = placed.agg(F.sum("amount")).first()[0] or 1
    cut = placed.withColumn("shard", F.floor(F.col("before") * shards / total).cast("int"))
    if law == "rows":
        first = F.floor((F.col("shard") * F.lit(total) + shards - 1) / shards)
        return cut.withColumn("slot", F.col("before") - first).drop("amount", "before")
    ordered = ranked(cut.withColumn("one", F.lit(1).cast("long")), order, "one", "slots")
    firsts = ordered.groupBy("shard").agg(F.min("before").alias("rank0"))
    return ordered.join(firsts, "shard").withColumn("slot", F.col("before") - F.col("rank0")).drop(
        "amount", "before", "one", "rank0"
    )


def shard_bounds(assigned: DataFrame) -> DataFrame:
    """Per shard: rows and the least and largest value of each dimension, for pruning."""
    dims = [c for c in assigned.columns if c[0] == "d" and c[1:].isdigit()]
    bounds = [f(d).alias(f"{d}_{n}") for d in dims for n, f in (("min", F.min), ("max", F.max))]
    return assigned.groupBy("shard").agg(F.count("*").alias("rows"), *bounds)


def prune(bounds: DataFrame, **wanted) -> DataFrame:
    """The shards that can hold rows with the wanted value in each named dimension."""
    tests = [F.lit(v).between(F.col(f"{d}_min"), F.col(f"{d}_max")) for d, v in wanted.items()]
    return bounds.filter(reduce(lambda a, b: a & b, tests, F.lit(True))).select("shard")


@query("op1_hilbert_shards", "documents")
def op1(documents: DataFrame) -> DataFrame:
    out = hilbert_shards(documents, ["lang", "source", "n_chars"], 16, "rows")
    return out.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
