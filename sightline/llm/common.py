"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: The white space of the word and line rules: [\x20\x09-\x0D].
SPACE = " \t\n\v\f\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that do not clash with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name, n = base, 0
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def n_words(text: Column) -> Column:
    """Number of runs of non-space characters; null counts as none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_GAP))).cast("long")


def same(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of ``column`` in one have at most ``limit`` bytes, or it is one row."""
    for batch in batches:
        texts = batch.column(column)
        sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
        upto, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            done = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
