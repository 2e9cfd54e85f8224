"""Expressions over file lists: roll-ups, top directories, single-file fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

I64_MAX = 2**63 - 1


def rolled_up(files: Column, single_length: Column) -> tuple[Column, Column]:
    """(file count, total size): the list's entries, or one file of the single length.

    Negative lengths count as 0 and the sum stops at the largest bigint.
    """
    total = F.aggregate(
        files,
        F.lit(0).cast("decimal(38,0)"),
        lambda acc, f: (acc + F.greatest(F.coalesce(f["length"], F.lit(0)), F.lit(0)).cast("decimal(38,0)")).cast("decimal(38,0)"),
    )
    capped = F.least(total, F.lit(I64_MAX).cast("decimal(38,0)")).cast("bigint")
    count = F.when(files.isNull(), F.lit(1)).otherwise(F.size(files)).cast("bigint")
    return count, F.when(files.isNull(), single_length).otherwise(capped)


def top_dirs(files: Column) -> Column:
    """Distinct first path segments, sorted; null without a file list."""
    named = F.filter(files, lambda f: f["path"].isNotNull())
    found = F.array_sort(F.array_distinct(F.transform(named, lambda f: F.get(f["path"], F.lit(0)))))
    return F.when(F.size(named) > 0, found)


def shown_files(files: Column, name: Column, total_size: Column, file_count: Column) -> Column:
    """The list, or one made-up file when there is none but exactly one file, else empty."""
    label = F.when(name.isNull() | (name == ""), F.lit("(unnamed)")).otherwise(name)
    entry = F.array(F.struct(total_size.alias("length"), F.array(label).alias("path")))
    kind = "array<struct<length:bigint,path:array<string>>>"
    empty = F.array().cast(kind)
    return (
        F.when(files.isNotNull() & (F.size(files) > 0), files)
        .when(file_count == 1, entry.cast(kind))
        .otherwise(empty)
    )
