"""Name search, list pages, detail rows and links."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.ids import parse_hex_id, to_hex
from sightline.functions.text import (
    contains_ignore_case,
    magnet_link,
    shares_piece,
    term_trigrams,
    trigram_similarity,
    trigrams,
)
from sightline.operators.postings import PostingTable
from sightline.vocab import (
    DEFAULT_PAGE_SIZE,
    MAX_PAGE_SIZE,
    SIMILARITY_THRESHOLD,
    SORT_COLUMNS,
)


def page_bounds(page: int | None, limit: int | None) -> tuple[int, int]:
    """Page from 1, size from 1 to 100 with 25 as default."""
    page = max(1, page or 1)
    limit = min(MAX_PAGE_SIZE, max(1, limit or DEFAULT_PAGE_SIZE))
    return page, limit


def matches(name: Column, term: str) -> Column:
    """The name contains the term, or their trigram similarity reaches the threshold.

    Similarity is only worked out for names that share a piece with the term.
    """
    similar = shares_piece(name, term) & (trigram_similarity(name, term) >= SIMILARITY_THRESHOLD)
    return F.coalesce(contains_ignore_case(name, term) | similar, F.lit(False))


def matching(
    items: DataFrame, term: str | None, name: str = "name", *, key: str = "infohash",
    index: PostingTable | None = None,
) -> DataFrame:
    """All items an (optional) search term selects; with an ``index`` of them names are not scanned."""
    term = (term or "").strip()
    if not term:
        return items
    if index is not None:
        found = index.matching(term).withColumnRenamed("id", "_found")
        return items.join(found, F.col(key) == F.col("_found"), "left_semi")
    return items.filter(matches(F.col(name), term))


def search(
    items: DataFrame, term: str | None = None, sort: str | None = None, order: str = "desc",
    page: int = 1, limit: int = DEFAULT_PAGE_SIZE, *, key: str = "infohash", after: tuple | None = None,
    index: PostingTable | None = None,
) -> DataFrame:
    """One page of the item list; with an ``index`` a term is looked up instead of scanned for.

    ``sort`` is one of verified_at, size, files, name; without it a search is ordered by
    similarity and the plain list by verified_at. NULLs come last ascending, first descending.
    ``after=(value, id)`` continues behind a row instead of counting rows off, so deep pages
    cost the same as the first one.
    """
    page, limit = page_bounds(page, limit)
    term = (term or "").strip()
    found = matching(items, term, key=key, index=index)
    if sort in SORT_COLUMNS:
        by, ascending = F.col(SORT_COLUMNS[sort]), order == "asc"
    elif term:
        by, ascending = trigram_similarity(F.col("name"), term), False
    else:
        by, ascending = F.col("verified_at"), False
    found = found.withColumn("_by", by)
    if after is not None:
        value, last_id = F.lit(after[0]), F.lit(after[1])
        same = F.col("_by").eqNullSafe(value) & (F.col(key) > last_id)
        if ascending:
            later = F.when(value.isNull(), F.lit(False)).otherwise(
                F.col("_by").isNull() | (F.col("_by") > value)
            )
        else:
            later = F.when(value.isNull(), F.col("_by").isNotNull()).otherwise(
                F.coalesce(F.col("_by") < value, F.lit(False))
            )
        found = found.filter(same | later)
    direction = F.col("_by").asc_nulls_last() if ascending else F.col("_by").desc_nulls_first()
    ordered = found.orderBy(direction, key)
    if after is None and page > 1:
        ordered = ordered.offset((page - 1) * limit)
    return ordered.limit(limit).drop("_by")


def list_columns(items: DataFrame, key: str = "infohash") -> DataFrame:
    """The columns a result list shows, with the id in hex."""
    return items.select(
        to_hex(F.col(key)).alias(key), "name", "total_size", "file_count", "verified_at"
    )


def search_total(
    items: DataFrame, term: str | None = None, limit: int = DEFAULT_PAGE_SIZE, *, key: str = "infohash",
    index: PostingTable | None = None,
) -> DataFrame:
    """Number of matches and of pages (at least 1)."""
    _, limit = page_bounds(1, limit)
    return matching(items, term, key=key, index=index).agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("bigint")
    )


def pages_of(total: int, limit: int) -> int:
    return max(1, math.ceil(total / limit))


def split_keys(keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a parsed ``infohash``, rows whose text is not a 40-digit hex id)."""
    parsed = keys.withColumn("infohash", parse_hex_id(F.col(column)))
    return (
        parsed.filter(F.col("infohash").isNotNull()),
        parsed.filter(F.col("infohash").isNull()).drop("infohash"),
    )


def detail(items: DataFrame, sightings: DataFrame, keys: DataFrame | None = None, key: str = "infohash") -> DataFrame:
    """Items with their sighting columns, null when never sighted; optionally for some keys."""
    wanted = items if keys is None else items.join(keys.select(key).distinct(), key, "left_semi")
    return wanted.join(sightings, key, "left")


def magnets(items: DataFrame, key: str = "infohash", name: str = "name") -> DataFrame:
    return items.select(key, magnet_link(to_hex(F.col(key)), F.col(name)).alias("magnet"))


def trigram_index(items: DataFrame, key: str, name: str = "name") -> DataFrame:
    """Search index as a table: one row per (piece, id) with the number of pieces of the name.

    Written partitioned or bucketed by ``gram``, a term reads only its own pieces.
    """
    return items.select(
        key, F.explode(trigrams(F.col(name))).alias("gram"), F.size(trigrams(F.col(name))).alias("grams")
    )


def similar_by_index(index: DataFrame, term: str, key: str, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Ids whose similarity to the term reaches the threshold, from the index alone."""
    pieces = term_trigrams(term)
    shared = (
        index.filter(F.col("gram").isin(pieces))
        .groupBy(key, "grams")
        .agg(F.count(F.lit(1)).alias("_shared"))
    )
    score = F.col("_shared") / (F.col("grams") + F.lit(len(pieces)) - F.col("_shared"))
    return shared.select(key, score.alias("similarity")).filter(F.col("similarity") >= threshold)
