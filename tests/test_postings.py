"""The stored index answers every term like a scan of all names."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from sightline.operators import postings, search

NAMES = [
    "Red Widget", "red widget red", "widgets, reddish", "aaaa", "AAAAA", "ananas banana", "a", "ab", "", " ", "x  y",
    "100%_done", "back\\slash", "İstanbul ΟΔΟΣ", "οδος", "straße STRASSE", "漢字かな漢字", "\U0001f600\U0001f600 smile",
    "tab\tand\nline", "ends with re", "re", "é́", None, "red widget",
]
TERMS = [
    "red widget", "RED", "r", "re", "edw", "d w", "aaa", "aaaa", "aaaaaa", "ana", "nana", "a", "%_", "\\", "ΟΔΟΣ", "οδο",
    "STRASSE", "ß", "漢字か", "漢", "\U0001f600", "\U0001f600\U0001f600 s", "\t", "line", "  ", "x  y", "none of these", "é",
    "widget red", "red red", "ends with", "\n",
]


@pytest.fixture(scope="module")
def items(spark):
    rows = [(n, name, n * 7 % 11, n) for n, name in enumerate(NAMES)]
    rows += [(1000 + n, f"item {n % 50} of shelf {n % 7}", n, n) for n in range(700)]
    return spark.createDataFrame(rows, "infohash long, name string, total_size long, id long")


@pytest.fixture(scope="module", params=[(64, 4096), (3, 50)])
def index(spark, items, request, tmp_path_factory):
    buckets, block_rows = request.param
    path = str(tmp_path_factory.mktemp("postings"))
    return postings.write_postings(items, path, "infohash", buckets=buckets, block_rows=block_rows)


TERMS += ["item 7 of", "shelf 3", "shelf", "f s"]


def test_same_matches_as_the_scan(items, index):
    found = [index.containing(term).select(F.lit(n).alias("n"), "id") for n, term in enumerate(TERMS)]
    got = {(r.n, r.id) for r in reduce(lambda a, b: a.union(b), found).collect()}
    rows = items.select("infohash", F.lower("name").alias("low"), *[
        F.lower(F.lit(term)).alias(f"t{n}") for n, term in enumerate(TERMS)
    ]).collect()
    want = {(n, r.infohash) for r in rows for n in range(len(TERMS)) if r.low is not None and r[f"t{n}"] in r.low}
    assert got == want


@pytest.mark.parametrize("term,sort", [("red widget", None), ("item 7 of", "size"), ("e", "name"), ("none of these", None), (" ", "size")])
def test_same_pages_as_the_scan(items, index, term, sort):
    scan = search.search(items, term, sort, limit=100).collect()
    assert search.search(items, term, sort, limit=100, index=index).collect() == scan
    assert search.search_total(items, term, index=index).collect() == search.search_total(items, term).collect()


def test_plan_reads_the_buckets_of_the_term(spark, items, tmp_path, capsys):
    index = postings.write_postings(items, str(tmp_path), "infohash", buckets=64)
    found = index.containing("widget")
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert "PushedFilters: [In(piece" in plan or "In(piece" in plan
    read = index.rows().filter(F.col("bucket").isin(
        [r.bucket for r in index.rows().filter(F.col("piece").isin("wid", "idg", "dge", "get")).select("bucket").distinct().collect()]
    )).inputFiles()
    assert len({f for f in read}) <= len(index.rows().inputFiles())
    assert found.count() == 4


def test_blocks_bound_the_lists(spark, items, tmp_path):
    index = postings.write_postings(items, str(tmp_path), "infohash", buckets=4, block_rows=50)
    longest = index.rows().filter("piece = 'she'").agg(F.max(F.size("ids")), F.count("*")).first()
    assert longest[0] <= 100 and longest[1] >= 700 / 100
    assert index.rows().filter(F.expr("ids <> array_sort(ids)")).count() == 0


def test_empty_and_nameless_tables(spark, items, tmp_path):
    for n, some in enumerate((items.limit(0), items.filter("name is null"))):
        index = postings.write_postings(some, f"{tmp_path}/{n}", "infohash")
        assert index.matching("red").collect() == index.containing("r").collect() == []


def test_another_session_finds_the_table(spark, items, tmp_path):
    postings.write_postings(items, str(tmp_path), "infohash", buckets=5)
    again = postings.PostingTable(spark, str(tmp_path))
    assert again.buckets == 5 and again.containing("smile").collect()[0].id == 17


def test_blocks_are_written_in_runs(spark, items, tmp_path, monkeypatch):
    """A task holds the postings of a run of names, and answers stay those of the scan."""
    monkeypatch.setattr(postings, "RUN_CHARS", 40)
    index = postings.write_postings(items, str(tmp_path), "infohash", buckets=4)
    assert index.rows().groupBy("kind", "piece", "block").count().filter("count > 1").count() > 0
    for term in ("item 7 of", "re", "\U0001f600\U0001f600 s"):
        low = F.lower(F.lit(term))
        want = {r.infohash for r in items.filter(F.contains(F.lower("name"), low)).collect()}
        assert {r.id for r in index.containing(term).collect()} == want
    scan = search.search(items, "red widget", limit=100).collect()
    assert search.search(items, "red widget", limit=100, index=index).collect() == scan


def test_windows_of_a_run():
    names = ["abca", "", "é\U0001f600", "a"]
    pieces, owners, numbers = postings._windows(names)
    want = [(n[at : at + 3], owner, at) for owner, n in enumerate(names) for at in range(len(n))]
    assert list(zip(postings._texts(pieces), owners.tolist(), numbers.tolist())) == want
