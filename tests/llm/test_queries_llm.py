import pyarrow as pa
import pytest
from oracle import TABLES, connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm.packing import Encoder, tokenizer_path
from sightline.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


def odd_documents(spark, folder, ids_repeat=True, words=30_000):
    """Nulls, empty and long texts, ties, repeated rows, unusual characters, clashing columns."""
    long = " ".join(f"word{n % 977} and{n % 13}" for n in range(words))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t\r\v\f ", "en", "a"), (4, long, "en", "a"),
        (5, long + " tail", "en", None), (6, "Ünïcode ß É x   y İ", "fr", "b"), (7, "x", "fr", "b"),
        (8, "Same line\nsame  LINE\n same line ", "de", "b"), (9, "12345 !!", "de", "\U0001f600"),
        (10, "a b c", "en", "￿"), (11, "A b  c", "en", "a"), (12, "one two three four five six", None, "a"),
        (13, "it's <|endoftext|> 'll don't", "en", "a"),
        *[(100 + n, "shared header\n" + " ".join(f"t{n}x{k}" for k in range(40)), "en", "a") for n in range(12)],
        *[(200 + n, " ".join(f"c{k}" for k in range(60)) + f" e{n}", "es", "a") for n in range(5)],
        *([(300, "again and again", "en", "a")] * 3 if ids_repeat else []),
        *([(None, "no id at all", "en", "a")] if ids_repeat else []),
    ]
    df = spark.createDataFrame(
        [(*r, -1, "x", 0, r[0]) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, hash string, shard int, id long",
    )
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return df


def odd_vectors(spark, folder):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.5]), (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]),
        (6, [None, 1.0, 1.0]), (7, [-1.0, 0.25, 0.5]), (8, [1.0, 0.0, 0.5]), (9, [1.0, 0.001, 0.5]),
        (10, [2.0, 0.0, 1.0]), (50, [0.3, -0.7, 0.1]), (100, [0.3, -0.7, 0.1]), (101, [0.3, -0.7, 0.1]),
        (102, [1.0e3, -2.0e3, 3.0]),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int")
    df.write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return df


def against_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        if (folder / f"{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    return differences(QUERIES[name](spark, str(folder)), con, ORACLES[name])


@pytest.mark.parametrize("name", ["op5_line_dedup", "op8_substring"])
def test_odd_documents_with_repeats(spark, tmp_path, name):
    odd_documents(spark, tmp_path)
    assert against_sql(spark, tmp_path, name) is None


def test_odd_documents_joined(spark, tmp_path):
    odd_documents(spark, tmp_path, ids_repeat=False, words=400)
    assert against_sql(spark, tmp_path, "op6_parity_join") is None


def test_odd_documents_joined_with_repeats(spark, tmp_path):
    odd_documents(spark, tmp_path, words=400)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op6_parity_join"](spark, str(tmp_path)).collect()}
    assert {(300, 1, 300), (None, 1, None), (200, 57, 200), (204, 57, 200), (1, 0, 1), (10, 1, 10), (11, 1, 10)} <= got


def test_odd_vectors_searched(spark, tmp_path):
    odd_vectors(spark, tmp_path)
    assert against_sql(spark, tmp_path, "op10_maxscore") is None


def test_odd_pages(spark, tmp_path):
    big = "<p>" + "é x " * 400
    rows = [(1, "u", big), (2, None, big), (3, "a\r\nb", big + "!"), (4, "u", None), (5, "u", ""), (6, "u", "small"),
            (7, "u", "small"), (8, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc" * 50), (9, "u", big)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert against_sql(spark, tmp_path, "op4_warc") is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "embeddings", "pages"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_pipeline_on_odd_documents(spark, tmp_path):
    docs = odd_documents(spark, tmp_path)
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        steps.append(docs)
    language, lines, unlike, mixed, packed = steps
    assert {r.doc_id for r in language.collect()}.isdisjoint({1, 2, 3, 9})
    assert not lines.filter("text like '%shared header%'").count()
    assert lines.filter("n_chars <> char_length(text)").count() == 0
    assert unlike.filter("doc_id between 200 and 204").count() == 1
    assert unlike.filter("doc_id = 300").count() == 1
    for step in (language, lines, unlike, mixed):
        assert step.columns == odd_documents(spark, f"{tmp_path}/again").columns
    assert packed.count() >= mixed.count() > 0


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    words = " ".join(f"w{n}" for n in range(100))
    rows = [(3, words), (7, words + " more"), (7, "a wholly different clean text about other things"),
            (2, words + " x"), (2, words + " y"), (None, words), (None, words + " z"), (9, words), (9, words)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text[:9], len(r.text) - len(words)) for r in kept) == [
        (0, "w0 w1 w2 ", 0), (0, "w0 w1 w2 ", 2), (2, "w0 w1 w2 ", 2), (7, "a wholly ", 48 - len(words))
    ]


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_pipeline_bounds_what_python_workers_hold(spark, monkeypatch):
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 600, 1, 2).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text")
    asked = {}

    def sizes(docs, **more):
        def size(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

        asked.update(more)
        return docs.mapInArrow(size, "rows long, size long")

    def parts(docs, *_, **__):
        return docs.selectExpr("CAST(NULL AS long) AS class", "doc_id AS id", "unhex('00') AS mark")

    with monkeypatch.context() as patch:
        patch.setattr(corpus_pipeline, "packed_documents", sizes)
        patch.setattr(corpus_pipeline, "jaccard_components", parts)
        patch.setattr(corpus_pipeline, "train", lambda *_: None)
        patch.setattr(corpus_pipeline, "predict", lambda *_: F.expr("struct('en' AS lang_pred, 1.0 AS score)"))
        for stage in (corpus_pipeline.language_id, corpus_pipeline.near_duplicates, corpus_pipeline.pack_sequences):
            spark.conf.unset(bound)
            out = stage(spark, docs, "")
            assert spark.conf.get(bound) == corpus_pipeline.BATCH
    found = out.collect()
    assert sum(r.rows for r in found) == 600
    assert max(r.size for r in found) < 2 << 20
    assert asked == {"known": corpus_pipeline.KNOWN}


def test_encoder_keeps_to_the_limit_of_the_task():
    encoder, whole = Encoder.of(tokenizer_path(), 100), Encoder(tokenizer_path())
    for at in range(0, 4000, 200):
        block = [f"p{'abcdefghij'[n % 10]}{'klmnopqrst'[n // 10 % 10]}{'uvwxyzabcd'[n // 100 % 10]}{'efghijklmn'[n // 1000]}"
                 for n in range(at, at + 200)]
        assert encoder.ids(block) == whole.ids(block)
        assert len(encoder.known) + len(encoder.older) <= 2 * (100 + 200)
    assert Encoder.of(tokenizer_path()).limit > 100
