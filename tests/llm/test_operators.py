import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries_llm import odd_documents, odd_vectors

from sightline.llm import common, forest, hilbert, langid, maxscore, mixing, packing, parity_join, substring, warc
from sightline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("axes,bits", [(1, 3), (2, 3), (3, 2), (4, 1)])
def test_hilbert_curve_visits_neighbours(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    order = hilbert.curve_index(cells, bits)
    assert sorted(order) == list(range(len(cells)))
    path = cells[np.argsort(order)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_hilbert_shards(spark, tmp_path, law):
    docs = odd_documents(spark, tmp_path)
    got = hilbert.hilbert_shards(docs, ["lang", "source", "n_chars"], 4, law).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    cells = sorted((r.shard, r.slot, r.cell) for r in got)
    assert [c[2] for c in cells] == sorted(c[2] for c in cells)


def test_hilbert_pruning_keeps_every_match(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    shards = hilbert.hilbert_shards(docs, ["lang", "source"], 16).cache()
    bounds = hilbert.shard_bounds(shards)
    kept = {r.shard for r in hilbert.prune(bounds, d0="fr", d1="src3").collect()}
    real = {r.shard for r in shards.filter("d0 = 'fr' and d1 = 'src3'").collect()}
    assert real <= kept and len(kept) < 16


def test_packing_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    odd_documents(spark, tmp_path)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = [r.text or "" for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    want = []
    for text in texts:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4")
        want += [(s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    got = QUERIES["op2_packing"](spark, str(tmp_path)).collect()
    assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and len(rows) <= packing.SEGMENTS


def test_packing_keeps_all_limits(spark):
    draw = np.random.default_rng(1)
    rows = [(n, int(t), int(0.6 * t * s)) for n, (t, s) in enumerate(zip(draw.integers(1, 900, 3000), draw.random(3000)))]
    rows.append((3000, 5000, 10))
    items = spark.createDataFrame(rows, "id long, tokens long, loss long")
    got = packing.pack(items, "tokens", "loss", (2048, 6, 560), group_rows=1000, pool=128).toPandas()
    assert sorted(got.id) == list(range(3001))
    sums = got[got.id != 3000].groupby("sequence_id").agg(t=("tokens", "sum"), n=("id", "count"), l=("loss", "sum"))
    assert sums.t.max() <= 2048 and sums.n.max() <= 6 and sums.l.max() <= 560
    least = max(got.tokens.sum() / 2048, 3000 / 6, got.loss.sum() / 560)
    assert len(sums) <= 1.15 * least


def test_language_is_learned(spark):
    got = QUERIES["op3_langid"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.join(docs, "doc_id").filter("held_out").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert held.score.between(0, 1).all()


def test_language_of_odd_documents(spark, tmp_path):
    odd_documents(spark, tmp_path)
    got = {r.doc_id: r for r in QUERIES["op3_langid"](spark, str(tmp_path)).collect()}
    assert {got[n].lang_pred for n in (1, 2, 3, 9)} == {"und"}
    assert got[10].held_out == (zlib.crc32(b"10") % 3 == 1)
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = langid.train(unlabelled, F.lit(True))
    assert model.predict("text") == ("und", 0.0)


def test_gram_counts_do_not_depend_on_stretches(monkeypatch):
    text = "Ab cé  d!" * 50
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "STRETCH", 7)
    assert (langid.gram_counts(text) == whole).all()


@pytest.mark.parametrize("ranges", [100, 4096, 1 << 20])
def test_warc_ranges_own_each_record_once(spark, tmp_path, ranges):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").limit(40)
    warc.write_warc(pages.coalesce(2), f"{tmp_path}/w")
    got = warc.read_warc(spark, f"{tmp_path}/w", ranges).collect()
    assert sorted(bytes(r.payload).decode() for r in got) == sorted(r.html for r in pages.collect())


def test_warc_false_magic_and_big_members(tmp_path):
    import pyarrow as pa

    noise = warc.MAGIC * 20
    record = warc.record_bytes("response", "1", None, "x", None, noise + bytes(17 << 20))
    data = noise + warc.member(record) + b"\0" + warc.member(warc.record_bytes("response", "2", None, "x", None, b"")) + b"\0"
    found = list(warc.records_in(pa.BufferReader(data), len(data), 0, len(data)))
    assert [f["fields"]["warc-record-id"] for _, f in found] == ["<urn:record:1>", "<urn:record:2>"]


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, taken = mixing.mix(docs)
    got = mixing.per_document(rows, taken).toPandas()
    again = mixing.per_document(*mixing.mix(docs.repartition(5))).toPandas()
    key = ["id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert (got.taken <= 3 * got["size"]).all()
    sums = got.groupby("sid").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (sums.taken - sums.target).abs().max() <= 1
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert dict(zip(got.id, got["size"])) == words
    assert (got.shard_words.map(sum) == got.taken).all()
    by_source = {r.source: r.doc_id for r in docs.groupBy("source").agg(F.collect_list("doc_id").alias("doc_id")).collect()}
    for source, ids in by_source.items():
        mine = got[got.id.isin(ids)]
        assert (mine.source_size == sum(words[i] for i in ids)).all()
        shards = np.sum(mine.shard_words.tolist(), axis=0)
        if mine.target.iloc[0] > 64 * 16 * 30:  # a draw over 16 shards, whole slots
            assert (shards > 0).all() and abs(shards - shards.mean()).max() < 6 * np.sqrt(shards.mean() * 64)


@pytest.mark.parametrize("sizes", [{"a": [106], "b": [40, 60], "c": [3]}, {"a": [640], None: [65, 1], "z": [64, 64]}, {"a": [1]}])
def test_small_sources_meet_targets(spark, sizes):
    rows = [(n, " ".join(f"w{k}" for k in range(size)), source)
            for source, own in sizes.items() for n, size in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (1, 2, 3, 4):
        rows, taken = mixing.mix(docs, seed=seed)
        got = mixing.per_document(rows, taken).toPandas()
        sums = got.groupby("sid").agg(target=("target", "first"), taken=("taken", "sum"))
        assert (sums.taken == sums.target.round()).all()
        assert (got.taken <= 3 * got["size"]).all()


def test_twins_in_two_sources_keep_their_source(spark):
    text = " ".join(f"w{n}" for n in range(640))
    rows = [(1, text, "a", 1), (1, text, "b", 2), (1, text, "b", 3), (None, text, "b", 4), (None, "other " + text, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    laid, taken = mixing.mix(docs)
    sources = laid.select("sid", "source").distinct()
    want = {r.source: r.n for r in taken.join(sources, "sid").groupBy("source").agg(F.sum(F.col("last") - F.col("first")).alias("n")).collect()}
    out = mixing.mixed_documents(docs).collect()
    got = Counter()
    for r in out:
        assert len(r.text.split()) <= 641
        got[r.source] += len(r.text.split())
    assert dict(got) == want



def test_targets_fill_up(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 40, "z": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    order, weight = sorted((s for s in sizes if s is not None)) + [None], {}
    for n, s in enumerate(order):
        weight[s] = n % 3 + 1
    want, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            want |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            want[s] = 3 * sizes[s]
            left -= want[s]
        open_ -= over
    assert got == pytest.approx(want)


def test_permutation_is_one(spark):
    df = spark.range(97).select(mixing.permuted(F.col("id"), F.lit(97).cast("long"), F.lit(3)).alias("p"))
    got = [r.p for r in df.collect()]
    assert sorted(got) == list(range(97)) and got != list(range(97))
    back = mixing.permuted(F.col("p"), F.lit(97).cast("long"), F.lit(3), back=True)
    assert [r[0] for r in df.select(back).collect()] == list(range(97))


def test_mixing_odd_documents(spark, tmp_path):
    docs = odd_documents(spark, tmp_path)
    got = QUERIES["op7_mixing"](spark, str(tmp_path)).collect()
    assert len(got) == docs.count()
    assert all(r.size == len((t or "").encode().split()) for r, t in zip(
        sorted((r for r in got if r.doc_id in (4, 5, 6, 12)), key=lambda r: r.doc_id),
        [r.text for r in docs.filter("doc_id in (4, 5, 6, 12)").orderBy("doc_id").collect()],
    ))
    words = docs.select(common.n_words(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    mixed = mixing.mixed_documents(docs.filter("doc_id <> 4 or doc_id is null"))
    assert mixed.columns == docs.columns
    assert abs(sum(r.taken for r in got) - words) <= 64 * 6


def test_sketch_bands_never_lose_a_pair():
    """Pairs at exactly the threshold share a key, with and without common shingles."""
    draw = np.random.default_rng(5)
    for size in (5, 9, 10, 19, 40, 100, 333):
        for _ in range(20):
            both = draw.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
            extra = int(size * 0.2)
            a, b = np.unique(both[:size]), np.unique(both[extra:size])  # 80 percent of the union
            if 100 * len(b) < 80 * len(a):
                continue
            common_ = np.sort(a[draw.random(len(a)) < draw.random()])
            keys = [set(parity_join.sketch_keys(x, common_).tolist()) for x in (a, b)]
            assert len(a) == len(b) or keys[0] & keys[1]
            assert parity_join.by_sketch(parity_join.bit_sketch(a), parity_join.bit_sketch(b), len(a), len(b))


def test_suffix_automaton_counts():
    draw = np.random.default_rng(2)
    texts = [draw.integers(0, 3, draw.integers(1, 30)).tolist() for _ in range(12)]
    weights = draw.integers(1, 4, len(texts)).tolist()
    automaton = substring.SuffixAutomaton()
    for words, weight in zip(texts, weights):
        automaton.add(words, weight)
    automaton.finish()
    for words in [*texts, draw.integers(0, 4, 40).tolist()]:
        for length in (1, 3, 6):
            got = automaton.occurrences(words, length)
            for at in range(len(words) - length + 1):
                want = sum(
                    w * sum(t[k:k + length] == words[at:at + length] for k in range(len(t) - length + 1))
                    for t, w in zip(texts, weights)
                )
                assert got[at] == want


def test_large_anchor_groups_are_not_gathered(spark, monkeypatch):
    draw = np.random.default_rng(4)
    sentences = [[f"w{x}" for x in draw.integers(0, 5000, 12)] for _ in range(12)]
    texts = [sum((sentences[k] for k in draw.integers(0, 12, 8)), []) for _ in range(60)]
    held = []

    def watched(rows, length, decide=substring.repeated_spans):
        held.append(max((r["count"] for r in rows.groupBy("anchor").count().collect()), default=0))
        return decide(rows, length)

    monkeypatch.setattr(substring, "SHARD", 8)
    monkeypatch.setattr(substring, "repeated_spans", watched)
    df = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r.kept for r in substring.drop_repeats(df).collect()}
    length = substring.LENGTH
    windows = [[tuple(t[at : at + length]) for at in range(len(t) - length + 1)] for t in texts]
    times = Counter(itertools.chain(*windows))
    for n, t in enumerate(texts):
        gone = {at + k for at, w in enumerate(windows[n]) if times[w] > 1 for k in range(length)}
        assert got[n] == " ".join(w for at, w in enumerate(t) if at not in gone)
    assert 0 < sum(c > 1 for c in times.values()) < len(times)
    assert max(held) <= 8


def test_forest_against_brute_force(spark):
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((300, 32))
    v = np.repeat(centres, 5, axis=0) + 0.12 * draw.standard_normal((1500, 32))
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = forest.near_duplicates(df, leaf=64, tile=50).toPandas().sort_values("id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert (got.n_links.to_numpy() <= links).all()
    assert got.n_links.sum() >= 0.9 * links.sum() > 0


@pytest.mark.parametrize("rows", [1500, 6000])
def test_forest_keeps_large_groups(spark, rows):
    draw = np.random.default_rng(5)
    v = draw.standard_normal((rows, 64))
    v[: rows // 3] = v[0] / np.linalg.norm(v[0]) + np.sqrt(0.03 / 0.97 / 64) * v[: rows // 3]
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = forest.near_duplicates(df, leaf=32, tile=300).toPandas().sort_values("id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert (got.n_links.to_numpy() <= links).all()
    assert got.n_links.sum() >= 0.98 * links.sum() > 0
    assert set(got.component_id[: rows // 3]) == {0}


def test_forest_odd_vectors(spark, tmp_path):
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(odd_vectors(spark, tmp_path)).collect()}
    assert {got[n] for n in (1, 2, 3, 4, 5, 6)} == {(0, n, True) for n in (1, 2, 3, 4, 5, 6)}
    assert got[0] == (3, 0, True) and got[10] == (3, 0, False)
    assert got[50] == (3, 50, True) and got[101] == (3, 50, False) and got[102] == (3, 50, False)


def test_maxscore_keeps_ties():
    ids = np.array([9, 4, 7, 1])
    shard = maxscore.Shard(ids, np.array([[1, 2], [1, 2], [0, 5], [1, 2]]))
    found, scores = shard.top(7, np.array([3, -1]), 2)
    assert found.tolist() == [1, 4] and scores.tolist() == [1, 1]
