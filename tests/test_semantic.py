"""The inverted file against all pairs: recall of the probes, exact answers, batches, pruned scans."""

import numpy as np
import pyarrow as pa
import pytest

from sightline.operators import semantic
from sightline.operators.semantic import InvertedFile
from sightline.plans import QUERIES


def frame(spark, ids, v):
    return spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")


def clustered(rows, seed=3, width=16):
    """A third of the rows near one direction, the rest around sixty others; some rows twice."""
    draw = np.random.default_rng(seed)
    hearts = draw.standard_normal((60, width))
    at = np.where(np.arange(rows) < rows // 3, 0, draw.integers(0, 60, rows))
    v = hearts[at] + 0.4 * draw.standard_normal((rows, width))
    v[-20:] = v[:20]
    return v


def plain(ids, v, asked, k):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in asked:
        score = np.round(unit @ unit[q], 9)
        order = [n for n in np.lexsort((ids, -score)) if ids[n] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[n]), round(float(score[n]), 6)) for n in order]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    v, ids = clustered(3000), np.arange(3000) + 7
    path = str(tmp_path_factory.mktemp("ivf"))
    first = frame(spark, ids[:2000], v[:2000]).repartition(4)
    index = InvertedFile.build(first, path, width=16, lists=50)
    index.add(frame(spark, ids[2000:], v[2000:]), 1)
    index.add(frame(spark, ids[2000:], v[2000:]), 1)  # a repeated batch changes nothing
    return index, ids, v


def test_recall_of_probes(spark, built):
    index, ids, v = built
    asked = np.arange(0, 3000, 20)
    want = plain(ids, v, asked, 10)
    got = answers(index.nearest(frame(spark, ids[asked], v[asked]), 10))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9


def test_exact_answers(spark, built, monkeypatch):
    index, ids, v = built
    monkeypatch.setattr(semantic, "PART_ROWS", 300)  # the large list is cut into parts
    asked = np.arange(0, 3000, 30)
    got = answers(index.nearest(frame(spark, ids[asked], v[asked]), 10, probes=2, exact=True))
    assert got == plain(ids, v, asked, 10)


def test_more_asked_for_than_there_is(spark, tmp_path):
    v = clustered(45, width=8)
    index = InvertedFile.build(frame(spark, np.arange(45), v), str(tmp_path), width=8, lists=9)
    got = answers(index.nearest(frame(spark, np.arange(45), v), 100, probes=1, exact=True))
    assert got == plain(np.arange(45), v, range(45), 100)


def test_search_reads_the_probed_lists_only(spark, built, capsys):
    index, ids, v = built
    rows = index.rows([3, 5])
    rows.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert {r["list"] for r in rows.select("list").distinct().collect()} <= {3, 5}
    assert rows.count() < index.rows().count() == 3000


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0]), (10, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, list int")
    index = InvertedFile.build(df, str(tmp_path / "a"), width=2, lists=2)
    got = answers(index.nearest(df.filter("vec_id <> 10"), 3, exact=True))
    assert got == {1: [(2, 1.0), (10, 0.0), (10, 0.0)], 2: [(1, 1.0), (10, 0.0), (10, 0.0)]}
    empty = InvertedFile.build(df.limit(0), str(tmp_path / "b"), width=2)
    assert empty.nearest(df, 3, exact=True).collect() == []


def test_probes_leave_in_bounded_batches(spark, built, monkeypatch):
    """However many lists a query needs, no task hands on all its probes at once."""
    index, ids, v = built
    part = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([[1.0, 0.0]] * 300)], ["query_id", "v"])
    at, lists = np.repeat(np.arange(300), 100), np.tile(np.arange(100), 300)
    made = list(semantic._probes(part, at, lists))
    assert max(b.num_rows for b in made) <= semantic.PROBE_ROWS < len(at) == sum(b.num_rows for b in made)
    assert [r for b in made for r in b.column(0).to_pylist()] == at.tolist()
    monkeypatch.setattr(semantic, "ASKED_ROWS", 7)
    monkeypatch.setattr(semantic, "PROBE_ROWS", 13)
    asked = np.arange(0, 3000, 100)
    assert answers(index.nearest(frame(spark, ids[asked], v[asked]), 10, probes=2, exact=True)) == plain(ids, v, asked, 10)


def test_registered_query_asks_for_every_vector(spark, tmp_path):
    """semantic_exact answers for all rows of its table, not for every twentieth."""
    v, ids = clustered(90, width=64).astype(np.float32).astype(float), np.arange(90) + 1
    frame(spark, ids, v).selectExpr("vec_id", "cast(embedding AS array<float>) AS embedding", "0 AS label").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    got = answers(QUERIES["semantic_exact"](spark, str(tmp_path)))
    assert got == plain(ids, v, range(90), 10)


def test_ties_after_rounding_beyond_the_list(spark, tmp_path):
    """Copies that differ by less than the score's last digit tie, whichever list they lie in; the smaller id comes first."""
    turn = np.concatenate([np.full(30, 2e-5), np.zeros(30)])  # the first thirty ids are off by less than a score can show
    v = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    index = InvertedFile.build(frame(spark, np.arange(60), v), str(tmp_path), width=2, lists=2)
    assert index.rows().select("list").distinct().count() == 2
    asked = np.arange(30, 60)
    got = answers(index.nearest(frame(spark, asked, v[asked]), 5, probes=1, exact=True))
    assert got == plain(np.arange(60), v, asked, 5) and got[40][0] == (0, 1.0)


def test_queries_that_share_an_id(spark, tmp_path):
    """One of them lies between two lists, the other far off in the second: the first still meets the second list."""
    turn = np.linspace(-0.3, 1.3, 80)
    v, asked = (np.stack([np.cos(x), np.sin(x)], axis=1) for x in (turn, np.array([0.48, 3.0])))
    index = InvertedFile.build(frame(spark, np.arange(80), v), str(tmp_path), width=2, lists=2)
    got = answers(index.nearest(frame(spark, [-1, -1], asked), 10, probes=1, exact=True))
    score = np.round(asked @ v.T, 9)
    pairs = sorted((-s, n) for row in score for n, s in enumerate(row))[:10]
    assert got == {-1: [(n, round(float(-s), 6)) for s, n in pairs]}


def test_exact_answers_block_by_block(spark, built, tmp_path, monkeypatch):
    """Many blocks, queries in many tasks, and a group of copies larger than a block."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(bound, None)
    for name, value in {"BLOCK_ROWS": 70, "TASK_ROWS": 400, "LEAST_ROWS": 100, "FILE_BLOCKS": 3, "BATCH_BYTES": 30_000}.items():
        monkeypatch.setattr(semantic, name, value)
    index, ids, v = built
    asked = np.arange(0, 3000, 2)
    assert answers(index.nearest(frame(spark, ids[asked], v[asked]), 10, exact=True)) == plain(ids, v, asked, 10)
    w = clustered(900, width=8)
    w[100:400] = w[7]
    copies = InvertedFile.build(frame(spark, np.arange(900), w).repartition(3), str(tmp_path), width=8, lists=20)
    assert answers(copies.nearest(frame(spark, np.arange(900), w), 10, exact=True)) == plain(np.arange(900), w, range(900), 10)
    assert spark.conf.get(bound, None) == was


def test_exact_answers_under_text_ids(spark, tmp_path):
    v = clustered(200, width=8)
    names = [f"ä{n:03d}" if n % 2 else f"z{n}" for n in range(200)]
    df = spark.createDataFrame([(n, x.tolist()) for n, x in zip(names, v)], "vec_id string, embedding array<double>")
    index = InvertedFile.build(df, str(tmp_path), width=8)
    got = answers(index.nearest(df, 5, exact=True))
    place = np.argsort(np.argsort(names))
    want = plain(place, v, range(200), 5)
    back = dict(zip(place.tolist(), names))
    assert got == {back[q]: [(back[i], s) for i, s in found] for q, found in want.items()}


def test_a_block_too_far_away_is_left_and_none_else():
    """The bound never hides a vector that belongs among the nearest, however the blocks come."""
    draw = np.random.default_rng(5)
    for width, spread in ((3, 0.3), (16, 0.05), (64, 1.0)):
        v = draw.standard_normal((12, width))[draw.integers(0, 12, 1500)] + spread * draw.standard_normal((1500, width))
        v = v[np.lexsort(v.T)]
        unit, ids = v / np.linalg.norm(v, axis=1, keepdims=True), np.arange(1500)
        one = semantic._Asked(ids, unit, 7)
        for at in draw.permutation(15):
            part = slice(100 * at, 100 * at + 100)
            centre = unit[part].mean(axis=0)
            one.meet(ids[part], unit[part], centre, np.linalg.norm(unit[part] - centre, axis=1).max())
        got = {}
        for row, other, score in one.found:
            for r, i, s in zip(row, other, score):
                got.setdefault(int(r), []).append((int(i), round(float(s), 6)))
        assert got == plain(ids, v, range(1500), 7)
