import hashlib

import numpy as np
import pytest
from oracle import connect, differences
from test_queries_llm import against_sql

from sightline.llm import ns_kmeans as ns
from sightline.llm.queries import ORACLES, QUERIES


def plain(ids, v, k, rounds, seed=2):
    """Lloyd's rounds in Python integers."""
    order = sorted(range(len(v)), key=lambda n: (hashlib.sha256(f"{seed}:{ids[n]}".encode()).hexdigest(), v[n]))
    centres = [list(v[n]) for n in order[:k]]
    for n in range(rounds + 1):
        dist = [[sum((a - b) ** 2 for a, b in zip(x, c)) for c in centres] for x in v]
        own = [min(range(len(centres)), key=lambda j: (d[j], j)) for d in dist]
        if n < rounds:
            for j in range(len(centres)):
                mine = [x for x, o in zip(v, own) if o == j]
                if mine:
                    centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return own, [d[o] for d, o in zip(dist, own)], centres


def frame(spark, ids, v, scale=1):
    rows = [(i, [float(a) / scale for a in x], 0) for i, x in zip(ids, v)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int")


@pytest.mark.parametrize("spread,rows,k,rounds", [(40, 400, 12, 6), (3, 300, 25, 4), (900_000, 200, 9, 3), (1 << 26, 60, 5, 2), (5, 6, 9, 2)])
def test_against_plain_rounds(spark, spread, rows, k, rounds):
    """Far and near values, many ties, wide integers, fewer vectors than centroids."""
    draw = np.random.default_rng(rows)
    v = draw.integers(-spread, spread + 1, (rows, 8)).tolist()
    ids = list(range(100, 100 + rows))
    got, centres = ns.cluster(frame(spark, ids, v).repartition(3), k, rounds, width=8, scale=1)
    own, dist, want = plain(ids, v, k, rounds)
    assert sorted((r.vec_id, r.own, r.distance) for r in got.collect()) == list(zip(ids, own, dist))
    assert centres.tolist() == want


def test_bounds_skip_most_distances_and_stay_exact():
    draw = np.random.default_rng(9)
    heart = draw.integers(-3000, 3000, (20, 32))
    x = heart[draw.integers(0, 20, 4000)] + draw.integers(-200, 200, (4000, 32))
    centres = x[:20].copy()
    dist = ns.squared(x, centres)
    own, seen, rounds = dist.argmin(axis=1), np.zeros(dist.shape, np.int8), [centres]
    evaluated = 0
    for n in range(8):
        new = np.stack([x[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else rounds[-1][j] for j in range(20)])
        rounds.append(new)
        evaluated += ns.History(rounds).assign(x, own, dist, seen, settle=n == 7)
        full = ns.squared(x, new)
        assert (own == full.argmin(axis=1)).all()
    assert (dist[np.arange(4000), own] == full.min(axis=1)).all()
    assert evaluated < 0.3 * 8 * dist.size


def test_bound_is_the_norm_of_the_total_way():
    """A centroid that went away and came back loosens nothing."""
    rounds = [np.array([[0, 0], [10, 0]]), np.array([[50, 0], [10, 0]]), np.array([[0, 0], [13, 4]])]
    moved = ns.History(rounds).moved
    assert moved[0, 0] == 0 and moved[1, 0] == pytest.approx(50) and moved[0, 1] == pytest.approx(5)


def test_too_large_components_are_an_error():
    with pytest.raises(ValueError):
        ns.squared(np.full((1, 64), 1 << 30), np.zeros((1, 64), np.int64))


def odd(spark, folder, times):
    nan, inf = float("nan"), float("inf")
    draw = np.random.default_rng(4)
    rows = [(n, draw.normal(size=64).round(2).tolist()) for n in range(60)]
    rows += [(100 + n, [0.25] * 64) for n in range(times)] + [(7000, [0.25] * 63 + [-9.0])]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 65), (1004, [nan] + [1.0] * 63),
             (1005, [inf] + [1.0] * 63), (1006, [None] + [1.0] * 63), (1007, [-1000.0] * 64)]
    df = spark.createDataFrame([(*r, 1, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, own int, key string")
    df.write.parquet(f"{folder}/embeddings.parquet")


@pytest.mark.parametrize("times", [3, 200])
def test_odd_vectors(spark, tmp_path, times):
    odd(spark, tmp_path, times)
    assert against_sql(spark, tmp_path, "op13_ns_kmeans") is None


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 2.0]), (1, [5.0, 5.0]), (None, [1.0, 2.0]), (None, None), (2, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, centres = ns.cluster(df, 2, 3, width=2, scale=1)
    assert sorted(str(r.vec_id) for r in got.collect()) == ["1", "1", "2", "None"]
    assert len(centres) == 2


def test_larger_table(spark):
    folder = "/root/testdata/sf0.1"
    assert differences(QUERIES["op13_ns_kmeans"](spark, folder), connect(folder), ORACLES["op13_ns_kmeans"]) is None
