import hashlib
import random
import re

import numpy as np
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F
from test_queries_llm import against_sql, odd_documents

from sightline.llm import fill_middle as fm
from sightline.llm.queries import ORACLES, QUERIES


def plainly(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall("[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(k in text for k in fm.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    draw = random.Random(2)
    odd = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "a\r\nb\r", "<", "x<\n<P", "has <M> mark\nx", "<S>", "<P", ">\n>S>\nP>",
           "é\nß漢\U0001f600\n̈", "\0\n\0", "line sep \nx\vy\fz\n", "long " * 30_000, "l\n" * 50_000]
    made = ["".join(draw.choice(["word ", "\n", "é", "漢字 ", "<", "<P", ">", "\U0001f600"]) for _ in range(draw.randint(0, 60)))
            for _ in range(1500)]
    return odd + made


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 90), (0, 50)])
def test_against_plain_python(spark, rate, spm):
    rows = [(n if n % 97 else None, t, "x", n) for n, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    out = fm.fill_in_middle(df.repartition(3), rate=rate, spm=spm).withColumn(
        "restored", fm.restored(F.col("output"), F.col("form"))
    ).collect()
    got = sorted([tuple(r)[:6] for r in out], key=str)
    assert got == sorted([(i, *plainly(i, t, rate=rate, spm=spm)) for i, t, _, _ in rows], key=str)
    assert sorted(r.restored for r in out) == sorted(t or "" for _, t, _, _ in rows)


def test_odd_documents(spark, tmp_path):
    odd_documents(spark, tmp_path)
    assert against_sql(spark, tmp_path, "op12_fill_middle") is None


def test_larger_table(spark):
    folder = "/root/testdata/sf0.01"
    assert differences(QUERIES["op12_fill_middle"](spark, folder), connect(folder), ORACLES["op12_fill_middle"]) is None


@pytest.mark.parametrize("error", [0, 3, 120, 5000])
def test_rank_index_is_exact_and_bounded(error):
    draw = np.random.default_rng(7)
    for steps in (np.full(5000, 61), draw.integers(0, 400, 5000), draw.zipf(1.3, 3000) % 100_000, np.zeros(50, int)):
        offsets = np.cumsum(steps).astype(np.int64)
        index = fm.RankIndex(offsets, error)
        assert (index.offset(np.arange(len(offsets))) == offsets).all()
        assert np.abs(index.residual).max() <= error + 1
    assert len(fm.RankIndex(np.arange(0, 610_000, 61), 120).first) == 1


def test_blocks_do_not_change_results(monkeypatch):
    values = [(t or "").encode() for t in texts()]
    drawn = np.random.default_rng(1).integers(0, 1 << 32, (len(values), 4))
    rearrange = fm.Rearranger()
    assert rearrange(values, drawn) == [rearrange([v], drawn[n : n + 1])[0] for n, v in enumerate(values)]
