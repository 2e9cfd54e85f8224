import hashlib
import random

import numpy as np
import pytest
from test_queries_llm import odd_documents

from sightline.llm import sentence_pieces as sp
from sightline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    return sp.PieceCodec(sp.model_path())


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def as_the_library(codec, rows):
    out = []
    for r in rows:
        ids = codec.model.encode(r.text or "")
        out.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(codec.model.decode(ids))))
    return sorted(out, key=str)


def got(spark, folder):
    rows = QUERIES["op11_sentence_pieces"](spark, str(folder)).collect()
    return sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows], key=str)


def test_documents(spark, codec):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert got(spark, FOLDER) == as_the_library(codec, docs)


def test_odd_documents(spark, codec, tmp_path):
    docs = odd_documents(spark, tmp_path).collect()
    assert got(spark, tmp_path) == as_the_library(codec, docs)


def test_odd_texts(codec, monkeypatch):
    draw = random.Random(5)
    pieces = list(codec.piece.values())
    marks = lambda s: s.replace(sp.MARK, " ")
    texts = ["", " ", "  ", " a", "a ", "\n", " \n \n", "a\n b", "a\n  b", sp.MARK, "a" + sp.MARK, "\0", "<s></s><0x41>",
             " " * 999, "a" * 3000, "\U0001f600 ퟿", "漢字かな", "x́", "\r\n\t", "ab " * 500]
    for _ in range(4000):
        texts.append("".join(draw.choice(pieces) for _ in range(draw.randint(1, 8))))
        texts.append(marks("".join(draw.choice(pieces) for _ in range(draw.randint(1, 8)))))
        texts.append("".join(draw.choice("aeinrst  el\n") for _ in range(draw.randint(1, 30))))
    for stretch in (sp.STRETCH, 7):
        monkeypatch.setattr(sp, "STRETCH", stretch)
        for text in texts:
            ids = codec.ids(text)
            assert ids.tolist() == codec.model.encode(text), text
            assert codec.text(ids) == codec.model.decode(ids.tolist())


def test_compatible_pairs_are_those_that_merging_keeps(codec):
    draw = random.Random(6)
    ids = list(codec.piece)
    for n in range(20_000):
        left, right = draw.choice(ids), draw.choice(ids)
        if n % 2:
            right = codec.id.get(codec.piece[left][-1 - n % 3 :], right)
        both = [codec.piece[left], codec.piece[right]]
        assert codec._goes((left, right)) == (sp.merged("".join(both), codec.score) == both)


def test_backtracking_takes_pieces_back(codec):
    """Somewhere the longest piece is not the one that merging makes, and a position has failed."""
    words = ["".join(random.Random(n).choices("abcdefghinorst", k=12)) for n in range(500)]
    longest_first = 0
    for word in words:
        ids, at, greedy = codec.ids(word).tolist(), 0, []
        whole = sp.MARK + word
        while at < len(whole):
            size = max(k for k in range(1, 17) if whole[at : at + k] in codec.id)
            greedy.append(codec.id[whole[at : at + size]])
            at += size
        longest_first += greedy == ids
    assert longest_first < len(words)


def test_memory_is_bounded(codec):
    small = sp.PieceCodec(sp.model_path(), remember=10)
    texts = [f"word{n} other{n % 7}\nline{n}" for n in range(200)]
    assert all((small.ids(t) == codec.ids(t)).all() for t in texts)
    assert max(len(c) + len(c.older) for c in (small.bare, small.marked, small.goes)) <= 40


def test_encode_and_decode_frames(spark, codec):
    df = spark.createDataFrame([("a", "two words", 1), ("b", None, 2), (None, "x", 3)], "ids string, text string, key int")
    rows = sp.encode(df, key="ids").collect()
    assert {r["ids"]: r[1] for r in rows} == {"a": codec.model.encode("two words"), "b": [], None: codec.model.encode("x")}
    back = sp.decode(sp.encode(df.drop("ids"), key="key"), key="key").collect()
    assert {r.key: r.decoded for r in back} == {1: "two words", 2: "", 3: "x"}
    assert np.asarray(codec.ids(None)).size == 0
