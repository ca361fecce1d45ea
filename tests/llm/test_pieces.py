"""The piece encoder against the library itself, text by text and through Spark."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shoal.llm import pieces
from shoal.llm.registry import QUERIES

PARTS = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "▁", "é", "ß", "你", "好", "梦", "😀", "‍", "\x00", "<s>", "<0x0A>", "</s>", "<unk>", "1", "20", "ﬁ", "A", "The", "Ж", "ع", "�", "\r\n", "　", "\xa0", ".", ",", "==", "----", "////", " " * 17]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def same(library, text):
    model, ids = pieces.pieces(), library.encode(text)
    assert model.encode(text) == ids
    assert model.decode(ids) == library.decode(ids)
    joined = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert model.digest(text) == (len(ids), joined, hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_texts_of_odd_parts(library):
    rng = random.Random(8)
    for _ in range(4000):
        same(library, "".join(rng.choice(PARTS) for _ in range(rng.randrange(25))))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    same(library, text)


def test_decoding_any_ids(library):
    rng = random.Random(9)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(1, 32_000), rng.randrange(3, 259), 259]) for _ in range(rng.randrange(9))]
        assert pieces.pieces().decode(ids) == library.decode(ids)


def test_one_long_stretch_and_long_runs(library):
    rng = random.Random(10)
    same(library, "".join(rng.choice("abcdefgh") for _ in range(50_000)))
    same(library, " " * 3001 + "x" * 3001 + "\n" * 300 + "你" * 1000)


def test_bounded_tables_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_STRETCHES", 7)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 5)
    rng = random.Random(11)
    for _ in range(200):
        same(library, " ".join(rng.choice(["over", "under", "unaware", "ware.", "\nnew", "stop"]) for _ in range(30)))


def test_query_on_odd_rows(spark, library, tmp_path):
    texts = [None, "", " ", "a", "a b  c\n", "你好" * 4000, "x y " * 20_000, "same", "same"]
    rows = [(None if k == 3 else min(k, 7), t, "z", "z") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    have = QUERIES["op12_piece_encoding"](spark, str(tmp_path)).collect()
    want = []
    for (doc_id, *_), t in zip(rows, texts, strict=True):
        ids = library.encode(t or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, have), key=key) == sorted(want, key=key)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op12_piece_encoding"](spark, f"{tmp_path}/none").collect() == []
    assert pieces.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")).where("doc_id = 4").first()["decoded"] == "a b  c\n"
