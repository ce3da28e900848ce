import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statedit.llm import piece_encoding as E

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = st.sampled_from([" ", "  ", " " * 17, "the", "ing", "tion", "▁", "aa", "aaa", "ab", "0", "12", "é", "ß", "\x00", "\n\n", ".,", "</s>",
                         "<0x0A>", "中文", "😀", "﷽", "é", "\t"])


@pytest.fixture(scope="module")
def model():
    return E.PieceModel(PATH)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(packed):
    return np.frombuffer(packed, np.int32).tolist()


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.lists(PARTS, max_size=14).map("".join), st.text(max_size=30)))
def test_equals_the_library(model, library, text):
    got = ids(model.encode(text))
    assert got == library.encode(text)
    assert model.decode([*got, 2]) == library.decode([*got, 2])


@settings(max_examples=800, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 260), st.sampled_from([28705, 259])), max_size=9))
def test_decodes_any_ids(model, library, some):
    assert model.decode(some) == library.decode(some)


def test_backtracks_and_remembers_failed_positions(model):
    """Long runs without a cut: the pieces equal those of merging the whole."""
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choices(["a", "b", "ab", "er", "es", "ing", "ss", "t"], k=rng.randint(1, 40)))
        assert model.split(text) == model.merge(text)


def test_work_grows_with_the_text(model, library):
    text = "abcdefghij" * 20_000
    assert ids(model.encode(text)) == library.encode(text)


def test_rows(spark, library, monkeypatch):
    monkeypatch.setattr(E, "ROWS", 3)
    texts = [None, "", " ", "Hello there", "Hello there", "x" * 5000, "one\ntwo  three", "æøå ▁ 😀"]
    df = spark.createDataFrame([(k if k else None, t, "no") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = E.decode(E.encode(df, PATH), PATH).collect()
    assert sorted(map(repr, ((r.doc_id, r.ids, r.decoded) for r in out))) == sorted(
        repr((k if k else None, library.encode(t or "") + [2], library.decode(library.encode(t or "") + [2]))) for k, t in enumerate(texts))
    assert E.encode(df.limit(0), PATH).count() == 0
    clash = E.decode(E.encode(df, PATH, end=False).selectExpr("*", "1 AS decoded"), PATH)
    assert clash.columns == ["doc_id", "ids", "decoded"] and clash.where("decoded = 'Hello there'").count() == 2


def test_query(spark, library, tmp_path):
    texts = [(1, "Some text."), (2, None), (3, "More of  it\n")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for k, t in texts:
        i = library.encode(t or "") + [2]
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, i)), library.decode(i))]
        want.append((k, len(i), *sha))
    assert sorted(tuple(r) for r in E.op12_piece_encoding(spark, str(tmp_path)).collect()) == want
