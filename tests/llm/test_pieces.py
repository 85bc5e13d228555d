"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagetide.llm import pieces

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "   ", "▁", " ▁ a", "\0", "a\0b", "\n\n\t x", "日本語 テキスト 😀", "aaaa" * 3000, "x" * 20000, " " * 5000, " " * 37 + "a", "the  the   the", "<s> </s> <unk> <0x41>", "�", "é" * 3000, "İ ΑΣ", "1234567 -- 0.5"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces.of(pieces.model_path())


@given(st.one_of(st.text("abehinrst  ▁.,'1é\n中😀", max_size=60), st.text(st.characters(exclude_categories=("Cs",)), max_size=40)))
@settings(max_examples=500, deadline=None)
def test_encoding_equals_the_library(library, own, text):
    ids = library.encode(text)
    assert own.encode(text) == ids and own.decode(ids) == library.decode(ids)


def test_any_ids_decode_as_in_the_library(library, own):
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < 0.4 else rng.randrange(262) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == library.decode(ids)


def test_long_words_and_words_together(library, own):
    rng = random.Random(4)
    long = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("abehinrst", 60_000), ("ab", 5000), (" ", 40_000), ("é中", 3000))]
    for text in long:
        assert own.encode(text) == library.encode(text)
    words = ["".join(rng.choice("abehinrstéß'1 ") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    assert [x.tolist() for x in pieces.cut(*own.encode_words(words))] == [own.encode_words([w])[0].tolist() for w in words]
    assert [x.tolist() for x in own.encode_words([])] == [[], []]


def test_columns_of_ids_and_texts(spark, library):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)], "doc_id long, text string, word string")
    got = pieces.decode(pieces.encode(df, pieces.model_path()), pieces.model_path(), text="again").orderBy("doc_id").collect()
    for r, t in zip(got, ODD, strict=True):
        assert r["ids"] == library.encode(t or "") and r["again"] == library.decode(r["ids"]) and r["word"] == "clash"
    assert pieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), pieces.model_path()).collect() == [(None, ""), ([], "")]


def same_as(library, rows, got):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_query_equals_the_library(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same_as(library, rows, pieces.op11_pieces(spark, SF).collect())


def test_odd_repeated_and_no_rows(spark, library):
    rows = [*enumerate(ODD), (3, "again"), (3, "again"), (None, "x")]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, n_tokens double")
    same_as(library, rows, pieces.digests(df, pieces.model_path()).collect())
    assert pieces.digests(df.limit(0), pieces.model_path()).collect() == []


def test_words_outlive_a_full_cache(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    words = pieces.Words(pieces.model_path())
    for text in ("a b c d e f", "a b x y z q", "f e d c b a", "b b b"):
        assert next(words.texts([text])) == (",".join(map(str, library.encode(text))), text)
