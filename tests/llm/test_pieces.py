"""Pieces against the library's own answer, and round trips."""

import os
import random

import pytest
import sentencepiece

from weblode.llm.pieces import MODEL, Vocabulary, decode, encode, lattice

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")

ODD = [None, "", " ", "a", "  two  spaces ", "\n\n", "tab\tx\r\n", "日本語テスト 😀 é", "x" * 300, "ab" * 200, " " * 90 + "b", "\x00z", "==== ==== ====",
       "the " * 3000, "Ünïcode Straße", "don't", "1234567890", "a b", "\x0b\x0c"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("dictionary", [1 << 19, 5, 0])
def test_like_the_library(spark, library, dictionary):
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(ODD)], "doc_id long, text string, n_pieces int, word string")
    out = encode(docs, check=True, dictionary=dictionary)
    assert out.columns == ["doc_id", "word", "n_pieces", "pieces", "round_trip"]
    rows = out.collect()
    for r in rows:
        text = ODD[r.doc_id]
        if text is None:
            assert r.pieces is None and r.n_pieces is None and r.round_trip is None
        else:
            assert r.pieces == library.encode(text) and r.n_pieces == len(r.pieces) and r.round_trip
    assert {r.doc_id: r.text for r in decode(out).collect()} == dict(enumerate(ODD))


def test_random_words_by_lattice_and_by_fold(spark, library):
    rng = random.Random(6)
    vocabulary = Vocabulary()
    some = rng.sample(sorted(vocabulary.id), 400)
    words = {"▁" * rng.randrange(2) + "".join(rng.choices(some, k=rng.randrange(1, 5)))[:60].replace("▁", "") for _ in range(300)} - {"", "▁"}
    words |= {"▁" * n for n in (1, 2, 7, 17, 60)}
    got = {r.word: r.ids for r in lattice(spark.createDataFrame([(w,) for w in words], "word string"), vocabulary.rows(spark), vocabulary.longest, vocabulary.bytes).collect()}
    assert set(got) == words
    for w in words:
        assert got[w] == vocabulary.fold(w), w
        if len(w) > 1 and w.startswith("▁") and w.count("▁") == 1:
            assert got[w] == library.encode(w[1:]), w


def test_repeated_rows_empty_table_and_foreign_ids(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text")], "doc_id long, text string")
    assert len({tuple(r.pieces) for r in encode(docs).collect()}) == 1
    assert encode(docs.limit(0)).collect() == []
    odd = spark.createDataFrame([([-1, 10**6, None],), ([],), (None,)], "pieces array<int>")
    assert [r.text for r in decode(odd).collect()] == ["", "", None]
