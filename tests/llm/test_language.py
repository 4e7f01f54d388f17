"""Rank-order profiles against a plain implementation, and held-out accuracy."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weblode.llm.language import PROFILE, Profiles, held_out, learn, ngrams, predict, top

SF = "/root/testdata/sf0.001"


def plain(text):
    counts, word = Counter(), ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
            continue
        if word:
            padded = f"_{word}_"
            counts.update(word)
            for n in (2, 3):
                counts.update(padded[i:i + n] for i in range(len(padded) - n + 1))
        word = ""
    return counts


def pack(gram):
    code = 0
    for c in gram:
        code = code << 21 | ord(c)
    return code


@pytest.mark.parametrize("text", ["Hello, world", "a", "a b", "  x-y  zz", "Ünïcode ßtraße 東京 x", "don't stop", "aa aa aa"])
def test_ngrams(text):
    grams, counts = ngrams(text)
    assert dict(zip(grams.tolist(), counts.tolist())) == {pack(g): n for g, n in plain(text).items()}
    order = sorted(((-n, pack(g)) for g, n in plain(text).items()))
    assert top(grams, counts, 4).tolist() == [g for _, g in order[:4]]


def test_out_of_place():
    profiles = Profiles([("aa", [pack("x"), pack("y")]), ("bb", [pack("y"), pack("x")])])
    lang, score = profiles.predict("x x y")
    mine = top(*ngrams("x x y")).tolist()
    far = sum(abs([pack("x"), pack("y")].index(g) - i) if g in (pack("x"), pack("y")) else PROFILE for i, g in enumerate(mine))
    assert lang == "aa" and score == pytest.approx(1 - far / (PROFILE * len(mine)))


def test_odd_rows_and_nothing_learned(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 !?", 1), (None, "word", 1), (5, "word", 1), (5, "word", 1), (6, "long word " * 30000, 1)],
                                 "doc_id long, text string, score int")
    got = {(r.doc_id, r.lang_pred, r.score) for r in predict(docs, []).collect()}
    assert got == {(i, "und", 0.0) for i in (1, 2, 3, None, 5, 6)}
    some = {r.doc_id: r.lang_pred for r in predict(docs, [("xx", [pack("w")])]).collect()}
    assert some == {1: "und", 2: "und", 3: "und", None: "xx", 5: "xx", 6: "xx"}
    assert predict(docs.limit(0), []).collect() == []
    assert learn(spark.createDataFrame([(1, None, "en"), (2, "x", None)], "doc_id long, text string, lang string")) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = predict(docs, learn(docs.filter(~held_out(F.col("doc_id"))))).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out(F.col("doc_id")))
    right = found.filter("lang = lang_pred").count() / found.count()
    assert right >= 0.9, right
