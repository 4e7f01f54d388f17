"""Fill-in-middle against a brute-force version, and its word arithmetic against plain Python."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weblode.llm.infill import Marks, as_words, fill_in_middle, lead_marks, newline_marks, restored

SCHEMA = "doc_id long, text string, n int, form string, output string, h1 long"


def brute(doc_id, text, seed=7, fim=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def check(spark, docs, **how):
    made = fill_in_middle(spark.createDataFrame([(*d, 1, "x", "y", 2) for d in docs], SCHEMA), **how)
    got = sorted((tuple(r) for r in made.collect()), key=str)
    names = dict(seed=how.get("seed", 7), fim=how.get("fim_percent", 100), spm=how.get("spm_percent", 50))
    assert got == sorted((brute(*d, **names) for d in docs), key=str)
    back = made.select("doc_id", restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted(((i, t or "") for i, t in docs), key=str)
    return got


TEXTS = ["one", "\n", "\n\n\n", "a\nb\nc", "a\nb\nc\n", "é\nüü\n漢字\n😀😀\n" * 9, "x<\nS>\ny<", "<P\n<S\n<M\n", "with <S> mark\nz", "<<S\n>" * 7, "\r\n \n\x85",
         "eight88\n" * 40, "\n" * 777, "q" * 4001]


def test_against_brute_force(spark):
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(40 * len(TEXTS))]
    got = check(spark, docs)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    check(spark, docs[:100], seed=8, fim_percent=40, spm_percent=10)


def test_odd_rows(spark):
    long = "".join(f"line {i} é\n" for i in range(150_000))
    check(spark, [(None, None), (None, "a\nb"), (1, None), (1, ""), (2, "same\ntwice"), (2, "same\ntwice"), (3, long), (4, "y" * 3_000_000), (-5, "a\n\nb")])


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200))
def test_marks(raw):
    data = np.frombuffer(raw, np.uint8)
    words = as_words(data)
    lines, leads = Marks(newline_marks(words)), Marks(lead_marks(words))
    at = np.arange(len(raw) + 1)
    places = [i for i, b in enumerate(raw) if b == 10]
    assert lines.rank(at).tolist() == [raw[:i].count(b"\n") for i in at]
    assert leads.rank(at).tolist() == [sum(b & 0xC0 != 0x80 for b in raw[:i]) for i in at]
    assert lines.select(np.arange(len(places))).tolist() == places
