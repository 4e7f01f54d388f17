"""Exact dedup against brute force."""

import hashlib
import re

from weblode.llm.exact import exact_dedup, exact_groups

DOCS = [(1, "a b"), (2, "ab"), (3, "a b"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (7, "x" * 50000), (8, "x" * 49999 + " x"), (9, "ab"),
        (2, "ab"), (None, "ab "), (None, "q"), (10, "é"), (11, "é"), (12, "p" * 64 + "1"), (13, "p" * 64 + "2"), (14, "p" * 64 + " 2")]


def brute(docs):
    groups = {}
    for i, (doc_id, text) in enumerate(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, i, doc_id))
    out = []
    for bare, rows in groups.items():
        best = min(rows)
        out += [(r[4], best[4], len(rows), r[4] == best[4], hashlib.sha256(bare.encode()).hexdigest()) for r in rows]
    return out


def frame(spark, docs):
    return spark.createDataFrame([(*d, "clash", 5) for d in docs], "doc_id long, text string, head string, length int")


def test_against_brute_force(spark):
    got = [tuple(r) for r in exact_groups(frame(spark, DOCS), digests=True).collect()]
    want = brute(DOCS)
    drop = lambda rows: sorted((r[:3] + r[4:] for r in rows), key=str)
    assert drop((r.__class__((r[0], r[1], r[2], r[3], r[4])) for r in got)) == drop(want)
    kept = [r for r in got if r[3]]
    assert len(kept) == len({r[4] for r in got}) and all(r[0] == r[1] for r in kept)


def test_full_hashes_only_where_needed(spark):
    got = {r.doc_id: r.full_hash for r in exact_groups(frame(spark, [d for d in DOCS if d[0]])).collect()}
    assert got[1] and got[12] and got[13] and got[10] is None and got[11] is None


def test_rows_that_stay(spark):
    docs = [(1, "a b"), (2, "ab"), (3, "c"), (4, None), (5, "")]
    assert sorted(r.doc_id for r in exact_dedup(frame(spark, docs)).collect()) == [1, 3, 4]


def test_empty_table(spark):
    assert exact_groups(frame(spark, [])).collect() == []
