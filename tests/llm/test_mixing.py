"""Targets, apportionment and the mix against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from weblode.llm.mixing import mixture, sainte_lague

SCHEMA = "doc_id long, text string, source string, size int, shard string"


def water(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in stopped]
        left = total - sum(stopped.values())
        share = {n: left * weight[n] / sum(weight[x] for x in free) for n in free}
        above = [n for n in free if share[n] > most * sizes[n]]
        if not above:
            return {**share, **stopped}
        stopped.update({n: most * sizes[n] for n in above})


def frame(spark, docs):
    return spark.createDataFrame([(*d, 3, "clash") for d in docs], SCHEMA)


@pytest.mark.parametrize("shard_words,shard_rows", [(1 << 22, 1 << 15), (500, 20)])
def test_mix(spark, shard_words, shard_rows):
    rng = random.Random(5)
    docs = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.choice([0, 3, 40, 200]))), rng.choice(["a"] * 6 + ["b", "c", "é", "z", None]))
            for i in range(400)]
    docs += [(None, "x y", "a"), (None, None, None), (700, "again and again", "b"), (700, "again and again", "b"), (500, None, "only null")]
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = water(sizes)
    got = mixture(frame(spark, docs), shard_words=shard_words, shard_rows=shard_rows)
    rows = got.join(frame(spark, docs).select("doc_id", "source").distinct(), "doc_id", "left").collect()
    assert got.count() == len(docs)
    taken, shards = {}, 1 + sum(sizes.values()) // shard_words + len(docs) // shard_rows
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id is not None:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
    for r in got.collect():
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    assert sum(taken.values()) <= sum(sizes.values())
    for size, words in taken.items():  # sources of one size count together
        alike = [want[s] for s in sizes if sizes[s] == size]
        assert abs(words - sum(alike)) <= 16 * (1 + shards) * len(alike)
    again = mixture(frame(spark, docs), shard_words=shard_words, shard_rows=shard_rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_sainte_lague_like_seat_by_seat(spark):
    rng = random.Random(2)
    for votes, seats in (([9900] + [40] * 30, 60), ([rng.randrange(0, 999) for _ in range(40)], 37), ([5, 5, 5], 2), ([0, 0], 5), ([7], 0)):
        won = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            won[max(range(len(votes)), key=lambda i: (votes[i] / (won[i] + 0.5) if votes[i] else -1, -i))] += 1
        df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "p int, v long, s long")
        got = {r.p: r.quota for r in sainte_lague(df, "v", "s", ["p"], []).collect()}
        assert [got[i] for i in range(len(votes))] == won


def test_no_words_and_no_rows(spark):
    rows = mixture(frame(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in rows) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mixture(frame(spark, [])).select(F.count("*")).first()[0] == 0


def test_whole_copies(spark):
    """A source's copies come near its target where documents are long, and clashing columns survive the stage."""
    import corpus_pipeline
    from weblode.llm.mixing import whole_copies

    docs = [(i, "w " * 10_000, "a") for i in range(4)] + [(10 + i, "w " * 700, "b") for i in range(30)] + [(50, None, "a"), (51, "", None), (None, "x y z", "c"), (60, "v " * 9, "d")]
    frame = spark.createDataFrame([(*d, 7, 8, "k") for d in docs], "doc_id long, text string, source string, _times int, copies int, copy string")
    mixed = mixture(frame, places=True).collect()
    copies = {r.doc_id: r.copies for r in whole_copies(frame).collect()}
    words = {i: len((t or "").split()) for i, t, _ in docs}
    sources = {i: s for i, _, s in docs}
    for source in {"a", "b"}:
        target = next(r.target for r in mixed if sources[r.doc_id] == source)
        largest = max(words[i] for i in words if sources[i] == source)
        assert abs(sum(words[i] * copies.get(i, 0) for i in words if sources[i] == source) - target) <= largest / 2 + 16
    assert max(copies.values()) <= 3 and not {50, 51} & set(copies)
    out = corpus_pipeline.mixing(spark, frame, "")
    assert out.columns == frame.columns
    rows = [tuple(r) for r in out.collect()]
    assert all(rows.count((*d, 7, 8, "k")) == copies.get(d[0], 0) for d in docs) and len(rows) == sum(copies.values())
    assert corpus_pipeline.mixing(spark, frame.limit(0), "").collect() == []
