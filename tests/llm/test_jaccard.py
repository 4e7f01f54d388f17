"""Jaccard join and components against brute force."""

import random

import pytest

from weblode.llm.components import components
from weblode.llm.jaccard import jaccard_components

SCHEMA = "doc_id long, text string, n int, label string, shingle string"


def shingles(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute(docs, k, percent):
    sets = {}
    for i, text, *_ in docs:
        sets.setdefault(i, []).append(shingles(text, k))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(((i, len(shingles(t, k)), find(i) if i is not None else None) for i, t, *_ in docs), key=str)


def answer(spark, docs, k, percent):
    got = jaccard_components(spark.createDataFrame([(*d, 1, "x", "y") for d in docs], SCHEMA), k, percent)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str)


def near(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"z{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_against_brute_force(spark, k, percent):
    rng = random.Random(k)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 30, 120, 300]))] for _ in range(12)]
    docs = [(i, near(rng, base[rng.randrange(12)], rng.choice([0, 0, 1, 2, 3, 5, 9]))) for i in range(150)]
    assert answer(spark, docs, k, percent) == brute(docs, k, percent)


def test_a_large_group_of_near_copies_and_a_chain(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    docs = [(i, near(rng, base, 1 + i % 4)) for i in range(120)]
    docs += [(1000 + i, " ".join(f"c{j}" for j in range(6 * i, 6 * i + 200))) for i in range(8)]
    assert answer(spark, docs, 3, 90) == brute(docs, 3, 90)


def test_odd_rows(spark):
    long = " ".join(f"l{i % 977}" for i in range(30000))
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one"), (6, "one"), (7, long), (8, long + " x"),
            (None, "one two"), (None, None), (9, "é A\x0bb c"), (10, "é a b C"), (11, "É a b c"), (-3, long)]
    assert answer(spark, docs, 3, 90) == brute(docs, 3, 90)


def test_empty_table(spark):
    assert answer(spark, [], 3, 90) == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 200), (300, 301), (301, 300), (301, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 300: 300, 301: 300}
