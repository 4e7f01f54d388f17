"""SuperMinHash: signatures against the sequential algorithm, groups against brute force."""

import random

import numpy as np
import pytest

from tests.llm.test_jaccard import brute, near
from weblode.llm import superminhash
from weblode.llm.blocks import mix
from weblode.llm.groups import joined_by, with_group
from weblode.llm.superminhash import SLOTS, near_duplicates, signatures

SCHEMA = "doc_id long, text string, n int, label string, signature string, size int"


def one_by_one(elements):
    """Signature of one set, element by element, with a permutation of each."""
    out = [None] * SLOTS
    for e in elements:
        order = list(range(SLOTS))
        for step in range(SLOTS):
            drawn = int(mix(np.array([e], np.uint64) ^ superminhash._LEVEL[step])[0])
            pick = step + ((drawn & 0xFFFFFF) * (SLOTS - step) >> 24)
            order[step], order[pick] = order[pick], order[step]
            value = step << 40 | drawn >> 24
            out[order[step]] = value if out[order[step]] is None else min(out[order[step]], value)
    return out


def test_signatures():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 3, 7, 40, 128, 300, 900)]
    got = signatures([sets[0], np.empty(0, np.uint64), *sets[1:]])
    assert (got[1] == np.iinfo(np.uint64).max).all()
    assert [got[i].tolist() for i in (0, 2, 3, 4, 5, 6, 7, 8)] == [one_by_one(s.tolist()) for s in sets]
    assert signatures([]).shape == (0, SLOTS)


def test_estimate_has_the_mean_and_less_than_the_variance_of_independent_slots():
    rng = np.random.default_rng(4)
    agree = []
    for _ in range(400):
        every = rng.integers(0, 2**63, 30, dtype=np.uint64)
        x, y = signatures([every[:26], every[4:]])
        agree.append((x == y).mean())
    j = 22 / 30
    assert abs(np.mean(agree) - j) < 0.01 and np.var(agree) < 0.8 * j * (1 - j) / SLOTS


def answer(spark, docs, k, percent):
    got = near_duplicates(spark.createDataFrame([(*d, 1, "x", "y", 3) for d in docs], SCHEMA), k, percent).collect()
    assert all(r.kept == (r.doc_id is not None and r.component_id == r.doc_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


@pytest.mark.parametrize("k,percent", [(4, 80), (5, 90)])
def test_against_brute_force(spark, k, percent):
    rng = random.Random(k)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 30, 120, 300]))] for _ in range(12)]
    docs = [(i, near(rng, base[rng.randrange(12)], rng.choice([0, 0, 1, 2, 3, 5, 9]))) for i in range(150)]
    assert answer(spark, docs, k, percent) == brute(docs, k, percent)


def test_a_large_group_of_near_copies_a_chain_and_a_common_passage(spark):
    rng = random.Random(1)
    base, passage = [f"w{i}" for i in range(200)], [f"p{i}" for i in range(60)]
    docs = [(i, near(rng, base, 1 + i % 8)) for i in range(150)]
    docs += [(1000 + i, " ".join(f"c{j}" for j in range(6 * i, 6 * i + 120))) for i in range(10)]
    docs += [(2000 + i, " ".join([*passage, *(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 40)))])) for i in range(80)]
    assert answer(spark, docs, 4, 80) == brute(docs, 4, 80)


def test_odd_rows(spark):
    long = " ".join(f"l{i % 977} m{i % 1009}" for i in range(40000))
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one"), (6, "one"), (7, long), (8, long + " x"),
            (None, "one two"), (None, None), (9, "é A\x0bb c"), (10, "é a b C"), (11, "É a b c"), (-3, long),
            (20, "a b c d e f g h i j"), (21, "a b c d e f g h i j"), (21, "q w e r t y u i o p a s d f g h j k l"), (22, "q w e r t y u i o p a s d f g h j k")]
    assert answer(spark, docs, 4, 80) == brute(docs, 4, 80)


def test_empty_table(spark):
    assert answer(spark, [], 4, 80) == []


def test_percent_below_the_bands(spark):
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame([], SCHEMA), 4, 70)


def test_groups_with_a_heavy_key(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(6000)], "g long, i long")
    groups = rows.groupBy("g").count()
    got = with_group(rows, groups, ["g"], "count")
    assert got.count() == 6000 and got.filter("g = 0").select("count").distinct().collect()[0][0] == 4001
    dealt = joined_by(rows, groups, "g", "i")
    assert dealt.count() == 6000 and sorted(dealt.columns) == ["count", "g", "i"]
    assert joined_by(rows.limit(0), groups, "g", "i").count() == 0 and with_group(rows.limit(0), groups.limit(0), ["g"], "count").count() == 0
