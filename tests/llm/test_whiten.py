"""Whitening against whole-number and numpy brute force."""

import math
import random

import numpy as np
import pytest

from weblode.llm.whiten import fit, identity_error, whiten

SCHEMA = "vec_id long, embedding array<float>, vector string, whitened int, k0 string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA)


def usable(rows, dims):
    return [(i, v) for i, v in rows if v and len(v) == dims and all(e is not None and math.isfinite(e) for e in v)]


def grid(v):
    return [math.floor(1024 * float(np.float32(e))) + 100000 for e in v]


def check(spark, rows, dims, k=8):
    vectors = frame(spark, rows)
    model = fit(vectors)
    fine = usable(rows, dims)
    x = [grid(v) for _, v in fine]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    assert model.n == n and model.sums == sums
    d = [[n * e - s for e, s in zip(row, sums)] for row in x]
    v = np.array([[sum(r[i] * r[j] for r in d) / n**3 for j in range(dims)] for i in range(dims)])
    values = np.linalg.eigvalsh(v)[::-1]
    m = len(model.eigenvalues)
    assert np.allclose(model.eigenvalues, values[:m], rtol=1e-9) and np.all(values[m:] <= values[0] * 1e-9)
    assert np.allclose(model.explained, values[:m] / v.trace(), rtol=1e-9)
    for e, axis in zip(model.eigenvalues, model.components):
        assert np.allclose(v @ axis, e * axis, atol=values[0] * 1e-9) and math.isclose(axis @ axis, 1, rel_tol=1e-12)
    white = whiten(vectors, model, ["vec_id", "vector"], k=k)
    got = sorted(((r[0], r[1], int(r[2]), tuple(r[3])) for r in white.collect()), key=str)
    few = min(k, m)
    want = [(i, "x", sum(e * e for e in row), (np.array(row) / n) @ (model.components[:few].T / np.sqrt(model.eigenvalues[:few]))) for (i, _), row in zip(fine, d)]
    want.sort(key=lambda r: str((r[0], r[1], r[2], tuple(r[3]))))
    by = lambda rows: sorted((str(r[0]), r[2]) for r in rows)
    assert by(got) == by(want)
    for r in got:
        assert any(r[0] == w[0] and r[2] == w[2] and np.allclose(r[3], w[3], atol=1e-9) for w in want)
    assert identity_error(white, few) < 1e-9
    return model


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(12)]
    rows = []
    for i in range(300):
        z = [rng.gauss(0, 1) for _ in range(12)]
        rows.append((i, [0.3 + sum(b * e for b, e in zip(col, z)) for col in base]))
    assert len(check(spark, rows, 12).eigenvalues) == 12


def test_odd_rows(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1), rng.uniform(-9, 9), -1000.0 + rng.random()]) for i in range(60)]
    rows += [(None, [0.5, 0.25, 1.0]), (3, [0.5, 0.25, 1.0]), (3, [0.5, 0.25, 1.0]), (70, None), (71, []), (72, [1.0, None, 2.0]), (73, [1.0, float("nan"), 2.0]),
             (74, [float("inf"), 0.0, 0.0]), (75, [1.0, 2.0]), (76, [0.0, 1e30, 0.0])]
    rows_small = [(i, v if v is None or all(e is None or abs(e) < 2**19 or not math.isfinite(e) for e in v) else None) for i, v in rows]
    assert frame(spark, rows).count() == len(rows)
    model = check(spark, rows_small, 3)
    assert fit(frame(spark, rows)).n == model.n


def test_fewer_directions_than_dimensions(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), float(i % 3)]) for i in range(42)]
    assert len(check(spark, rows, 3).eigenvalues) == 2


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    vectors = frame(spark, rows)
    model = fit(vectors)
    white = whiten(vectors, model, ["vec_id"])
    assert len(model.eigenvalues) == 0 and [r.whitened for r in white.collect()] == [[] for r in rows if r[1]]
    assert identity_error(white, 0) == 0.0


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [(-1.0) ** i * 400_000.0, float(i)]) for i in range(200)]
    model = check(spark, rows, 2)
    assert max(int(r.deviation) for r in whiten(frame(spark, rows), model, ["vec_id"]).collect()) > 2**63 // 1000
