"""Whitening against exact integers and numpy's own eigenvectors."""

import math
import random

import numpy as np
import pytest

from ledgerleaf.llm import op13_whitening as op

SCHEMA = "vec_id long, embedding array<double>, label int, component string, X string"


def grid(rows):
    out = []
    for i, v, *_ in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            out.append((i, tuple(math.floor(64 * c) + 1_000_000 for c in v)))
    return out


def check(got, rows, components=16):
    points = grid(rows)
    fit = sorted({x for _, x in points})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    a = np.array([[n * v - s for v, s in zip(x, sums, strict=True)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == len(points) * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation, r.n), {})[r.component] = r
    want = {}
    for i, x in points:
        off = [n * v - s for v, s in zip(x, sums, strict=True)]
        want.setdefault((i, sum(o * o for o in off), n), np.array(off, float) / n @ vectors[:, :k] / np.sqrt(values[:k]))
    assert by.keys() == want.keys()
    sign = np.zeros(k)
    for key, w in want.items():
        g = np.array([by[key][c].whitened for c in range(1, k + 1)])
        sign = np.where((sign == 0) & (np.abs(w) > 0.1), np.sign(g * w), sign)
        assert np.allclose(g, sign * w, atol=1e-6) or np.allclose(np.abs(g), np.abs(w), atol=1e-6) and (sign == 0).any()
    for c in range(1, k + 1):
        assert math.isclose(by[next(iter(by))][c].explained, values[c - 1] / values.sum(), rel_tol=1e-8)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-6


def awkward(seed=2, d=20, n=150):
    rng = random.Random(seed)
    scale = [10.0 ** rng.uniform(-1.5, 1.5) for _ in range(d)]
    vecs = [[rng.gauss(0, 1) * s + rng.random() for s in scale] for _ in range(n)]
    rows = [(i, v, 0, "c", "x") for i, v in enumerate(vecs)]
    rows += [(500, None, 0, "c", "x"), (501, [None] + vecs[0][1:], 0, "c", "x"), (502, [math.nan] + vecs[0][1:], 0, "c", "x")]
    rows += [(503, [-math.inf] + vecs[0][1:], 0, "c", "x"), (None, vecs[3], 0, "c", "x"), (504, [], 0, "c", "x")]
    rows += [(600 + i, vecs[5], 0, "c", "x") for i in range(80)]  # one vector again and again
    return rows + [rows[4], rows[4]]


def test_query_against_numpy(spark, tmp_path):
    rows = awkward()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    check(op.op13_whitening(spark, str(tmp_path)).collect(), [r for r in rows])


def test_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check(op.op13_whitening(spark, "/root/testdata/sf0.01").collect(), rows)


def test_fewer_vectors_than_dimensions(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    model, error, width = op.fit(df)
    got = op.whitened(df, model, width, error).collect()
    assert {r.component for r in got} == {1, 2, 3, 4}
    check(got, rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.001, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model, error, width = op.fit(df)
    assert model is None and op.whitened(df, model, width, error).collect() == []


def test_other_lengths_are_left_out(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(20)] + [(100 + i, [float(i)] * 2) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model, error, width = op.fit(df)
    check(op.whitened(df, model, width, error).collect(), rows[:20])


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    d = 10.0 ** -np.arange(12)
    scale = np.diag(np.sqrt(d))
    core = np.eye(12) + 0.05 * (q + q.T)
    values, vectors = op.jacobi(scale @ core @ scale)
    assert np.all(np.diff(values) <= 0) and np.allclose(vectors.T @ vectors, np.eye(12), atol=1e-13)
    from fractions import Fraction

    total = Fraction(1)
    for v in values:
        total *= Fraction(float(v))
    det = np.linalg.det(core) * np.prod(d)
    assert math.isclose(float(total), det, rel_tol=1e-9)


def test_deviations_beyond_64_bits_are_an_error():
    model = op.Whitening(1 << 40, np.array([0]), np.ones((1, 1)), np.ones(1), 1.0)
    with pytest.raises(OverflowError):
        op._deviation(np.array([[1_000_000]]), model)
