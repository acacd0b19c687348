"""Whitening against plain numpy, and its eigenvectors against exact arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from funnelforge.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component int"


def frame(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, "x", 7) for i, v in enumerate(vectors)], SCHEMA).repartition(parts)


def brute(vectors, top=8):
    """Exact sums by Python's integers, eigenvectors by LAPACK in double precision."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    away = [[n * c - s for c, s in zip(row, sums, strict=True)] for row in x]
    centred = np.array(away, float) / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    return n, [sum(a * a for a in row) for row in away], centred @ vecs[:, :top] / np.sqrt(values[:top]), values[:top] / values.sum()


def gathered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def check(found, vectors, kept=None):
    n, deviation, white, explained = brute(vectors)
    ids = kept or list(range(len(vectors)))
    assert set(found) == set(ids)
    for at, i in enumerate(ids):
        assert sorted(found[i]) == list(range(1, white.shape[1] + 1))
        for r in found[i].values():
            assert r["n"] == n and r["deviation"] == deviation[at]
            assert abs(r["explained"] - explained[r["component"] - 1]) < 1e-9
            assert r["identity_error"] < 1e-9
    for c in range(white.shape[1]):
        got = np.array([found[i][c + 1]["whitened"] for i in ids])
        sign = np.sign(got @ white[:, c])
        assert np.abs(got * sign - white[:, c]).max() < 1e-6


def test_whitening_equals_numpy_on_the_table(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    found = gathered(whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    check(found, t["embedding"], t["vec_id"])


def test_whitening_drops_broken_vectors_and_fills_short_ones(spark):
    rng = np.random.default_rng(5)
    good = [list(map(float, v)) for v in rng.normal(size=(40, 4)) * [3, 1, 0.5, 0.1]]
    bad = [None, [1.0, None, 2.0, 3.0], [float("nan"), 0.0, 0.0, 0.0], [0.0, float("inf"), 0.0, 0.0]]
    found = gathered(whitening.whitened(frame(spark, good + bad + [[0.5, -0.25], []])))
    full = good + [[0.5, -0.25, 0.0, 0.0], [0.0] * 4]
    check(found, full, [*range(40), 44, 45])


def test_whitening_of_repeats_constants_and_nothing(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [None, [None]])).count() == 0
    assert whitening.whitened(frame(spark, [[]])).count() == 0
    one = whitening.whitened(frame(spark, [[1.0, 2.0]])).collect()
    assert [(r["component"], r["whitened"], r["deviation"], r["explained"], r["identity_error"]) for r in sorted(one, key=lambda r: r["component"])] == [(1, None, 0, 0.0, 0.0), (2, None, 0, 0.0, 0.0)]
    flat = gathered(whitening.whitened(frame(spark, [[1.0, 5.0, 2.0]] * 30 + [[2.0, 5.0, 1.0]] * 10)))
    assert all(r[2]["whitened"] is None and r[3]["whitened"] is None and r[1]["identity_error"] < 1e-12 for r in flat.values())
    assert abs(flat[0][1]["explained"] - 1) < 1e-12 and len({round(abs(flat[i][1]["whitened"]), 9) for i in range(30)}) == 1


def test_whitening_is_exact_for_far_entries(spark):
    far = [[1e30, 0.0], [-1e30, 0.5], [0.0, 1.0], [1.0, 1.0]]
    found = gathered(whitening.whitened(frame(spark, far)))
    assert all(found[i][1]["deviation"] is None for i in (0, 1)) and found[0][1]["identity_error"] < 1e-6
    near = gathered(whitening.whitened(frame(spark, [[2.0e5, 0.0], [-2.0e5, 0.5], [0.0, 1.0]])))
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in ([2.0e5, 0.0], [-2.0e5, 0.5], [0.0, 1.0])]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert [near[i][1]["deviation"] for i in range(3)] == [sum((3 * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]


def test_whitening_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    vectors = [list(map(float, v)) for v in rng.normal(size=(300, 12))]
    runs = [gathered(whitening.whitened(frame(spark, vectors, k))) for k in (1, 7)]
    assert all(runs[0][i][c]["whitened"] == runs[1][i][c]["whitened"] for i in range(300) for c in range(1, 9))


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 5], [1, 1 + 1e-9, 1 + 2e-9, 5, 7], [2, 2, 2, 3, 3], [0, 0, 0, 0, 4], [1e-12, 1, 1 + 1e-14, 1e6, 1e6 + 1e-3]])
def test_refined_vectors_of_clustered_values(values):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(5, 5)))[0].astype(whitening.WIDE)
    for _ in range(4):  # orthogonal beyond double precision
        q = q + q @ (np.eye(5) - q.T @ q) / 2
    a = q @ np.diag(np.array(values, whitening.WIDE)) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.eigenvectors(a)
    size = max(values)
    assert np.abs(got - np.array(sorted(values), whitening.WIDE)).max() < 1e-17 * size
    assert np.abs(x.T @ x - np.eye(5)).max() < 1e-17
    assert np.abs(a @ x - x * got).max() < 1e-17 * size


def test_refined_vectors_are_those_of_exact_arithmetic():
    """The 2 by 2 matrix [[a, b], [b, c]] has vectors that one square root gives."""
    a, b, c = Fraction(3), Fraction(1, 1 << 30), Fraction(3) + Fraction(1, 1 << 31)
    half = (a - c) / 2
    root = math.isqrt(int((half * half + b * b) * (1 << 400)))
    upper = half + Fraction(root, 1 << 200)
    slope = float(upper / b)
    _, x = whitening.eigenvectors(np.array([[a, b], [b, c]], dtype=object).astype(float).astype(whitening.WIDE))
    assert abs(float(x[0, 1] / x[1, 1]) - slope) < 1e-15 * abs(slope)
