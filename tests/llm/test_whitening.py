"""Whitened components: contour integration against numpy's decomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from rankmix.llm import spectrum, whitening

SF = "/root/testdata/sf0.001"
SPECTRA = {"spread": np.linspace(1, 64, 64), "scales": np.concatenate([[1e6, 1e5, 10, 1], np.full(60, 1e-3)]),
           "equal": np.full(20, 5.0), "rank 2": np.concatenate([[3.0, 2.0], np.zeros(30)]), "one": np.ones(1),
           "close": np.concatenate([[100, 100 - 1e-7, 50, 50 - 1e-7, 50 - 2e-7], np.linspace(0, 1, 40)]),
           "negative": np.array([4.0, 3.0, 0.5, -1.0, -20.0])}


def _matrix(values):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(values),) * 2))
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("name", SPECTRA)
def test_leading_components(name):
    a = _matrix(SPECTRA[name])
    e, u = np.linalg.eigh(a)
    e, u = e[::-1], u[:, ::-1]
    values, vectors = spectrum.leading_components(a, 4)
    k = len(values)
    assert k == min(4, int((e > 1e-12 * e[0]).sum()))
    assert np.allclose(values, e[:k], rtol=1e-9, atol=1e-13 * e[0])
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * np.abs(e).max()


@pytest.mark.parametrize("name", SPECTRA)
def test_inertia(name):
    a = _matrix(SPECTRA[name])
    e = np.linalg.eigvalsh(a)
    shifts = np.concatenate([(e[1:] + e[:-1])[np.diff(e) > 1e-6] / 2, [e[0] - 1, e[-1] + 1]])
    got = spectrum.counts_above(*spectrum.tridiagonal(a), shifts)
    assert got.tolist() == [int((e > s).sum()) for s in shifts]


def test_no_matrix():
    assert [len(x) for x in spectrum.leading_components(np.zeros((3, 3)), 4)] == [0, 3]
    assert spectrum.leading_components(np.zeros((0, 0)), 4)[0].size == 0


def _brute(rows, k=4):
    """Rows (id, vector) -> {(row number, component): (n, deviation, |whitened|, explained)}."""
    ok = [(i, [math.floor(256.0 * float(np.float64(c))) for c in v]) for i, v in rows
          if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in ok:
        c = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        for j in range(min(k, int((e > 1e-12 * e[0]).sum()))):
            out.append((i, j + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), c @ u[:, j] / math.sqrt(e[j]), e[j] / e.sum()))
    return out


def _check(spark, rows, schema="vec_id long, embedding array<float>"):
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = sorted(whitening.whitened_components(df).collect(), key=lambda r: (str(r.vec_id), r.component, r.deviation, r.whitened))
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in df.collect()]
    want = _brute(rows)
    by = {}
    for r in got:
        by.setdefault((str(r.vec_id), r.component), []).append(r)
    assert len(got) == len(want)
    sign = {}
    for i, j, n, dev, w, explained in want:
        r = min(by[str(i), j], key=lambda r: (abs(r.deviation - dev), abs(abs(r.whitened) - abs(w))))
        assert r.n == n and r.deviation == dev and abs(r.explained / explained - 1) < 1e-9 and r.identity_error < 1e-8
        if abs(w) > 1e-6:
            assert sign.setdefault(j, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert abs(abs(r.whitened) - abs(w)) < 1e-8 * (1 + abs(w))


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    _check(spark, rows)


def test_unusable_vectors_repeats_and_nulls(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=5) * [9, 5, 3, 2, 1]]) for i in range(40)]
    rows += rows[:7] + [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [1.0, float("nan"), 2.0, 3.0, 4.0]),
                        (103, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (None, rows[3][1]), (7, rows[9][1]), (105, [-0.0] * 5), (106, [0.0] * 5)]
    _check(spark, rows)
    # lengths that few rows have, empty vectors, clashing columns
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, id int, x string")
    more = spark.createDataFrame([(200, [1.0, 2.0], 1, "x"), (201, [], 1, "x")], df.schema)
    assert sorted(map(str, whitening.whitened_components(df.union(more)).drop("whitened", "explained", "identity_error").collect())) == sorted(
        map(str, whitening.whitened_components(df).drop("whitened", "explained", "identity_error").collect()))


def test_large_entries(spark):
    """Sums of squares beyond 64 bits have no deviation; the rest stays exact."""
    rows = [(i, [float(2 ** 40 * ((i * 7) % 11) + i), float(i % 5), float(i % 3)]) for i in range(30)]
    got = whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} >= {1} and all(r.deviation is None for r in got)
    assert all(abs(r.identity_error) < 1e-4 for r in got)


def test_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened_components(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened_components(spark.createDataFrame([(1, None)], schema)).collect() == []
    assert whitening.whitened_components(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
