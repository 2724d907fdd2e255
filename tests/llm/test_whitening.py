"""Whitening against numpy on the whole covariance, and its edge tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverseed.llm import whitening
from riverseed.llm.whitening import Spectra, eigen_update, secular


def table(spark, rows):
    """With columns whose names clash with those used inside."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit(1) for c in ("v", "n", "w", "part", "at", "component", "whitened", "sums")})


def plain(vectors):
    """Eigenvalues, vectors, sums and exact deviations of the integer vectors."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    vals, vecs = np.linalg.eigh(centred.T @ centred / n)
    return n, dev, centred, vals[::-1], vecs[:, ::-1]


def check(rows, got, k):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, dev, centred, vals, vecs = plain([v for _, v in good])
    want = {}
    for (i, _), d, c in zip(good, dev, centred):
        want.setdefault(i, []).append((d, c))
    assert len(got) == len(good) * k and {r.n for r in got} == {n}
    for r in got:
        j = r.component - 1
        assert r.explained == pytest.approx(vals[j] / vals.sum(), rel=1e-6) and r.identity_error < 1e-9
        assert any(d == r.deviation and abs(r.whitened) == pytest.approx(abs(c @ vecs[:, j]) / math.sqrt(vals[j]), rel=1e-7, abs=1e-7) for d, c in want[r.vec_id])


def test_whiten_against_numpy(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 12)) * np.linspace(0.05, 0.6, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(300)]  # many equal rows
    rows += [(2000, None), (2001, [float("nan")] * 12), (2002, [None] + [0.0] * 11), (2003, [math.inf] + [0.0] * 11), (3, base[3].tolist())]
    got = whitening.whiten(table(spark, rows).repartition(7), components=5).collect()
    check(rows, got, 5)
    two = {(r.vec_id, r.component, round(r.whitened, 6)) for r in whitening.whiten(table(spark, rows).coalesce(1), components=5).collect()}
    assert two == {(r.vec_id, r.component, round(r.whitened, 6)) for r in got}  # signs and all, however dealt


def test_whiten_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check([(r.vec_id, list(r.embedding)) for r in df.collect()], whitening.whiten(df).collect(), 8)


def test_whiten_tree_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(150, 5)) * [1, 2, 3, 4, 5])]
    check(rows, whitening.whiten(table(spark, rows).repartition(9), components=5).collect(), 5)


def test_whiten_edges(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    same = whitening.whiten(table(spark, [(None, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(0, None, 0.0, None)] * 4
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True} and line[0].identity_error < 1e-12
    short = whitening.whiten(table(spark, [(1, [1.0]), (2, [1.0, 4.0]), (3, [])])).collect()
    assert {r.vec_id for r in short} == {1, 2, 3} and len(short) == 6
    huge = whitening.whiten(table(spark, [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])])).collect()
    assert all(r.deviation > 0 for r in huge) and max(r.deviation for r in huge) == (2**40 * 3) ** 2 * 1 or max(r.deviation for r in huge) == 2**63 - 1


@pytest.mark.parametrize("seed", range(4))
def test_secular_update(seed):
    rng = np.random.default_rng(seed)
    lam = np.sort(rng.random((6, 9)) * 10.0 ** rng.integers(-6, 6, (6, 9)), 1)
    z, rho = rng.normal(size=(6, 9)), rng.random(6) * 10
    above, diff = secular(lam, z * z, rho)
    assert (diff[:, np.arange(9), np.arange(9)] < 0).all()  # above its lower pole
    vals, vecs = eigen_update(lam, z, rho)
    for i in range(6):
        want = np.linalg.eigvalsh(np.diag(lam[i]) + rho[i] * np.outer(z[i], z[i]))
        assert np.allclose(vals[i], want, rtol=1e-10, atol=1e-12 * want[-1])
        assert np.abs(vecs[i].T @ vecs[i] - np.eye(9)).max() < 1e-13


def test_spectra_with_deflation():
    """Rows with equal and zero parts, so that eigenvalues tie and parts vanish."""
    rng = np.random.default_rng(2)
    x = np.repeat(np.eye(8)[:5], 6, axis=0)[rng.permutation(30)] * 3.0
    one = Spectra.empty(3, 8)
    for lo in range(0, 30, 3):
        one.add(x[lo : lo + 3], np.array([1, 2, 1]))
    w = np.tile([1, 2, 1], 10)
    mean = (x * w[:, None]).sum(0) / w.sum()
    want = (x - mean).T @ ((x - mean) * w[:, None])
    got = one.joined()
    assert got.n[0] == w.sum() and np.allclose(got.mean[0], mean)
    assert np.allclose(got.vecs[0] @ np.diag(got.vals[0]) @ got.vecs[0].T, want, atol=1e-12)
