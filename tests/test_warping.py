"""Costs by rolling antidiagonals against tables of all cells, whole and in both bands."""

import time

import numpy as np
import pytest

from riverseed.operators import dtw


def closed_cells(a, b, is_open, semi=False):
    """Cell by cell; closed ones are infinite."""
    n, m = len(a), len(b)
    d = [[float("inf")] * m for _ in range(n)]
    for i in range(n):
        for j in range(m):
            if is_open(i, j):
                before = [d[x][y] for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
                start = (i == 0 and semi) or (i == 0 and j == 0)
                d[i][j] = (0.0 if start else min(before, default=float("inf"))) + abs(a[i] - b[j])
    cost = min(d[-1]) if semi else d[-1][-1]
    return cost if cost < float("inf") else dtw.FAR


def slanted(n, m, band):
    reach = int(np.ceil(band * max(n, m))) + abs(n - m) / max(n, m, 1)
    return lambda i, j: (abs(i * (m / n) - j) <= reach) if m >= n else (abs(j * (n / m) - i) <= reach)


SIZES = [(1, 1), (1, 7), (9, 1), (5, 5), (6, 13), (17, 8), (20, 21), (30, 11)]


@pytest.mark.parametrize("n,m", SIZES)
@pytest.mark.parametrize("semi", [False, True])
def test_whole_and_banded(n, m, semi):
    rng = np.random.default_rng(n * 100 + m)
    a, b = rng.integers(0, 9, (3, n)).astype(float), rng.integers(0, 9, (3, m)).astype(float)
    want = [closed_cells(x, y, lambda i, j: True, semi) for x, y in zip(a, b)]
    assert np.allclose(dtw.costs(a, b, semi), want)
    for band in (0.0, 0.05, 0.1, 0.3, 1.0):
        assert np.allclose(dtw.costs(a, b, semi, band), [closed_cells(x, y, slanted(n, m, band), semi) for x, y in zip(a, b)])
    for radius in (0, 1, 3, 12):
        assert np.allclose(dtw.costs(a, b, semi, radius=radius), [closed_cells(x, y, lambda i, j: abs(i - j) <= radius, semi) for x, y in zip(a, b)])


def test_open_rows_are_the_bands_cells():
    for n, m in SIZES + [(64, 37), (50, 100)]:
        for kind, is_open in (({"band": 0.07}, slanted(n, m, 0.07)), ({"radius": 2}, lambda i, j: abs(i - j) <= 2)):
            lo, hi = dtw.open_rows(n, m, **kind)
            for s in range(n + m - 1):
                rows = [i for i in range(n) if 0 <= s - i < m and is_open(i, s - i)]
                assert rows == list(range(lo[s], hi[s] + 1))


def test_corner_outside_the_band_is_far():
    a, b = np.zeros((1, 30)), np.zeros((1, 10))
    assert dtw.costs(a, b, radius=19)[0] == dtw.FAR and dtw.costs(a, b, radius=20)[0] == 0 and dtw.costs(a, b, band=0.1)[0] == 0


def test_long_sequences_in_one_task(spark):
    """100,000 values each, as no table of all cells could be held."""
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=100_000))
    rows = spark.createDataFrame([(1, x.tolist(), np.r_[x[:3], x[:-3]].tolist()), (2, None, [1.0]), (3, None, None)], "id long, a array<double>, b array<double>").coalesce(1)
    began = time.time()
    got = {r.id: r.cost for r in dtw.distances(rows, ["id"], band=0.0005).collect()}
    assert time.time() - began < 120 and got[2] == dtw.FAR and got[3] == 0
    assert got[1] < np.abs(x - np.r_[x[:3], x[:-3]]).sum() / 100  # the shift is followed


@pytest.mark.parametrize("n,m", [*SIZES, (2, 40), (40, 2), (1, 30)])
@pytest.mark.parametrize("reach", [0, 1, 2, 7])
def test_reach_of_the_shorter_sequence(n, m, reach):
    """Every place of the longer sequence has its share of the way in the shorter one open."""
    rng = np.random.default_rng(n + m)
    a, b = rng.integers(0, 9, (3, n)).astype(float), rng.integers(0, 9, (3, m)).astype(float)
    rule = (lambda i, j: abs(i * m // n - j) <= reach) if n >= m else (lambda i, j: abs(j * n // m - i) <= reach)
    got = dtw.costs(a, b, reach=reach)
    assert np.allclose(got, [closed_cells(x, y, rule) for x, y in zip(a, b)]) and (got < dtw.FAR).all()
