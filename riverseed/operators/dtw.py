"""Dynamic time warping of numeric sequences: whole, semiglobal, banded, with the path.

The cost of a cell is the absolute difference. All pairs of a batch that have equal
lengths are computed together, one antidiagonal at a time. Costs keep the last two of
them, no longer than the band is wide; only paths keep the whole table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

FAR = 1e10  # fixed value: the cost when the band misses the corner


def table(a: np.ndarray, b: np.ndarray, semiglobal: bool = False, band: float | None = None) -> np.ndarray:
    """Costs ``(pairs, n, m)`` of the best path to each cell, for ``(pairs, n)`` against
    ``(pairs, m)``. Semiglobal paths start anywhere in ``b``. With a band, cells further
    than ``ceil(band * max(n, m))`` from the slanted diagonal are closed."""
    k, n, m = len(a), a.shape[1], b.shape[1]
    d = np.full((k, n + 1, m + 1), np.inf)
    d[:, 0, 0] = 0
    if semiglobal:
        d[:, 0, :] = 0
    for s in range(n + m - 1):
        i = np.arange(max(0, s - m + 1), min(n, s + 1))
        j = s - i
        if band is not None:
            radius = int(np.ceil(band * max(n, m))) + abs(n - m) / max(n, m, 1)
            ok = np.abs(i * (m / n) - j) <= radius if m >= n else np.abs(j * (n / m) - i) <= radius
            i, j = i[ok], j[ok]
        before = np.minimum(np.minimum(d[:, i, j], d[:, i, j + 1]), d[:, i + 1, j])
        d[:, i + 1, j + 1] = before + np.abs(a[:, i] - b[:, j])
    return d[:, 1:, 1:]


def open_rows(n: int, m: int, band: float | None = None, radius: int | None = None, reach: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first and last row ``i`` of the open cells ``(i, s - i)`` of each antidiagonal
    ``s``; first above last where there is none. ``band``: the slanted band of ``table``;
    ``radius``: at most so many places off the diagonal; ``reach``: for each place of the
    longer sequence those of the shorter one at most so far from its share of the way, which
    leaves both corners open whatever the lengths are."""
    s = np.arange(n + m - 1)
    lo, hi = np.maximum(0, s - m + 1), np.minimum(n - 1, s)
    if reach is not None:
        long, short = max(n, m), min(n, m)
        on = np.arange(long) + np.arange(long) * short // long  # the antidiagonals of the band's middle
        first, last = np.searchsorted(on, s - reach), np.searchsorted(on, s + reach, "right") - 1
        return (np.maximum(lo, first), np.minimum(hi, last)) if n >= m else (np.maximum(lo, s - last), np.minimum(hi, s - first))
    if band is None and radius is None:
        return lo, hi
    if radius is not None:
        return np.maximum(lo, (s - radius + 1) // 2), np.minimum(hi, (s + radius) // 2)
    reach = int(np.ceil(band * max(n, m))) + abs(n - m) / max(n, m, 1)
    slope = m / n if m >= n else n / m
    ok = (lambda i: np.abs(i * slope - (s - i)) <= reach) if m >= n else (lambda i: np.abs((s - i) * slope - i) <= reach)
    middle, half = (s if m >= n else s * slope) / (1 + slope), reach / (1 + slope)
    first, last = np.ceil(middle - half).astype(np.int64), np.floor(middle + half).astype(np.int64)
    first = np.where(ok(first - 1), first - 1, np.where(ok(first), first, first + 1))  # rounding at the edges
    last = np.where(ok(last + 1), last + 1, np.where(ok(last), last, last - 1))
    return np.maximum(lo, first), np.minimum(hi, last)


def _part(d: np.ndarray, start: int, lo: int, hi: int) -> np.ndarray:
    """Rows ``lo`` to ``hi`` of an antidiagonal whose first row is ``start``; infinite where it has none."""
    end = start + d.shape[1]
    if start <= lo and hi < end:
        return d[:, lo - start : hi + 1 - start]
    out = np.full((len(d), hi - lo + 1), np.inf)
    a, b = max(lo, start), min(hi + 1, end)
    if a < b:
        out[:, a - lo : b - lo] = d[:, a - start : b - start]
    return out


def costs(a: np.ndarray, b: np.ndarray, semiglobal: bool = False, band: float | None = None, radius: int | None = None, reach: int | None = None) -> np.ndarray:
    """The cost of each pair; of empty sequences 0, and ``FAR`` if only one is empty or the
    band misses the corner."""
    if not a.shape[1] or not b.shape[1]:
        return np.full(len(a), 0.0 if a.shape[1] == b.shape[1] or (semiglobal and not a.shape[1]) else FAR)
    k, n, m = len(a), a.shape[1], b.shape[1]
    first, last = (x.tolist() for x in open_rows(n, m, band, radius, reach))
    back = b[:, ::-1]  # so that an antidiagonal's values of b run forward
    one, two, at_one, at_two = np.empty((k, 0)), np.empty((k, 0)), 0, 0
    best = np.full(k, np.inf)
    for s, (lo, hi) in enumerate(zip(first, last, strict=True)):
        if lo > hi:
            now, lo = np.empty((k, 0)), 0
        else:
            near = _part(one, at_one, lo - 1, hi)  # above and to the left
            now = np.minimum(near[:, :-1], near[:, 1:])
            np.minimum(now, _part(two, at_two, lo - 1, hi - 1), out=now)
            if lo == 0 and (semiglobal or s == 0):
                now[:, 0] = 0
            now += np.abs(a[:, lo : hi + 1] - back[:, m - 1 - s + lo : m - s + hi])
            if hi == n - 1 and (semiglobal or s == n + m - 2):
                best = np.minimum(best, now[:, -1])
        one, two, at_one, at_two = now, one, lo, at_one
    return np.where(np.isfinite(best), best, FAR)


def path(a: np.ndarray, b: np.ndarray, semiglobal: bool = False) -> tuple[float, list[tuple[int, int]]]:
    """Cost and cells of the best path of one pair; ties go to the diagonal, then up."""
    if not len(a) or not len(b):
        return float(costs(a[None], b[None], semiglobal)[0]), []
    d = table(a[None], b[None], semiglobal)[0]
    i, j = len(a) - 1, int(np.argmin(d[-1])) if semiglobal else len(b) - 1
    cost, out = float(d[i, j]), [(i, j)]
    while i > 0 or (j > 0 and not semiglobal):
        steps = [(d[x, y], n, x, y) for n, (x, y) in enumerate(((i - 1, j - 1), (i - 1, j), (i, j - 1))) if x >= 0 and y >= 0]
        _, _, i, j = min(steps)
        out.append((i, j))
    return cost, out[::-1]


def arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Each row's values by views of the batch; null as empty."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    for lo, hi in zip(np.r_[0, ends[:-1]].astype(int).tolist(), ends.tolist(), strict=True):
        yield flat[lo:hi]


def _apply(pairs: DataFrame, value: Callable[[np.ndarray, np.ndarray], list], field: str, kind: pa.DataType, keep: list[str], cells: Callable[[int, int], int]) -> DataFrame:
    """``value`` of the arrays ``a`` and ``b`` of each row, those of equal lengths together,
    at most so many that what is kept of them, ``cells`` of a pair, is some four million values."""
    schema = pairs.select(*keep).schema.add(*field.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (list(arrays(b.column(c))) for c in "ab")
            same, out = defaultdict(list), [None] * b.num_rows
            for i, (u, v) in enumerate(zip(x, y)):
                same[len(u), len(v)].append(i)
            for (n, m), at in same.items():
                step = max(1, 4_000_000 // max(cells(n, m), 1))
                for lo in range(0, len(at), step):
                    part = at[lo : lo + step]
                    for i, v in zip(part, value(np.stack([x[i] for i in part]), np.stack([y[i] for i in part]))):
                        out[i] = v
            yield pa.record_batch([*[b.column(c) for c in keep], pa.array(out, kind)], names=[*keep, field.split()[0]])

    return pairs.select(*keep, "a", "b").mapInArrow(run, schema)


def distances(pairs: DataFrame, keep: list[str], semiglobal: bool = False, band: float | None = None, radius: int | None = None) -> DataFrame:
    """``cost`` of the arrays ``a`` and ``b`` of each row, beside the columns of ``keep``:
    whole or ``semiglobal``, in the slanted ``band`` or within ``radius`` of the diagonal."""
    value = lambda a, b: costs(a, b, semiglobal, band, radius).tolist()
    return _apply(pairs, value, "cost double", pa.float64(), keep, lambda n, m: 4 * min(n, m) + n + m)


def paths(pairs: DataFrame, keep: list[str], semiglobal: bool = False) -> DataFrame:
    """``path`` of each row's pair: ``i:j`` cells, comma-joined."""
    text = lambda a, b: [",".join(f"{i}:{j}" for i, j in path(u, v, semiglobal)[1]) for u, v in zip(a, b)]
    return _apply(pairs, text, "path string", pa.string(), keep, lambda n, m: (n + 1) * (m + 1))
