"""Embedding whitening by incremental eigendecomposition.

Entries ``c`` become integers ``x = floor(1024 c) + 100000``. Each task keeps the
spectrum of the scatter of its rows about their mean, and adds a row by one centred
rank-one update: ``M + r d d'`` with ``d`` the row less the mean and ``r = n w / (n + w)``
(``w`` equal rows of a batch are one update). An update turns ``d`` into the eigenbasis,
deflates (equal eigenvalues by one reflection for each run of them; parts of ``d`` too
small to matter), solves the secular equation for the other eigenvalues, and takes the
vectors from the weights that fit the computed roots exactly, so that they stay
orthogonal. Up to ``LANES`` spectra of a task go in step, so that numpy works on stacks of
matrices. Spectra are combined by a rank-one update for each eigenpair of one and one for
the shift of the mean: lanes within a task, then tasks in a tree of ``FAN`` at a time.

A last distributed pass refines: it sums the outer products of all centred rows in the
combined basis (every direction, so the Rayleigh-Ritz values and vectors are those of the
covariance to double precision, however the rows were dealt), and the small problem gives
the components. A component's sign is that of its entry largest in size.

What the driver and a task hold follows from the number of dimensions alone: a few
``d x d`` matrices.

Edge cases: rows whose vector is null, or holds a null, NaN or infinity, are left out;
vectors shorter than the longest are filled up with zeros; entries beyond ``2**30`` in
size count as that; an empty vector among others is all zeros, and a table of empty
vectors, or none, gives no rows; a component without variance (all rows equal, fewer rows
than dimensions) has a null ``whitened``, ``explained`` 0, and is left out of
``identity_error``, which is null if there is no other; a ``deviation`` beyond a long is
the largest long; null and repeated ids are kept, a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Spectra that a task updates in step, within so many bytes; spectra that one task combines.
LANES, LANE_BYTES, FAN = 16, 1 << 24, 16
#: Rows turned into numbers at once.
ROWS = 4096
EPS = float(np.finfo(float).eps)
MOST = 2.0**30
STATE = "part int, n long, sums array<decimal(38,0)>, mean array<double>, vals array<double>, vecs binary"


def secular(lam: np.ndarray, z2: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z2 / (lam - root))`` for stacks ``(L, m)`` of ascending
    distinct ``lam`` and positive ``z2``: what each root is above its nearest pole, and
    ``lam - root`` for all poles, ``(L, root, pole)``. Poles beside a root are fitted by the
    middle way; a step that leaves its bracket halves it."""
    count, m = lam.shape
    top = rho * z2.sum(1)
    if m == 1:
        return top[:, None], -top[:, None, None]
    upper = np.concatenate([lam[:, 1:], (lam[:, -1] + top)[:, None]], 1)
    width = upper - lam
    gap = lam[:, None, :] - lam[:, :, None]  # (root, pole), from the lower pole
    weight = rho[:, None, None] * z2[:, None, :]
    with np.errstate(all="ignore"):
        middle = 1 + (weight / (gap - width[:, :, None] / 2)).sum(2)
    high = middle < 0  # the root is in the upper half
    near = high.copy()
    near[:, -1] = False
    gap = np.where(near[:, :, None], gap - width[:, :, None], gap)
    lo = np.where(near, -width / 2, np.where(high, width / 2, 0.0))
    hi = np.where(near, 0.0, np.where(high, width, width / 2))
    tau = (lo + hi) / 2
    at = np.arange(m)
    first = np.minimum(at, m - 2)  # the poles fitted: below and above, for the last root the two below
    fits = np.tile(first, count)
    below = np.tile((at[None, :] <= first[:, None]).astype(float), (count, 1))
    last = np.tile(at == m - 1, count)
    gaps, weights = gap.reshape(-1, m), np.repeat(rho[:, None] * z2, m, axis=0)
    flat, lo, hi = tau.reshape(-1).copy(), lo.reshape(-1), hi.reshape(-1)
    left, t = np.arange(len(flat)), flat.copy()  # roots not found yet
    for _ in range(80):
        with np.errstate(all="ignore"):
            d = gaps - t[:, None]
            inverse = np.reciprocal(d)
            term = weights * inverse
            under = term * below
            psi, minus = np.einsum("rp,rp->r", under, inverse), under.sum(1)
            all_, plus = np.einsum("rp,rp->r", term, inverse), term.sum(1) - minus
            f, phi = 1 + minus + plus, all_ - psi
            rows = np.arange(len(t))
            d1, d2 = d[rows, fits], d[rows, fits + 1]
            lo, hi = np.where(f < 0, t, lo), np.where(f < 0, hi, t)
            c = f - d1 * psi - d2 * phi
            a = (d1 + d2) * f - d1 * d2 * all_
            b = d1 * d2 * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            inner = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            outer = np.where(a >= 0, (a + root) / (2 * c), 2 * b / (a - root))
            new = t + np.where(last, outer, inner)
            inside = (new > lo) & (new < hi)
            new = np.where(inside, new, (lo + hi) / 2)
        still = np.abs(f) <= 4 * EPS * (1 + np.abs(minus) + np.abs(plus))
        new = np.where(still, t, new)
        # a step of this size is the last one: its error is in proportion to its square
        found = still | (inside & (np.abs(new - t) <= 1e-9 * np.abs(t))) | (hi - lo <= 2 * EPS * np.abs(t))
        flat[left] = t = new
        if found.all():
            break
        if found.sum() * 4 > len(found):
            keep = np.flatnonzero(~found)
            left, t, lo, hi, gaps, weights, below, last, fits = left[keep], t[keep], lo[keep], hi[keep], gaps[keep], weights[keep], below[keep], last[keep], fits[keep]
    tau = flat.reshape(count, m)
    diff = gap - tau[:, :, None]
    return np.where(near, width + tau, tau), diff


def eigen_update(lam: np.ndarray, z: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors ``(L, pole, root)`` of ``diag(lam) + rho z z'``, without
    anything left to deflate."""
    above, diff = secular(lam, z * z, rho)
    m = lam.shape[1]
    # weights for which the computed roots are the exact ones
    with np.errstate(all="ignore"):
        other = lam[:, :, None] - lam[:, None, :]  # (k, j): lam_k - lam_j
        under = np.empty_like(other)
        k, j = np.arange(m)[:, None], np.arange(m)[None, :]
        under[:] = other
        under[:, :-1, :] = np.where((k >= j)[None, :-1, :], other[:, 1:, :], other[:, :-1, :])
        under[:, -1, :] = rho[:, None]
        ratio = -diff / under
        fit = np.sqrt(np.abs(ratio.prod(1))) * np.where(z < 0, -1.0, 1.0)
        vec = fit[:, None, :] / diff  # (root, pole)
        vec /= np.sqrt((vec * vec).sum(2))[:, :, None]
    return lam + above, vec.transpose(0, 2, 1)


@dataclass
class Spectra:
    """A stack of spectra: rows seen, their mean, eigenvalues (ascending) and vectors of
    their scatter."""

    n: np.ndarray
    mean: np.ndarray
    vals: np.ndarray
    vecs: np.ndarray

    @classmethod
    def empty(cls, count: int, d: int) -> "Spectra":
        return cls(np.zeros(count, np.int64), np.zeros((count, d)), np.zeros((count, d)), np.tile(np.eye(d), (count, 1, 1)))

    def rank_one(self, at: np.ndarray, v: np.ndarray, rho: np.ndarray) -> None:
        """Add ``rho v v'`` to the spectra at ``at``."""
        lam, q = self.vals[at], self.vecs[at]
        z = np.matmul(v[:, None, :], q)[:, 0, :]
        norm = np.sqrt((z * z).sum(1))
        scale = np.maximum(lam[:, -1], rho * norm * norm)
        tol = 8 * EPS * scale
        tied = np.diff(lam, axis=1) <= tol[:, None]
        for i in np.flatnonzero(tied.any(1)):
            self._reflect(lam[i], q[i], z[i], tied[i])
        live = (rho[:, None] * np.abs(z) * norm[:, None] > tol[:, None]) & (scale > 0)[:, None]
        sizes = live.sum(1)
        for m in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == m)
            if m == lam.shape[1]:
                new, turn = eigen_update(lam[rows], z[rows], rho[rows])
                self.vals[at[rows]], self.vecs[at[rows]] = new, np.matmul(q[rows], turn)
                continue
            cols = np.nonzero(live[rows])[1].reshape(len(rows), m)
            new, turn = eigen_update(np.take_along_axis(lam[rows], cols, 1), np.take_along_axis(z[rows], cols, 1), rho[rows])
            part = np.matmul(np.take_along_axis(q[rows], cols[:, None, :], 2), turn)
            l2, q2 = lam[rows], q[rows]
            np.put_along_axis(l2, cols, new, 1)
            np.put_along_axis(q2, cols[:, None, :], part, 2)
            order = np.argsort(l2, axis=1, kind="stable")
            self.vals[at[rows]] = np.take_along_axis(l2, order, 1)
            self.vecs[at[rows]] = np.take_along_axis(q2, order[:, None, :], 2)

    @staticmethod
    def _reflect(lam: np.ndarray, q: np.ndarray, z: np.ndarray, tied: np.ndarray) -> None:
        """Turn the basis of each run of equal eigenvalues so that only its last part of
        ``z`` is left."""
        edges = np.flatnonzero(np.diff(np.r_[False, tied, False].astype(np.int8)))
        for lo, hi in zip(edges[::2].tolist(), (edges[1::2] + 1).tolist(), strict=True):
            u = z[lo:hi].copy()
            size = np.sqrt(u @ u)
            if size == 0:
                continue
            u[-1] += size if u[-1] >= 0 else -size
            u /= np.sqrt(u @ u)
            z[lo:hi] -= 2 * u * (u @ z[lo:hi])
            z[lo : hi - 1] = 0
            q[:, lo:hi] -= np.outer(q[:, lo:hi] @ u, 2 * u)

    def add(self, x: np.ndarray, w: np.ndarray) -> None:
        """A row (``w`` times) to each of the first ``len(x)`` spectra."""
        at = np.arange(len(x))
        n = self.n[at] + w
        d = x - self.mean[at]
        rho = self.n[at] * w / n
        self.mean[at] += d * (w / n)[:, None]
        self.n[at] = n
        some = np.flatnonzero((rho > 0) & (d != 0).any(1))
        if len(some):
            self.rank_one(some, d[some], rho[some])

    def take(self, at: np.ndarray, other: "Spectra") -> None:
        """Combine the spectra at ``at`` with those of ``other``."""
        some = other.n > 0
        at, n2 = at[some], other.n[some]
        if not len(at):
            return
        vals, vecs, mean = other.vals[some], other.vecs[some], other.mean[some]
        for i in range(vals.shape[1]):
            rows = np.flatnonzero(vals[:, i] > 0)
            if len(rows):
                self.rank_one(at[rows], np.ascontiguousarray(vecs[rows, :, i]), vals[rows, i])
        n1, d = self.n[at], mean - self.mean[at]
        rho = n1 * n2 / (n1 + n2)
        rows = np.flatnonzero((rho > 0) & (d != 0).any(1))
        if len(rows):
            self.rank_one(at[rows], d[rows], rho[rows])
        self.mean[at] += d * (n2 / (n1 + n2))[:, None]
        self.n[at] = n1 + n2

    def part(self, lo: int, hi: int) -> "Spectra":
        return Spectra(self.n[lo:hi].copy(), self.mean[lo:hi].copy(), self.vals[lo:hi].copy(), self.vecs[lo:hi].copy())

    def joined(self) -> "Spectra":
        """All combined to one, two by two in step."""
        now = self
        while len(now.n) > 1:
            half = len(now.n) // 2
            left = now.part(0, len(now.n) - half)
            left.take(np.arange(half), now.part(len(now.n) - half, len(now.n)))
            now = left
        return now


def integers(column: pa.Array, d: int) -> np.ndarray:
    """``(rows, d)`` integers of a batch's vectors; short ones filled up with zeros."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    c = np.zeros((len(column), d))
    if len(flat) == len(column) * d:
        c[:] = flat.reshape(-1, d)
    else:
        c[np.arange(d)[None, :] < sizes[:, None]] = flat
    return np.floor(1024 * np.clip(c, -MOST, MOST)).astype(np.int64) + 100_000


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part, integers(part.column("v"), d)


def _state(part: int, sums: list[int], one: Spectra) -> pa.RecordBatch:
    cols = [
        pa.array([part], pa.int32()), pa.array([int(one.n[0])], pa.int64()), pa.array([[Decimal(s) for s in sums]], pa.list_(pa.decimal128(38, 0))),
        pa.array([one.mean[0].tolist()], pa.list_(pa.float64())), pa.array([one.vals[0].tolist()], pa.list_(pa.float64())), pa.array([one.vecs[0].tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, ["part", "n", "sums", "mean", "vals", "vecs"])


def _spectrum(row: dict) -> Spectra:
    d = len(row["mean"])
    return Spectra(np.array([row["n"]]), np.array([row["mean"]]), np.array([row["vals"]]), np.frombuffer(row["vecs"]).reshape(1, d, d).copy())


def spectrum(rows: DataFrame, d: int) -> tuple[int, list[int], Spectra]:
    """Number, exact sums, and the spectrum of all vectors ``v`` of ``rows``."""

    def fit(batches):
        from pyspark import TaskContext

        count, sums = max(1, min(LANES, LANE_BYTES // (8 * d * d))), [0] * d
        lanes = Spectra.empty(count, d)
        for _, x in _blocks(batches, d):
            sums = [a + b for a, b in zip(sums, x.sum(0).tolist(), strict=True)]
            distinct, w = np.unique(x, axis=0, return_counts=True)
            for lo in range(0, len(distinct), count):
                lanes.add(distinct[lo : lo + count].astype(float), w[lo : lo + count])
        if lanes.n.any():
            yield _state(TaskContext.get().partitionId(), sums, lanes.joined())

    def combine(key, table):
        one = sums = None
        for batch in table.to_batches(max_chunksize=1):
            row = batch.to_pylist()[0]
            if one is None:
                one, sums = _spectrum(row), [int(s) for s in row["sums"]]
            else:
                one.take(np.array([0]), _spectrum(row))
                sums = [a + int(b) for a, b in zip(sums, row["sums"], strict=True)]
        return pa.Table.from_batches([_state(key[0].as_py(), sums, one)])

    states = stash(rows.mapInArrow(fit, STATE), "spectra")
    while True:
        most = states.agg(F.max("part")).first()[0]
        if not most:
            row = states.first().asDict()
            return row["n"], [int(s) for s in row["sums"]], _spectrum(row)
        states = stash(states.withColumn("part", F.expr(f"part div {FAN}").cast("int")).groupBy("part").applyInArrow(combine, STATE), "spectra")


def rayleigh_ritz(rows: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variances, falling, and unit vectors (columns) of the covariance of the vectors,
    from one pass over them in an orthonormal ``basis`` of the whole space."""
    d = len(sums)
    mean = np.array([s / n for s in sums])

    def project(batches):
        total = np.zeros((d, d))
        for _, x in _blocks(batches, d):
            y = (x - mean) @ basis
            total += y.T @ y
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d, dtype=np.int64)), pa.array(total.ravel())], ["at", "s"])

    small = np.zeros(d * d)
    for r in rows.mapInArrow(project, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        small[r.at] = r.s
    small = small.reshape(d, d) / n
    vals, turn = np.linalg.eigh((small + small.T) / 2)
    vecs = basis @ turn[:, ::-1]
    vecs *= np.where(vecs[np.abs(vecs).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    return np.maximum(vals[::-1], 0), vecs


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``: a row for each
    vector without null or non-finite entries and each component up to ``components``."""
    spark = df.sparkSession
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vec = F.col(f"`{vector}`")
    rows = df.select(F.col(f"`{key}`").alias(key), vec.alias("v")).where(vec.isNotNull() & ~F.exists(vec, bad))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = rows.agg(F.max(F.size("v"))).first()[0]
    if not d:
        return spark.createDataFrame([], schema)
    vectors = rows.select("v")
    n, sums, one = spectrum(vectors, d)
    vals, vecs = rayleigh_ritz(vectors, n, sums, np.linalg.qr(one.vecs[0])[0])
    k = min(components, d)
    trace = float(vals.sum())
    has = vals[:k] > 64 * d * EPS * max(trace, 1e-300)
    mean = np.array([s / n for s in sums])
    scale = np.where(has, 1 / np.sqrt(np.where(has, vals[:k], 1)), np.nan)
    turn = vecs[:, :k]

    def project(batches):
        for batch, x in _blocks(batches, d):
            w = ((x - mean) @ turn) * scale
            small = n * max(float(np.abs(x).max()), 1.0) < 2.0**62 and d * (1.01 * n * float(np.abs(x - mean).max())) ** 2 < 2.0**62
            off = x * n - np.array(sums) if small else x.astype(object) * n - np.array(sums, object)
            dev = [min(int(v), 2**63 - 1) for v in (off * off).sum(1)]
            flat = pa.array(w.ravel(), from_pandas=True)  # NaN, without variance, as null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dev, pa.int64()), lists], [key, "deviation", "w"])

    wide = stash(rows.mapInArrow(project, f"`{key}` {df.schema[key].dataType.simpleString()}, deviation long, w array<double>"), "whitened")
    live = np.flatnonzero(has).tolist()
    error = None
    if live:
        w = lambda i: F.col("w")[i]
        means = wide.agg(*[F.avg(w(i)).alias(f"m{i}") for i in live]).first()
        pairs = [(i, j) for i in live for j in live if i <= j]
        cov = wide.agg(*[F.avg((w(i) - means[f"m{i}"]) * (w(j) - means[f"m{j}"])).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    share = F.array(*[F.lit(float(v / trace) if ok else 0.0) for v, ok in zip(vals[:k], has, strict=True)])
    out = wide.select(key, "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        key, (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
