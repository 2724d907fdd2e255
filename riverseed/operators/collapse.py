"""Values that differ from the last one kept, over reads of any length.

A read is cut into runs of places. What a run does depends on the value kept before it,
but only through the first value it keeps: each run is summed up by its candidates for
that, with the value kept last and the number kept from each on. These sums are carried
over the runs of a read in a second pass, and the runs are then collapsed side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import stash
from . import dtw, sketch

#: Places of a run; a task holds one at a time.
RUN = 65_536


def following(z: np.ndarray, i: int, diff: float) -> int:
    """The first place after ``i`` whose value differs by ``diff`` or more from that at ``i``;
    the length if there is none."""
    lo, size = i + 1, 16
    while lo < len(z):
        hit = np.abs(z[lo : lo + size] - z[i]) >= diff
        if hit.any():
            return lo + int(np.argmax(hit))
        lo, size = lo + size, min(2 * size, 4096)
    return len(z)


def candidates(z: np.ndarray, diff: float) -> np.ndarray:
    """Places that are kept first after some value: those beyond all values before them, down
    to where the values so far are three times ``diff`` apart, as one of them differs enough
    from any value."""
    low, high = np.minimum.accumulate(z), np.maximum.accumulate(z)
    new = np.r_[True, (z[1:] < low[:-1]) | (z[1:] > high[:-1])]
    end = np.flatnonzero(high - low >= 3 * diff)
    return np.flatnonzero(new[: end[0] + 1] if len(end) else new)


def summed(z: np.ndarray, diff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a run's candidates: their values, and from each on the value kept last and the
    number of values kept. Ways that have met go on together."""
    at = candidates(z, diff)
    known: dict[int, tuple[int, int]] = {}
    for i in at.tolist():
        way = []
        while i < len(z) and i not in known:
            way.append(i)
            i = following(z, i, diff)
        last, n = known[i] if i < len(z) else (way[-1], 0)
        for j in reversed(way):
            n += 1
            known[j] = last, n
    ends = np.array([known[i] for i in at.tolist()], np.int64).reshape(-1, 2)
    return z[at], z[ends[:, 0]], ends[:, 1]


def after(last: float | None, first: np.ndarray, end: np.ndarray, n: np.ndarray, diff: float) -> tuple[float | None, int]:
    """The value kept last after a run that was summed up, and how many it keeps."""
    hit = np.flatnonzero(np.abs(first - last) >= diff) if last is not None else np.arange(len(first))
    return (float(end[hit[0]]), int(n[hit[0]])) if len(hit) else (last, 0)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0), *parts]), kind, safe=False))


def runs(rows: DataFrame, diff: float, size: int = RUN) -> DataFrame:
    """``(read_id, run, pos, z, first, end, n)``: a row for each run of ``size`` places, with
    its values in order and its sum. One shuffle, by read and run."""

    def pack(done: list[tuple]) -> pa.RecordBatch:
        sums = [summed(z, diff) for *_, z in done]
        cols = [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), _lists([d[2] for d in done], pa.int32()), _lists([d[3] for d in done], pa.float64())]
        cols += [_lists([s[j] for s in sums], t) for j, t in enumerate((pa.float64(), pa.float64(), pa.int64()))]
        return pa.record_batch(cols, names=["read_id", "run", "pos", "z", "first", "end", "n"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        whole = lambda: (*key, *(np.concatenate(x) for x in zip(*parts)))
        for b in batches:
            if not b.num_rows:
                continue
            ids, number, pos, z = (b.column(c).to_numpy() for c in ("read_id", "run", "pos", "z"))
            cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (number[1:] != number[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if key != (ids[lo], number[lo]):
                    if parts:
                        yield pack([whole()])
                    key, parts = (ids[lo], number[lo]), []
                parts.append((pos[lo:hi].copy(), z[lo:hi].copy()))
        if parts:
            yield pack([whole()])

    rows = rows.select(F.col("read_id").cast("long").alias("read_id"), F.col("pos").cast("int").alias("pos"), F.col("z").cast("double").alias("z"))
    rows = rows.where("read_id IS NOT NULL AND pos IS NOT NULL AND z IS NOT NULL AND NOT isnan(z)").withColumn("run", F.floor(F.col("pos") / size))
    rows = rows.repartition("read_id", "run").sortWithinPartitions("read_id", "run", "pos", "z")
    return rows.mapInArrow(gather, "read_id long, run long, pos array<int>, z array<double>, first array<double>, end array<double>, n array<long>")


def carried(sums: DataFrame, diff: float) -> DataFrame:
    """``(read_id, run, last, ev)``: the value kept last before each run (null: none) and
    how many were kept. The sums of a read pass through one task one by one."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, last, ev = None, None, 0
        for b in batches:
            lasts, evs = [], []
            for i, *one in zip(b.column("read_id").to_pylist(), *(dtw.arrays(b.column(c)) for c in ("first", "end", "n")), strict=True):
                if i != read:
                    read, last, ev = i, None, 0
                lasts.append(last)
                evs.append(ev)
                last, n = after(last, *one, diff)
                ev += n
            yield pa.record_batch([b.column("read_id"), b.column("run"), pa.array(lasts, pa.float64()), pa.array(evs, pa.int64())], names=["read_id", "run", "last", "ev"])

    rows = sums.select("read_id", "run", "first", "end", "n").repartition("read_id").sortWithinPartitions("read_id", "run")
    return rows.mapInArrow(walk, "read_id long, run long, last double, ev long")


def collapse(rows: DataFrame, diff: float, size: int = RUN) -> DataFrame:
    """``(read_id, pos, z, ev)``: the values of ``(read_id, pos, z)`` that differ by ``diff`` or
    more from the last one kept of their read, in the order of places, numbered by ``ev``.
    Rows with a null or no number are left out; of a ``diff`` of 0 or less all are kept."""
    cut = stash(runs(rows, diff, size), "runs")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lasts, evs = b.column("last").to_pylist(), b.column("ev").to_pylist()
            pos, zs, ev = [], [], []
            for p, z, last, n in zip(dtw.arrays(b.column("pos")), dtw.arrays(b.column("z")), lasts, evs, strict=True):
                at = sketch.kept(z, diff, np.inf if last is None else last)
                pos.append(p[at])
                zs.append(z[at])
                ev.append(n + np.arange(len(at)))
            ids = b.column("read_id").take(pa.array(np.repeat(np.arange(len(pos)), [len(p) for p in pos])))
            cat = lambda x, t: pa.array(np.concatenate([np.empty(0), *x]).astype(t))
            yield pa.record_batch([ids, cat(pos, np.int32), cat(zs, np.float64), cat(ev, np.int32)], names=["read_id", "pos", "z", "ev"])

    both = cut.select("read_id", "run", "pos", "z").join(carried(cut, diff), ["read_id", "run"])
    return both.mapInArrow(keep, "read_id long, pos int, z double, ev int")
