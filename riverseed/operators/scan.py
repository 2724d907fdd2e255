"""Seeds of target texts that are used where they are made: counted, and met with the
seeds of the queries, in the pass that sketches the texts. No index is written or shuffled.

The queries' seeds go to every task as sorted arrays, up to :data:`FEW_SEEDS`; beyond that
:func:`locate` gives none and :mod:`mapping` joins the two sides. The texts are sketched
twice: for the counts of hashes, which the occurrence limit follows from, and for the anchors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.many_chains import many_chains
from ..functions.signal_math import pore_levels
from ..options import Options
from ..work import stash
from . import chain, mapping, sketch

#: Seeds of queries that go to every task (16 bytes each).
FEW_SEEDS = 4_000_000
#: Seeds that a task gathers before it counts them, and hashes that it counts before it gives them on.
GATHERED, COUNTED = 4_000_000, 4_000_000
#: Anchors that a task gathers before it chains them.
ANCHORS = 500_000
#: Ranges of hashes that counts are dealt by: the upper 9 of 32 bits.
RANGE_BITS = 23
#: Places of the table by which most hashes that no query has are told.
SIEVE = (1 << 20) - 1


@dataclass(frozen=True)
class TextIndex:
    """The seeds of ``targets``' texts by the settings ``o``, of the forward strand and, if
    ``reverse``, the reverse one."""

    targets: DataFrame
    key: str
    o: Options
    reverse: bool = False
    pore: np.ndarray | None = None

    def seeds(self) -> DataFrame:
        """``(id, rev, pos, hash)``, for what has to join them."""
        make = lambda s: sketch.seeds(self.targets, self.key, s, self.o, self.pore).withColumn("rev", F.lit(s))
        return make(0).unionByName(make(1)) if self.reverse else make(0)

    def lone(self) -> bool:
        """Whether each target is one text."""
        ids = self.targets.groupBy(F.col(self.key).cast("long").alias("id")).agg(F.count("*").alias("n"))
        return ids.where("n > 1").isEmpty()

    def scanned(self, use: Callable[[Iterator], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """The rows that ``use`` makes of each task's ``(id, strand, places, hashes)``."""
        o, strands = self.o, (0, 1) if self.reverse else (0,)
        levels = pore_levels(o.k) if self.pore is None else self.pore

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def each() -> Iterator[tuple]:
                for b in batches:
                    ids, texts = b.column("id").to_pylist(), b.column("text").cast(pa.large_binary())
                    for i, t in zip(ids, texts):
                        text = t.as_py() or b""
                        for s in strands:
                            yield i, s, *sketch.sketch_values(levels[sketch.kmer_codes(sketch.bases(text, s, o.alphabet), o.k)], o)

            return use(each())

        return sketch._texts(self.targets, self.key).mapInArrow(run, schema)


def pack(values: np.ndarray) -> bytes:
    """Numbers under 2**32, byte by byte of all, so that they compress."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


def tallied(hashes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and how many there are, or the sums of their ``n``."""
    if n is None:
        h = np.sort(hashes)
    else:
        order = np.argsort(hashes, kind="stable")
        h, n = hashes[order], n[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    return h[first], np.diff(np.r_[first, len(h)]) if n is None else np.add.reduceat(n, first) if len(h) else n


def _count(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """``(part, hashes, n)``: a task's counts by range of hashes."""

    def given(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        parts = h >> RANGE_BITS
        cuts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(h) else np.empty(0, np.int64)
        ends = np.r_[cuts[1:], len(h)]
        steps = [pack(np.diff(h[lo:hi], prepend=int(parts[lo]) << RANGE_BITS)) for lo, hi in zip(cuts.tolist(), ends.tolist())]
        return pa.record_batch([pa.array(parts[cuts], pa.int32()), pa.array(steps, pa.binary()), pa.array([pack(n[lo:hi]) for lo, hi in zip(cuts.tolist(), ends.tolist())], pa.binary())], names=["part", "hashes", "n"])

    def summed() -> tuple[np.ndarray, np.ndarray]:
        h, n = tallied(np.concatenate(held))
        return tallied(np.r_[known[0], h.astype(np.int64)], np.r_[known[1], n])

    none = np.empty(0, np.int64)
    known, held, size = (none, none), [], 0
    for *_, h in rows:
        held.append(h.astype(np.uint32))
        size += len(h)
        if size >= GATHERED:
            known, held, size = summed(), [], 0
            if len(known[0]) > COUNTED:
                yield given(*known)
                known = (none, none)
    if held:
        yield given(*summed())


def _merged(wanted) -> Callable[[pa.Table], pa.Table]:
    """Of a range's counts: ``(0, n_occ, hashes of that count)`` and, of the ``wanted`` hashes
    that there are, ``(1, hash, n_occ)``."""

    def run(table: pa.Table) -> pa.Table:
        base = table.column("part")[0].as_py() << RANGE_BITS
        rows = list(zip(table.column("hashes").to_pylist(), table.column("n").to_pylist()))
        h, n = tallied(np.concatenate([np.cumsum(unpack(x)) + base for x, _ in rows]), np.concatenate([unpack(y) for _, y in rows]))
        counts, times = np.unique(n, return_counts=True)
        _, at, _ = np.intersect1d(h, wanted.value, assume_unique=True, return_indices=True)
        kind = np.repeat(np.array([0, 1], np.int32), [len(counts), len(at)])
        return pa.table({"kind": kind, "value": np.r_[counts, h[at]], "n": np.r_[times, n[at]]})

    return run


@dataclass(frozen=True)
class Located:
    """Seeds of queries, written and in every task, the counts ``(hash, nt)`` that the index
    has of their hashes, and the occurrence limit."""

    queries: DataFrame
    index: TextIndex
    counts: DataFrame
    max_occ: int
    table: object  # a broadcast of arrays: hashes, starts, counts, owners, places

    def shared(self) -> mapping.Shared:
        """For what asks of the queries and counts alone."""
        return mapping.Shared(self.queries, self.queries.limit(0), self.counts, self.max_occ)

    def _meets(self) -> Callable[[Iterator], Iterator[tuple]]:
        table = self.table

        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            """``(id, strand, owners, query places, target places)`` of each text's anchors."""
            hashes, starts, counts, owners, places = table.value
            sieve = np.zeros(SIEVE + 1, bool)
            sieve[hashes & SIEVE] = True
            for i, s, p, h in rows:
                hit = np.flatnonzero(sieve[h & SIEVE])
                at = np.searchsorted(hashes, h[hit])
                same = hashes[np.minimum(at, len(hashes) - 1)] == h[hit] if len(hashes) else np.zeros(len(hit), bool)
                hit, at = hit[same], at[same]
                n = counts[at]
                src = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                yield i, s, owners[src], places[src], np.repeat(p[hit], n)

        return run

    def anchors(self) -> DataFrame:
        """``(qid, q_pos, tid, rev, t_pos)``."""
        meets = self._meets()

        def use(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def given() -> pa.RecordBatch:
                n = [len(x[2]) for x in held]
                cols = [np.concatenate([x[k] for x in held]) for k in (2, 3, 4)]
                ids, strands = (pa.array([x[k] for x in held], t).take(pa.array(np.repeat(np.arange(len(n)), n))) for k, t in ((0, pa.int64()), (1, pa.int32())))
                return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1].astype(np.int32)), ids, strands, pa.array(cols[2].astype(np.int32))], names=["qid", "q_pos", "tid", "rev", "t_pos"])

            for row in meets(rows):
                if len(row[2]):
                    held.append(row)
                    size += len(row[2])
                if size >= 50_000:
                    yield given()
                    held, size = [], 0
            if held:
                yield given()

        return self.index.scanned(use, "qid long, q_pos int, tid long, rev int, t_pos int")

    def chains(self, o: Options, clock: bool = False) -> DataFrame:
        """:func:`chain.chains` of the anchors. Where each target is one text, all of a query
        and a target are chained where they are found. With ``clock`` there are :func:`clock.marks`."""
        if o.rmq or o.dtw or o.bw_long > o.bw or not self.index.lone():
            return chain.chains(self.anchors(), o, bool(o.dtw), clock)
        meets = self._meets()

        def use(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def given() -> Iterator[pa.RecordBatch]:
                began = time.perf_counter_ns()
                ids, who = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True)
                n = [len(x[2]) for x in held]
                g = np.repeat(np.arange(len(n)), n) * len(ids) + who
                g, *found = many_chains(g, *(np.concatenate([x[k] for x in held]).astype(np.int64) for k in (4, 3)), o, chain._scores, chain.link, chain.trace, chain.NONE)
                text = pa.array(g // len(ids))
                cols = [pa.array(ids[g % len(ids)], pa.int64()), pa.array([x[0] for x in held], pa.int64()).take(text), pa.array([x[1] for x in held], pa.int32()).take(text), *[pa.array(x, pa.int64()) for x in found[:2]], *[pa.array(x.astype(np.int32)) for x in found[2:]]]
                out = pa.record_batch(cols, names=[f.split()[0] for f in chain.FIELDS.split(", ")])
                if not clock:
                    yield out
                else:
                    yield from chain.marks(out, pa.array(ids, pa.int64()), chain.shared_time(began, np.bincount(who)))

            for row in meets(rows):
                if len(row[2]):
                    held.append(row)
                    size += len(row[2])
                if size >= ANCHORS:
                    yield from given()
                    held, size = [], 0
            if held:
                yield from given()

        return self.index.scanned(use, chain.FIELDS + ", us long" * clock)


def locate(queries: DataFrame, index: TextIndex, max_occ: int | None = None) -> Located | None:
    """The queries' seeds ``(id, pos, hash)`` against the index, or None if there are too many to
    go to every task or some have no id. Without ``max_occ`` the limit is the quantile of the
    index's counts."""
    spark, o = queries.sparkSession, index.o
    queries = stash(queries.select("id", "pos", "hash"), "queries")
    n, known = queries.agg(F.count("*"), F.count("id")).first()
    if n > FEW_SEEDS or known < n:
        return None
    mine = queries.toArrow()
    owners, places, hashes = (mine.column(c).to_numpy() for c in ("id", "pos", "hash"))
    wanted = spark.sparkContext.broadcast(np.unique(hashes))
    counted = index.scanned(_count, "part int, hashes binary, n binary").groupBy("part").applyInArrow(_merged(wanted), "kind int, value long, n long")
    counted = stash(counted, "counted")
    counts = counted.where("kind = 1").select(F.col("value").alias("hash"), F.col("n").alias("nt"))
    if max_occ is None:
        times = counted.where("kind = 0").groupBy(F.col("value").alias("n_occ")).agg(F.sum("n").alias("n"))
        found = mapping.quantile_of(times, o.mid_occ_frac, o.mid_occ_min, o.mid_occ_max).first()
        max_occ = o.mid_occ_min if found is None else found[0]
    rare = np.sort(counts.where(F.col("nt") <= max_occ).select("hash").toArrow().column("hash").to_numpy())
    order = np.argsort(hashes, kind="stable")
    order = order[np.isin(hashes[order], rare)]
    h = hashes[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    table = spark.sparkContext.broadcast((h[starts], starts, np.diff(np.r_[starts, len(h)]), owners[order], places[order]))
    return Located(queries, index, counts, int(max_occ), table)
