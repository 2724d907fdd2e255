"""Chaining of anchors, ranking of chains, primaries, mapping quality and the decision.

Anchors ``(qid, tid, rev, t_pos, q_pos)`` are gathered by query, target and strand: a
group is at most the seeds of one query times the occurrence limit of the seed join.
Ties are broken by score, count, target, strand and place, in that order.
"""

from __future__ import annotations

import time
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import replace
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.many_chains import many_chains
from ..functions.range_max import RangeMaxima
from ..options import Options
from .clock import marks

NONE = -(2**31)
FIELDS = "qid long, tid long, rev int, score long, cnt long, qs int, qe int, rs int, re int"


def pair_score(dq: Column, dr: Column, o: Options) -> Column:
    """Score of an anchor after another at the distances ``dq`` and ``dr``; null if they can't link."""
    dd, dg = F.abs(dr - dq), F.least(dr, dq)
    far = (dq <= 0) | (dq > max(o.max_query_gap, o.bw)) | (dr == 0) | (dr > max(o.max_target_gap, o.bw)) | (dd > o.bw) | (dr > max(o.max_query_gap, o.bw))
    cost = o.gap * dd + o.skip * dg + F.when(dd >= 1, 0.5 * F.log2(dd + 1.0)).otherwise(0.0)
    base = F.least(F.lit(o.span), dg)
    return F.when(~far, base - F.when((dd != 0) | (dg > o.span), cost.cast("int")).otherwise(0)).cast("long")


def _scores(dq: np.ndarray, dr: np.ndarray, o: Options, limits: bool = True) -> np.ndarray:
    dd, dg = np.abs(dr - dq), np.minimum(dr, dq)
    cost = np.trunc(o.gap * dd + o.skip * dg + 0.5 * np.log2(dd + 1.0)).astype(np.int64)
    s = np.minimum(o.span, dg) - np.where((dd != 0) | (dg > o.span), cost, 0)
    if limits:
        s[(dq <= 0) | (dq > max(o.max_query_gap, o.bw)) | (dr == 0) | (dr > max(o.max_target_gap, o.bw)) | (dd > o.bw) | (dr > max(o.max_query_gap, o.bw))] = NONE
    return s


def tried(total: np.ndarray, seen: np.ndarray, start: int, max_skips: int) -> int:
    """How many of the candidates, nearest first, are tried: all, or up to the one at which
    more than ``max_skips`` skips are open. A candidate that a nearer one has as its own
    predecessor (``seen``) and that isn't the best so far opens a skip, one that is closes one."""
    better = total > np.maximum.accumulate(np.r_[start, total])[:-1]
    walk = np.cumsum(np.where(better, -1, seen.astype(np.int64)))
    over = np.flatnonzero(walk - np.minimum(np.minimum.accumulate(walk), 0) > max_skips)
    return int(over[0]) if len(over) else len(total)


def link(t: np.ndarray, q: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Best score that ends in each anchor and its predecessor (-1: none). Anchors are
    sorted by target place. The nearest predecessors are tried first; where trying ends
    early, the anchor of the highest score in reach is tried as well. That anchor is kept
    until it is out of reach or beaten; then it is the last one of the highest score."""
    n, reach, span = len(t), max(o.max_target_gap, o.bw), o.span
    ts, qs, f, p = t.tolist(), q.tolist(), [span] * n, [-1] * n
    most_q, most_t = max(o.max_query_gap, o.bw), min(reach, max(o.max_query_gap, o.bw))
    drift = (0.5 * np.log2(np.arange(o.bw + 1) + 1.0)).tolist()  # by the difference of the distances

    def score(i: int, j: int) -> int:
        dq, dr = qs[i] - qs[j], ts[i] - ts[j]
        dd, dg = abs(dr - dq), min(dr, dq)
        if dq <= 0 or dq > most_q or dr == 0 or dr > most_t or dd > o.bw:
            return NONE
        return min(span, dg) - (int(o.gap * dd + o.skip * dg + drift[dd]) if dd or dg > span else 0)

    far, top = 0, -1
    for i in range(n):
        while ts[far] < ts[i] - reach:
            far += 1
        lo = max(far, i - o.max_iterations)
        if lo < i:
            near = [(s + f[j], j) for j in range(i - 1, lo - 1, -1) if (s := score(i, j)) > NONE]
            seen = {p[j] for _, j in near} if len(near) > o.max_skips else ()
            best, at, stop, skips = span, -1, lo, 0
            for total, j in near:  # a skip opens or closes as in ``tried``
                if total > best:
                    best_now, at_now, skips = total, j, max(skips - 1, 0)
                else:
                    best_now, at_now, skips = best, at, skips + (j in seen)
                if skips > o.max_skips:
                    stop = j
                    break
                best, at = best_now, at_now
            if top < far:
                top = max(range(far, i), key=lambda j: (f[j], j))
            if top < stop and (own := score(i, top)) > NONE and own + f[top] > best:
                best, at = own + f[top], top
            if at >= 0:
                f[i], p[i] = best, at
        if top < far or f[i] > f[top]:
            top = i
    return np.array(f, np.int64), np.array(p, np.int64)


def link_ranges(t: np.ndarray, q: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """As ``link`` by range maxima. Predecessors lie at a lesser target place, within the
    larger gap limit (or the band) on both sides; a query place may be the same. The one of
    the largest ``f + gap / 2 * (t + q)``, which a tree over query places gives, is tried
    first. Unless it fits exactly (no gap, within the span), those before it on the query
    and within the inner distance on both sides are tried as well, from the next query
    place down, until skips end it as in ``link``. At most ``rmq_cap`` anchors are in reach,
    the last ones. Anchors are sorted by target place."""
    n, reach = len(t), max(o.max_target_gap, o.max_query_gap, o.bw)
    inner = o.rmq_inner if 0 < o.rmq_inner < reach else 0
    f, p, mark = np.full(n, o.span, np.int64), np.full(n, -1, np.int64), np.full(n + 1, -1, np.int64)
    by_query = np.lexsort((np.arange(n), q))
    place = np.empty(n, np.int64)
    place[by_query] = np.arange(n)
    sorted_q = q[by_query]
    lows, highs = np.searchsorted(sorted_q, q - reach).tolist(), (np.searchsorted(sorted_q, q, "right") - 1).tolist()
    inner_lows, inner_highs = np.searchsorted(sorted_q, q - inner).tolist(), np.searchsorted(sorted_q, q).tolist()
    at, ts, qs = place.tolist(), t.tolist(), q.tolist()
    tree, close = RangeMaxima(n), []  # all in reach; places of those in the inner distance, ascending
    entered = left = left_inner = 0
    for i in range(n):
        if ts[entered] != ts[i]:
            for j in range(entered, i):
                tree.insert(j, at[j], float(f[j]) + 0.5 * o.gap * (ts[j] + qs[j]))
                if inner:
                    insort(close, at[j])
            entered = i
        while left < entered and (ts[i] > ts[left] + reach or len(tree) > o.rmq_cap):
            tree.drop(left, at[left])
            left += 1
        while inner and left_inner < entered and (ts[i] > ts[left_inner] + inner or len(close) > o.rmq_cap):
            del close[bisect_left(close, at[left_inner])]
            left_inner += 1
        j = tree.best(lows[i], highs[i])
        if j < 0:
            continue
        dq, dr = qs[i] - qs[j], ts[i] - ts[j]
        dd, dg = abs(dr - dq), min(dr, dq)
        best, own = o.span, int(f[j]) + min(o.span, dg) - (int(o.gap * dd + o.skip * dg + 0.5 * log2(dd + 1)) if dd or dg > o.span else 0)
        if dd <= o.bw and own > best:
            best, p[i] = own, j
        if inner and (dd or dg > o.span):
            lo, hi = bisect_left(close, inner_lows[i]), bisect_left(close, inner_highs[i])
            best = _inner(i, t, q, f, p, mark, by_query, close, lo, hi, best, o)
        f[i] = best
    return f, p


def _inner(i: int, t: np.ndarray, q: np.ndarray, f: np.ndarray, p: np.ndarray, mark: np.ndarray, by_query: np.ndarray, close: list[int], lo: int, hi: int, best: int, o: Options) -> int:
    """The best score of anchor ``i`` with the predecessors ``close[lo:hi]`` (their places in
    the order of ``by_query``), in blocks from the last down; sets ``p``."""
    skips, size = 0, 16
    while lo < hi:
        near = by_query[close[max(lo, hi - size) : hi][::-1]]
        hi, size = hi - len(near), min(2 * size, 1024)
        dq, dr = q[i] - q[near], t[i] - t[near]
        ok = np.abs(dr - dq) <= o.bw
        if not ok.all():
            near, dq, dr = near[ok], dq[ok], dr[ok]
        if not len(near):
            continue
        total = _scores(dq, dr, o, limits=False) + f[near]
        mark[p[near]] = i
        better = total > np.maximum.accumulate(np.r_[best, total])[:-1]
        walk = skips + np.cumsum(np.where(better, -1, (mark[near] == i).astype(np.int64)))
        walk -= np.minimum(np.minimum.accumulate(walk), 0)
        over = np.flatnonzero(walk > o.max_skips)
        n_tried = int(over[0]) if len(over) else len(near)
        if n_tried and total[:n_tried].max() > best:
            at = int(np.argmax(total[:n_tried]))
            best, p[i] = int(total[at]), near[at]
        if len(over):
            break
        skips = int(walk[-1])
    return best


def trace(f: np.ndarray, p: np.ndarray, o: Options) -> list[tuple[int, list[int]]]:
    """Disjoint chains ``(score, anchors in order)``, best ends first. A chain begins where
    going further back lowers its score by more than the band."""
    used, out = np.zeros(len(f), bool), []
    for end in np.lexsort((np.arange(len(f)), -f)).tolist():
        if f[end] < o.min_score:
            break
        if used[end]:
            continue
        path, i, best, keep = [], end, 0, 0
        while i >= 0 and not used[i]:
            path.append(i)
            i = int(p[i])
            gained = int(f[end] - (f[i] if i >= 0 else 0))
            if gained > best:
                best, keep = gained, len(path)
            elif best - gained > o.bw:
                break
        path = path[:keep]
        used[path] = True
        if best >= o.min_score and len(path) >= o.min_anchors:
            out.append((best, path[::-1]))
    return out


def chains_of(t: np.ndarray, q: np.ndarray, o: Options) -> list[tuple]:
    """``(score, cnt, qs, qe, rs, re, anchors)`` of one group of anchors in any order. With
    ``bw_long`` over the band, chains are linked again to longer ones."""
    order = np.lexsort((q, t))
    t, q = t[order], q[order]
    found = trace(*(link_ranges if o.rmq else link)(t, q, o), o)
    if o.bw_long > o.bw and found:  # the chains' anchors once more, by range maxima in the wider band
        used = np.sort(np.concatenate([a for _, a in found]))
        t, q, o = t[used], q[used], replace(o, bw=o.bw_long)
        found = trace(*link_ranges(t, q, o), o)
    return [(s, len(a), int(q[a[0]]), int(q[a[-1]]) + 1, int(t[a[0]]), int(t[a[-1]]) + 1, [(int(t[x]), int(q[x])) for x in a]) for s, a in found]


def _steps(rows: list[tuple]) -> pa.Array:
    """The anchors of chains, ``rows[i][9]``, as lists of ``(t_pos, q_pos)``."""
    ends = np.cumsum([0, *[len(r[9]) for r in rows]])
    flat = np.array([x for r in rows for x in r[9]], np.int32).reshape(-1, 2)
    places = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["t_pos", "q_pos"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)


def shared_time(began: int, n: np.ndarray) -> list[int]:
    """The microseconds since ``began``, by shares of ``n`` anchors that were chained together."""
    return ((time.perf_counter_ns() - began) / 1000 * n / max(n.sum(), 1)).astype(np.int64).tolist()


def chains(anchors: DataFrame, o: Options, steps: bool = False, clock: bool = False) -> DataFrame:
    """Chains of all groups; groups of too few anchors go before they are gathered. With
    ``steps`` each has its anchors, ``(t_pos, q_pos)`` in order; with ``clock`` there are
    :func:`clock.marks`. The groups of a batch are chained together where nothing asks for
    one at a time."""
    names = [f.split()[0] for f in FIELDS.split(", ")] + ["steps"] * steps
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()] + [pa.int32()] * 4

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            began = time.perf_counter_ns()
            flat = b.column("a").flatten()
            n = pc.list_value_length(b.column("a")).to_numpy()
            t, q = (flat.field(c).to_numpy().astype(np.int64) for c in ("t_pos", "q_pos"))
            g, *found = many_chains(np.repeat(np.arange(len(n)), n), t, q, o, _scores, link, trace, NONE)
            out = pa.record_batch([*[b.column(c).take(pa.array(g)) for c in names[:3]], *[pa.array(x).cast(k) for x, k in zip(found, types[3:])]], names=names)
            yield from marks(out, b.column("qid"), shared_time(began, n)) if clock else [out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, us = [], []
            for i in range(b.num_rows):
                began = time.perf_counter_ns()
                a = b.column("a")[i].values
                key = tuple(b.column(c)[i].as_py() for c in ("qid", "tid", "rev"))
                t, q = (a.field(c).to_numpy().astype(np.int64) for c in ("t_pos", "q_pos"))
                rows += [key + x for x in chains_of(t, q, o)]
                us.append((time.perf_counter_ns() - began) // 1000)
            out = pa.record_batch([*[pa.array([r[j] for r in rows], x) for j, x in enumerate(types)], *([_steps(rows)] if steps else [])], names=names)
            yield from marks(out, b.column("qid"), us) if clock else [out]

    groups = anchors.groupBy("qid", "tid", "rev").agg(F.count("*").alias("n"), F.collect_list(F.struct("t_pos", "q_pos")).alias("a"))
    run = run if steps or o.rmq or o.bw_long > o.bw else together
    return groups.where(F.col("n") >= o.min_anchors).drop("n").mapInArrow(run, FIELDS + ", steps array<struct<t_pos:int,q_pos:int>>" * steps + ", us long" * clock)


def fuzzy_lengths(steps: DataFrame, o: Options) -> DataFrame:
    """``(qid, tid, rev, chain, match_len, block_len)`` from the anchors of chains, rows with
    ``chain`` and both places: from the span on, each step adds the longer of its distances
    to the block, and to the match the shorter one twice, once cut to the span."""
    key = ["qid", "tid", "rev", "chain"]
    w = Window.partitionBy(*key).orderBy("t_pos", "q_pos")
    rows = steps.select(*key, (F.col("t_pos") - F.lag("t_pos").over(w)).alias("dt"), (F.col("q_pos") - F.lag("q_pos").over(w)).alias("dq"))
    short = F.least("dt", "dq")
    sums = {"match_len": short + F.least(short, F.lit(o.span)), "block_len": F.greatest("dt", "dq")}
    return rows.groupBy(*key).agg(*[(F.lit(o.span) + F.coalesce(F.sum(v), F.lit(0))).cast("long").alias(c) for c, v in sums.items()])


ORDER = ["score", "cnt", "tid", "rev", "rs", "qs", "re", "qe"]


def ranked(found: DataFrame) -> DataFrame:
    """Chains numbered within their query from 0, the best first."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("cnt"), *ORDER[2:])
    return found.withColumn("rank", F.row_number().over(w) - 1)


def parents_of(rows: list[tuple[int, int, int, int]], o: Options) -> list[list[int]]:
    """``[parent, subsc, n_sub]`` of ranked chains ``(qs, qe, score, cnt)``: a chain belongs
    to the first primary it overlaps by enough, unless too much of it is uncovered."""
    out, primary = [], []
    for i, (qs, qe, score, cnt) in enumerate(rows):
        near = [j for j in primary if rows[j][1] > qs and rows[j][0] < qe]
        bare, at = 0, qs
        for lo, hi in sorted(rows[j][:2] for j in near):
            bare, at = bare + max(lo - at, 0), max(at, hi)
        bare += max(qe - at, 0)
        parent = i
        for j in near:
            lo, hi = rows[j][:2]
            a, b = sorted((hi - lo, qe - qs))
            if (min(qe, hi) - max(qs, lo)) / a - bare / b > o.mask_level and bare <= o.mask_len:
                parent = j
                out[j][1] = max(out[j][1], score)
                out[j][2] += cnt >= rows[j][3]
                break
        if parent == i:
            primary.append(i)
        out.append([parent, 0, 0])
    return out


def worth_keeping(r: dict, parent: dict, o: Options) -> bool:
    """Whether a secondary may stay: of enough score and not its parent over again, or, if
    asked for, on the other strand and above the least score."""
    if r["score"] >= o.pri_ratio * parent["score"]:
        return any(r[c] != parent[c] for c in ("qs", "qe", "tid", "rs", "re"))
    return o.check_strand and r["rev"] != parent["rev"] and r["score"] > o.min_score


def covered(lo: np.ndarray, hi: np.ndarray, own: list[list[int]], o: Options) -> np.ndarray:
    """As :func:`parents_of`, for chains over ``lo`` to ``hi`` of the query: which of the
    primaries ``own`` (begin and end first) each belongs to, -1 if to none."""
    parent, bare, at = np.full(len(lo), -1), np.zeros(len(lo), np.int64), lo.copy()
    near = [(x[1] > lo) & (x[0] < hi) for x in own]
    for k in sorted(range(len(own)), key=lambda k: own[k][:2]):
        bare += np.where(near[k], np.maximum(own[k][0] - at, 0), 0)
        at = np.where(near[k], np.maximum(at, own[k][1]), at)
    bare += np.maximum(hi - at, 0)
    for k, (a, b, *_) in enumerate(own):
        less, more = np.minimum(b - a, hi - lo), np.maximum(b - a, hi - lo)
        hit = near[k] & ((np.minimum(hi, b) - np.maximum(lo, a)) / less - bare / more > o.mask_level) & (bare <= o.mask_len)
        parent[hit & (parent < 0)] = k
    return parent


class _Query:
    """The chains of one query that stay, as its ranked chains come in blocks: its primaries,
    each with its rank, the best score and the number of its secondaries, and few secondaries."""

    def __init__(self, o: Options):
        self.o, self.n, self.own, self.rows, self.sub, self.second = o, 0, [], [], [], []

    def add(self, c: dict[str, np.ndarray]) -> None:
        o, at, size, n = self.o, 0, 16, len(c["qs"])
        while at < n:
            part = {k: v[at : at + size] for k, v in c.items()}
            parent = covered(part["qs"].astype(np.int64), part["qe"].astype(np.int64), self.own, o)
            new = np.flatnonzero(parent < 0)
            end = int(new[0]) if len(new) else len(parent)
            self._secondaries({k: v[:end] for k, v in part.items()}, parent[:end])
            self.n += end
            if len(new):
                row = {k: int(v[end]) if v[end] is not None else None for k, v in part.items()}
                self.own.append([row["qs"], row["qe"]])
                self.rows.append(row | {"rank": self.n, "parent": self.n})
                self.sub.append([0, 0])
                self.n, end, size = self.n + 1, end + 1, 16
            else:
                size = min(4 * size, 4096)
            at += end

    def _secondaries(self, c: dict[str, np.ndarray], parent: np.ndarray) -> None:
        for k in np.unique(parent).tolist():
            mine = parent == k
            self.sub[k][0] = max(self.sub[k][0], int(c["score"][mine].max()))
            self.sub[k][1] += int((c["cnt"][mine] >= self.rows[k]["cnt"]).sum())
        if len(self.second) < self.o.best_n and len(parent):
            scores = np.array([r["score"] for r in self.rows])[parent]
            for i in np.flatnonzero((c["score"] >= self.o.pri_ratio * scores) | self.o.check_strand).tolist():
                row = {k: int(v[i]) if v[i] is not None else None for k, v in c.items()}
                if len(self.second) < self.o.best_n and worth_keeping(row, self.rows[parent[i]], self.o):
                    self.second.append(row | {"rank": self.n + i, "parent": self.rows[parent[i]]["rank"], "subsc": 0, "n_sub": 0})

    def kept(self, qid: int | None) -> list[dict]:
        own = [r | {"subsc": s, "n_sub": n} for r, (s, n) in zip(self.rows, self.sub)]
        return [r | {"qid": qid} for r in own + self.second]


def primaries(found: DataFrame, o: Options) -> DataFrame:
    """Ranked chains with ``parent, subsc, n_sub`` (a rank, the best secondary score, the
    secondaries of as many anchors); chains that are not selected go. The chains of one query
    pass through one task in blocks, which holds those that stay; only where all stay (at most
    half the query's anchors) they meet in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = sorted(b.column("a")[i].as_py(), key=lambda r: r["rank"])
                links = parents_of([(r["qs"], r["qe"], r["score"], r["cnt"]) for r in rows], o)
                keep = [r | {"qid": b.column("qid")[i].as_py(), "parent": p, "subsc": sub, "n_sub": int(n)} for r, (p, sub, n) in zip(rows, links)]
                yield pa.RecordBatch.from_pylist(keep, schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, qid, query = False, None, _Query(o)
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("qid")
            n_null = ids.null_count  # nulls come first
            keys = pc.fill_null(ids, 0).to_numpy()
            cuts = sorted({0, n_null, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), b.num_rows})
            columns = {c: b.column(c) for c in ("tid", "rev", "score", "cnt", "qs", "qe", "rs", "re")}
            columns = {c: x.to_numpy() if not x.null_count else np.array(x.to_pylist(), object) for c, x in columns.items()}
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if (now := ids[lo].as_py()) != qid or not begun:
                    if begun:
                        yield pa.RecordBatch.from_pylist(query.kept(qid), schema)
                    begun, qid, query = True, now, _Query(o)
                query.add({c: x[lo:hi] for c, x in columns.items()})
        if begun:
            yield pa.RecordBatch.from_pylist(query.kept(qid), schema)

    schema = pa.schema([("qid", pa.int64()), ("tid", pa.int64()), ("rev", pa.int32()), ("score", pa.int64()), ("cnt", pa.int64()), *[(c, pa.int32()) for c in ("qs", "qe", "rs", "re", "rank", "parent")], ("subsc", pa.int64()), ("n_sub", pa.int32())])
    names = f"{FIELDS}, rank int, parent int, subsc long, n_sub int"
    if o.all_chains or o.pri_ratio <= 0:
        one = F.struct("tid", "rev", "score", "cnt", "qs", "qe", "rs", "re", "rank")
        found = found if "rank" in found.columns else ranked(found)
        return found.groupBy("qid").agg(F.collect_list(one).alias("a")).mapInArrow(run, names)
    order = ["rank"] if "rank" in found.columns else [F.desc("score"), F.desc("cnt"), *ORDER[2:]]
    rows = found.repartition("qid").sortWithinPartitions("qid", *order)
    return rows.select(*[f.split()[0] for f in FIELDS.split(", ")]).mapInArrow(stream, names)


def mapq(score: Column, cnt: Column, subsc: Column, n_sub: Column, total: Column, rep_len: Column, o: Options, alignment: Column | None = None) -> Column:
    """Mapping quality 0 to 60: ``total`` is the query's sum of primary scores. With an
    ``alignment`` score that counts twice in place of the chain's; 0 if it isn't positive."""
    uniq = total / (total + rep_len)
    sure = F.least(F.when(score > 100, 1.0).otherwise(0.01 * score) * uniq, F.when(cnt > 10, 1.0).otherwise(0.1 * cnt))
    rival = F.greatest(subsc, F.lit(o.min_score)) / score
    worth = F.log(score) if alignment is None else F.when(alignment > 0, 2 * F.log(alignment)).otherwise(0.0)
    q = (sure * 40 * (1 - rival) * worth).cast("int") - (4.343 * F.log(n_sub + 1.0) + 0.499).cast("int")
    return F.greatest(F.least(q, F.lit(60)), F.lit(0))


def mapped(n: Column, best_q: Column, mean_q: Column, best_c: Column, mean_c: Column, o: Options, alignment: Column | None = None) -> Column:
    """Whether the best chain of a query is its mapping: a lone chain of enough quality, or
    a weighted sum over the threshold, or at the end of the read more than that quality.
    With the best ``alignment`` score of its chains: that is enough for a lone chain at
    ``dtw_min_score``, and takes the place of the quality in the sum, which then needs it
    (:func:`aligned_sum`)."""
    more = lambda mean, best: F.when(best > 0, F.greatest(F.lit(0.0), 1 - mean / best)).otherwise(0.0)
    if alignment is not None:
        by_sum = aligned_sum(best_q, mean_q, best_c, mean_c, alignment, o)
        return ((n == 1) & ((best_q >= o.min_mapq) | (alignment >= o.dtw_min_score))) | ((n > 1) & by_sum) | (best_q > o.min_mapq)
    total = o.w_bestq * F.least(best_q / 30, F.lit(1.0)) + o.w_bestmq * more(mean_q, best_q) + o.w_bestmc * more(mean_c, best_c)
    return ((n == 1) & (best_q >= o.min_mapq)) | ((n > 1) & (total >= o.w_threshold)) | (best_q > o.min_mapq)


def aligned_sum(best_q: Column, mean_q: Column, best_c: Column, mean_c: Column, alignment: Column, o: Options) -> Column:
    """Whether the weighted sum with the best ``alignment`` score is over the threshold;
    ``best_q`` and ``best_c`` are of the chain of that score, which must be high enough."""
    more = lambda mean, best: F.when(best > 0, F.greatest(F.lit(0.0), 1 - mean / best)).otherwise(0.0)
    total = o.w_bestma * F.greatest(alignment, F.lit(0.0)) / 50 + o.w_bestmq * more(mean_q, best_q) + o.w_bestmc * more(mean_c, best_c)
    return (alignment >= o.dtw_min_score) & (total >= o.w_threshold)


def decide(selected: DataFrame, rep: DataFrame | None, o: Options) -> DataFrame:
    """Selected chains with ``mapq`` (0 for secondaries) and ``mapped``, which holds for
    the best chain of a mapped query, or with ``all_chains`` for each one of the second
    score limit. ``rep`` gives the repeat length by ``qid``. With an
    ``alignment_score`` the mapping is the chain of the best one, the first by rank of equal
    ones, if the weighted sum says so; else the first by rank, by its quality."""
    w = Window.partitionBy("qid")
    own = F.col("parent") == F.col("rank")
    rows = selected.withColumn("rep_len", F.lit(0)) if rep is None else selected.join(rep, "qid", "left").fillna(0, ["rep_len"])
    scored = F.col("alignment_score") if "alignment_score" in selected.columns else None
    rows = rows.withColumn("total", F.sum(F.when(own, F.col("score")).otherwise(0)).over(w)).withColumn("n_chains", F.count("*").over(w).cast("int"))
    q = mapq(*[F.col(c) for c in ("score", "cnt", "subsc", "n_sub", "total", "rep_len")], o, scored)
    rows = rows.withColumn("mapq", F.when(own, q).otherwise(0))
    best = lambda c: F.max(F.when(F.col("rank") == 0, F.col(c))).over(w)
    n, mean_q, mean_c = F.count("*").over(w), F.avg("mapq").over(w), F.avg("score").over(w)
    if o.all_chains:
        rule = F.col("score") >= o.min_score2
    elif scored is None:
        rule = (F.col("rank") == 0) & mapped(n, best("mapq"), mean_q, best("score"), mean_c, o)
    else:
        rows = rows.withColumn("lead", F.max(F.struct(scored.alias("a"), (-F.col("rank")).alias("at"), F.col("mapq").alias("q"), F.col("score").alias("c"))).over(w))
        by_sum = aligned_sum(F.col("lead.q"), mean_q, F.col("lead.c"), mean_c, F.col("lead.a"), o)
        lone = (n == 1) & ((best("mapq") >= o.min_mapq) | (F.col("lead.a") >= o.dtw_min_score))
        rule = F.when(lone, F.col("rank") == 0).when(by_sum, F.col("rank") == -F.col("lead.at")).otherwise((F.col("rank") == 0) & (best("mapq") > o.min_mapq))
    return rows.withColumn("mapped", rule).drop("total", "lead")
