"""Chains of many groups of anchors at once.

Most groups have few anchors in each other's reach. Their links are found for all groups
together, by distance in the order of the target; a stretch in which an anchor has more
predecessors than are tried anyway is left to the rule for one group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _sorted(g: np.ndarray, t: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors by group, target place and query place; sorted as one number if it fits."""
    tb, qb = int(t.max()).bit_length(), int(q.max()).bit_length()
    if int(g.max()).bit_length() + tb + qb > 63:
        order = np.lexsort((q, t, g))
        return g[order], t[order], q[order]
    key = np.sort((g << tb + qb) | (t << qb) | q)
    return key >> tb + qb, (key >> qb) & ((1 << tb) - 1), key & ((1 << qb) - 1)


def _pairs(g: np.ndarray, t: np.ndarray, q: np.ndarray, o, scores: Callable, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, score)`` of the anchors that can link, by ``i`` and the nearest ``j`` first, and
    the anchors with more than ``max_iterations`` in reach or more than ``max_skips`` that can link."""
    reach, far = max(o.max_target_gap, o.bw), np.zeros(len(t), bool)
    at, found = np.arange(1, len(t)), []
    for d in range(1, o.max_iterations + 2):
        at = at[at >= d]
        at = at[(g[at] == g[at - d]) & (t[at] - t[at - d] <= reach)]
        if not len(at):
            break
        if d > o.max_iterations:
            far[at] = True
            break
        s = scores(q[at] - q[at - d], t[at] - t[at - d], o)
        ok = s > none
        found.append((at[ok], at[ok] - d, s[ok]))
    i, j, s = (np.concatenate([np.empty(0, np.int64), *[x[k] for x in found]]) for k in range(3))
    order = np.argsort(i, kind="stable")
    i, j, s = i[order], j[order], s[order]
    far |= np.bincount(i, minlength=len(t)) > o.max_skips
    return i, j, s, far


def _best_links(n: int, i: np.ndarray, j: np.ndarray, s: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Best score that ends in each anchor and its predecessor, over all its pairs, the nearest of
    equal ones. An anchor's turn comes once all that it can link to have had theirs."""
    f, p = np.full(n, span, np.int64), np.full(n, -1, np.int64)
    done = np.ones(n, bool)
    done[i] = False
    while len(i):
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        lengths = np.diff(np.r_[starts, len(i)])
        ready = np.repeat(np.logical_and.reduceat(done[j], starts), lengths)
        a, total = i[ready], s[ready] + f[j[ready]]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        top = np.maximum.reduceat(total, first)
        hit = np.flatnonzero(total == np.repeat(top, np.diff(np.r_[first, len(a)])))
        hit = hit[np.r_[True, a[hit][1:] != a[hit][:-1]]]
        better = top > span
        f[a[first[better]]] = top[better]
        p[a[first[better]]] = j[ready][hit[better]]
        done[a] = True
        i, j, s = i[~ready], j[~ready], s[~ready]
    return f, p


def many_chains(g: np.ndarray, t: np.ndarray, q: np.ndarray, o, scores: Callable, link: Callable, trace: Callable, none: int) -> tuple[np.ndarray, ...]:
    """``(g, score, cnt, qs, qe, rs, re)`` of the chains of all groups ``g`` of anchors at the
    places ``t`` and ``q``: those that ``trace(*link(...))`` gives for each group alone."""
    if not len(g):
        return tuple(np.empty(0, np.int64) for _ in range(7))
    g, t, q = _sorted(g, t, q)
    n, reach = len(t), max(o.max_target_gap, o.bw)
    i, j, s, far = _pairs(g, t, q, o, scores, none)
    cut = np.r_[True, (g[1:] != g[:-1]) | (t[1:] - t[:-1] > reach)]  # no link leads from one stretch to the next
    stretch = np.cumsum(cut) - 1
    hard = np.zeros(stretch[-1] + 1, bool)
    hard[stretch[far]] = True
    easy = ~hard[stretch[i]]
    f, p = _best_links(n, i[easy], j[easy], s[easy], o.span)
    starts = np.r_[np.flatnonzero(cut), n]
    for k in np.flatnonzero(hard).tolist():
        lo, hi = starts[k], starts[k + 1]
        fk, pk = link(t[lo:hi], q[lo:hi], o)
        f[lo:hi], p[lo:hi] = fk, np.where(pk < 0, -1, pk + lo)
    return _traced(g, t, q, f, p, o, trace)


def _traced(g: np.ndarray, t: np.ndarray, q: np.ndarray, f: np.ndarray, p: np.ndarray, o, trace: Callable) -> tuple[np.ndarray, ...]:
    """Chains of linked anchors. Anchors that hang together without a fork, with scores that
    rise, are one chain; the others are traced."""
    n = len(t)
    linked = np.flatnonzero(p >= 0)
    if o.min_anchors <= 1:
        member = np.ones(n, bool)
    else:
        member = np.zeros(n, bool)
        member[linked] = member[p[linked]] = True
    at = np.flatnonzero(member)
    if not len(at):
        return tuple(np.empty(0, np.int64) for _ in range(7))
    new = np.cumsum(member) - 1
    f, up = f[at], np.where(p[at] < 0, -1, new[p[at]])
    root = np.where(up < 0, np.arange(len(at)), up)
    while not np.array_equal(after := root[root], root):
        root = after
    own = up >= 0
    children = np.bincount(up[own], minlength=len(at))
    odd = children > 1
    odd[np.flatnonzero(own)[f[own] <= f[up[own]]]] = True
    mixed = np.zeros(len(at), bool)
    mixed[root[odd]] = True
    mixed = mixed[root]
    size = np.bincount(root, minlength=len(at))
    end = np.flatnonzero((children == 0) & ~mixed)
    end = end[(f[end] >= o.min_score) & (size[root[end]] >= o.min_anchors)]
    first = root[end]
    out = [g[at[end]], f[end], size[first], q[at[first]], q[at[end]] + 1, t[at[first]], t[at[end]] + 1]
    if mixed.any():
        rest = np.flatnonzero(mixed)
        rest = rest[np.argsort(root[rest], kind="stable")]
        cuts = np.r_[np.flatnonzero(np.r_[True, root[rest][1:] != root[rest][:-1]]), len(rest)]
        rows, place = [], np.empty(len(at), np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = rest[lo:hi]
            place[part] = np.arange(hi - lo)
            back = np.where(up[part] < 0, -1, place[up[part]])
            for score, path in trace(f[part], back, o):
                a, b = at[part[path[0]]], at[part[path[-1]]]
                rows.append((g[a], score, len(path), q[a], q[b] + 1, t[a], t[b] + 1))
        if rows:
            out = [np.r_[x, np.array(y, np.int64)] for x, y in zip(out, zip(*rows))]
    return tuple(x.astype(np.int64) for x in out)
