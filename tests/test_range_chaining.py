"""Range maxima and the chaining on them against the rule tried pair by pair."""

import math
import random
import time

import numpy as np
import pytest

from riverseed.functions.range_max import RangeMaxima
from riverseed.operators import chain
from riverseed.options import options


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_range_maxima(n):
    rng = random.Random(n)
    tree, held, places = RangeMaxima(n), {}, list(range(n))
    rng.shuffle(places)
    for _ in range(400):
        item = rng.randrange(n)
        if item in held:
            tree.drop(item, places[item])
            del held[item]
        else:
            held[item] = rng.choice([1.0, 2.0, rng.random()])
            tree.insert(item, places[item], held[item])
        assert len(tree) == len(held) and (item in tree) == (item in held)
        lo = rng.randrange(n)
        hi = rng.randrange(lo, n)
        inside = [(-w, i) for i, w in held.items() if lo <= places[i] <= hi]
        assert tree.best(lo, hi) == (min(inside)[1] if inside else -1)
    assert tree.best(0, n - 1) == (min((-w, i) for i, w in held.items())[1] if held else -1)


def plain(t, q, o):
    """The rule, one pair at a time; no tree, no blocks."""
    n, reach = len(t), max(o.max_target_gap, o.max_query_gap, o.bw)
    inner = o.rmq_inner if 0 < o.rmq_inner < reach else 0
    f, p = [o.span] * n, [-1] * n

    def score(i, j):
        dq, dr = q[i] - q[j], t[i] - t[j]
        dd, dg = abs(dr - dq), min(dr, dq)
        cost = math.trunc(o.gap * dd + o.skip * dg + 0.5 * math.log2(dd + 1)) if dd or dg > o.span else 0
        return f[j] + min(o.span, dg) - cost, dd, dd == 0 and dg <= o.span

    for i in range(n):
        before = [j for j in range(i) if t[j] < t[i]]
        far = [j for j in before if t[i] - t[j] <= reach][-o.rmq_cap :]
        near = [j for j in before if t[i] - t[j] <= inner][-o.rmq_cap :]
        far = [j for j in far if 0 <= q[i] - q[j] <= reach]
        if not far:
            continue
        j = min(far, key=lambda j: (-(float(f[j]) + 0.5 * o.gap * (t[j] + q[j])), j))
        s, width, exact = score(i, j)
        best, pick = (s, j) if width <= o.bw and s > o.span else (o.span, -1)
        if inner and not exact:
            seen, skips = set(), 0
            for j in sorted((j for j in near if 1 <= q[i] - q[j] <= inner), key=lambda j: (-q[j], -j)):
                s, width, _ = score(i, j)
                if width > o.bw:
                    continue
                if s > best:
                    best, pick, skips = s, j, max(skips - 1, 0)
                elif j in seen:
                    skips += 1
                    if skips > o.max_skips:
                        break
                if p[j] >= 0:
                    seen.add(p[j])
        f[i], p[i] = best, pick
    return f, p


def anchors(seed, n, spread):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.integers(0, spread, n))
    q = np.where(rng.random(n) < 0.7, t + rng.integers(-30, 30, n) + 40 * (t > spread // 2), rng.integers(0, spread, n))
    q = np.abs(q)
    order = np.lexsort((q, t))
    return t[order], q[order]


CASES = [{}, {"rmq_inner": 0}, {"rmq_inner": 40, "max_skips": 0}, {"bw": 20, "max_target_gap": 60, "max_query_gap": 90, "rmq_inner": 30}, {"rmq_cap": 7}, {"gap_scale": 9.0, "skip_scale": 4.0}, {"rmq_inner": 10**9}]


@pytest.mark.parametrize("more", CASES)
@pytest.mark.parametrize("seed", range(4))
def test_ranges_equal_the_pairwise_rule(more, seed):
    o = options(rmq=True, **{"rmq_inner": 200, "bw": 100, **more})
    t, q = anchors(seed, 260, (150, 600, 3000, 50)[seed])
    f, p = chain.link_ranges(t, q, o)
    assert (f.tolist(), p.tolist()) == plain(t.tolist(), q.tolist(), o)


def test_second_pass_joins_chains():
    """Two stretches 300 off each other's diagonal: apart within the band, one chain in the wider one."""
    t = np.r_[np.arange(0, 400, 5), np.arange(900, 1300, 5)]
    q = np.r_[np.arange(0, 400, 5), np.arange(600, 1000, 5)]
    o = options(bw=100, gap_scale=0.1)
    apart, joined = chain.chains_of(t, q, o), chain.chains_of(t, q, options(bw=100, bw_long=500, gap_scale=0.1))
    assert [x[1] for x in apart] == [80, 80] and [x[1] for x in joined] == [160]
    assert joined[0][2:6] == (0, 996, 0, 1296) and chain.chains_of(t, q, options(bw=100, bw_long=100, gap_scale=0.1)) == apart
    assert chain.chains_of(t[:1], q[:1], options(bw_long=900, min_anchors=2)) == []


@pytest.mark.parametrize("spread", [2000, 400_000])
def test_many_anchors_of_one_group(spread):
    """100,000 anchors, also where all of them are in reach of each other."""
    t, q = anchors(9, 100_000, spread)
    began = time.time()
    f, p = chain.link_ranges(t, q, options(rmq=True))
    assert time.time() - began < 60 and (p < np.arange(len(p))).all() and f.max() > 1000
