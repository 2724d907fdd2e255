"""Ranked search: against brute force, trees and bounds, blocks, edges."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverseed.llm import search
from riverseed.llm.search import Search, Tree, gain, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i % 900}" for i in range(30_000))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain(docs, items, k=10):
    bags = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(s for _, _, s in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        want = Counter(TERM.findall(lower(text or "")))
        scored = []
        for i, b, s in bags:
            m = 25 + 75 * s * n // total
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, c in want.items() if t in b)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyzüÉ"]
    pick = lambda m: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=m))
    docs = [(i, pick(rng.randrange(1, 60))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(150)]  # copies: equal vectors, ties by id
    docs += [(5, docs[5][1]), (None, docs[9][1]), (None, None), (900, None), (901, ""), (902, "... \x00 [] ~"), (903, LONG), (904, "ÉÉ-İx_ＡＢ 9a9 b")]
    items = [(i, pick(rng.randrange(1, 25))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "nowhere found"), (33, LONG[:2000]), (34, "9a9 B ÉÉ"), (34, items[3][1]), (3, items[3][1]), (None, items[4][1]), (35, "AX ax Ax")]
    return docs, items


def frames(spark, docs, items):
    clash = {c: F.lit(1) for c in ("n", "terms", "qid", "score", "rank", "part", "hits", "salt", "lang")}
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash), spark.createDataFrame(items, "item_id long, text string").withColumns({**clash, "doc_id": F.lit(0)})


@pytest.mark.parametrize("sizes", [(2000, 64, 32_768), (3, 2, 50), (10, 8, 7)])
def test_search_brute_force(spark, monkeypatch, sizes):
    for name, v in zip(("BLOCK_ITEMS", "LEAF", "TREE_DOCS"), sizes):
        monkeypatch.setattr(search, name, v)
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    got = search.ranked_search(d.repartition(5), i).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, items)


def test_search_edges(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    none_d, none_i = frames(spark, [], [])
    assert search.ranked_search(none_d, i).count() == 0 and search.ranked_search(d, none_i).count() == 0
    assert search.ranked_search(none_d, none_i).columns == ["item_id", "rank", "doc_id", "score"]
    one = search.ranked_search(*frames(spark, [(1, "a b"), (1, "a b")], [(1, "a a c")]), k=1).collect()
    assert [tuple(r)[:3] for r in one] == [(1, 1, 1)]


def grow(seed, n=400, n_terms=40):
    rng = np.random.default_rng(seed)
    rows = [np.sort(rng.choice(n_terms, rng.integers(0, 12), False, p=(w := 1 / np.arange(1, n_terms + 1)) / w.sum())) for _ in range(n)]
    rows[50:180] = [rows[3]] * 130
    first = np.r_[0, np.cumsum([len(r) for r in rows])]
    term = np.concatenate(rows).astype(np.int32)
    return rows, Tree(first, term, rng.integers(1, 9, len(term)).astype(np.int32), rng.integers(25, 400, n))


@pytest.mark.parametrize("seed", range(3))
def test_tree_nodes(seed, monkeypatch):
    monkeypatch.setattr(search, "LEAF", 5)
    rows, tree = grow(seed)
    assert [rows[i].tolist() for i in tree.order] == sorted(r.tolist() for r in rows)
    leaves = sorted((tree.lo[i], tree.hi[i]) for i in range(len(tree.lo)) if not tree.kids[i])
    assert [a for a, _ in leaves] == [0, *(b for _, b in leaves[:-1])] and leaves[-1][1] == len(rows)
    for i in range(len(tree.lo)):
        lo, hi = tree.lo[i], tree.hi[i]
        part = slice(tree.first[lo], tree.first[hi])
        most = {}
        for t, f in zip(tree.term[part].tolist(), tree.tf[part].tolist()):
            most[t] = max(most.get(t, 0), f)
        assert tree.m[i] == tree.factor[lo:hi].min() and dict(zip(*(x.tolist() for x in tree.most[i]))) == most
        if tree.kids[i]:
            kids = sorted((tree.lo[k], tree.hi[k]) for k in tree.kids[i])
            assert kids[0][0] == lo and kids[-1][1] == hi and all(a[1] == b[0] for a, b in zip(kids, kids[1:]))
        elif hi - lo > 5:
            assert len({tuple(rows[d]) for d in tree.order[lo:hi]}) == 1


@pytest.mark.parametrize("scale", [1, 10**11])
def test_bounds_hold_and_prune(scale, monkeypatch):
    """Beyond ``2**53`` the sums are of integers."""
    monkeypatch.setattr(search, "LEAF", 8)
    rows, tree = grow(7)
    first, term, weight = np.array([0, 2, 3, 3]), np.array([30, 39, 0]), np.array([7, 5, 3]) * scale
    found = Search(first, term, weight, 4, 40)
    exact = np.zeros((len(rows), 3), object)
    for d in range(len(rows)):
        for e in range(tree.first[d], tree.first[d + 1]):
            for q in range(3):
                for x in range(first[q], first[q + 1]):
                    if term[x] == tree.term[e]:
                        exact[d, q] += int(weight[x]) * int(gain(tree.tf[e : e + 1].astype(np.int64), tree.factor[d : d + 1])[0])
    live = np.array([0, 1])
    for i in range(len(tree.lo)):
        assert (found.bounds(tree, i, live) >= exact[tree.lo[i] : tree.hi[i], :2].max(0)).all()
    found.run(tree, np.arange(len(rows)), np.zeros(len(rows), bool))
    for q in range(2):
        want = sorted((-s, d) for d, s in enumerate(exact[:, q].tolist()) if s > 0)[:4]
        assert list(zip((-found.best[q][0]).tolist(), found.best[q][1].tolist())) == want
    assert not len(found.best[2][0]) and found.scored < len(rows)  # of 2 * len(rows) pairs


def test_terms():
    for t in ("a-b_C ÉéZ9", LONG[:500], "", "\x7f\x00", "x y"):
        assert [w.decode() for w in terms(t.encode())] == TERM.findall(lower(t))
