"""Ranked lexical search with a frequency-pattern tree of the documents.

Terms are the items' words; a document's vector holds how often it has each of them,
ordered by falling document frequency. One pass over the texts writes the vectors and
lengths; the numbers of documents and terms and the terms' document frequencies are
aggregates of that table. A second pass searches: each task deals its rows into trees of
bounded size. A tree is the vectors in order, so that documents with the same beginning
share a path; a node is a run of documents with one path, runs of few documents are its
leaves. Each node keeps the most occurrences of every term below it and the least length
factor ``m``, so no document below scores more than the node's bound. Items go down
together, depth first and best bound first, each only where its bound may still reach its
ten best; leaves are scored exactly. The ten best of a task go on to its next tree, those
of the tasks are merged by two windows, the first of which takes the roots of the tasks
apart so that no task sorts all results of an item.

A term's contribution is ``w * ((10**9 tf) div (1000 tf + 8 m))``, which grows with ``tf``
and falls with ``m``. Sums of a leaf are products of float matrices while no sum can reach
``2**53`` (then they are exact), and of integers beyond.

Items are searched in blocks: a block's distinct texts have at most ``BLOCK_BYTES`` (one
text at least) and ``BLOCK_ITEMS`` on average, so what is sent to tasks is bounded; the
documents are read once for each block.

Edge cases: null, empty and wordless texts are no documents and, as items, find nothing;
each row of documents is a document and each row of items an item, so repeated rows repeat
in results; equal scores go by id, null ids last; ids are cast to long; without documents
or items there are no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import skew_join, slices, stash, utf8

#: Items, and bytes of their texts, that are searched at once.
BLOCK_ITEMS, BLOCK_BYTES = 2000, 2 << 20
#: Documents of a leaf; vector entries and documents of a tree.
LEAF, TREE_ENTRIES, TREE_DOCS = 64, 2_000_000, 32_768

# Bytes that separate terms, and A-Z as a-z.
_BREAKS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
TABLE = bytes(32 if b in _BREAKS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def vectors(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of each document with a term; ``terms`` are numbers of
    ``known`` ones, ascending."""

    def read(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                split = [terms(t) for t in utf8(piece.column("text"))]
                n = np.fromiter(map(len, split), np.int64, len(split))
                flat = [t for ts in split for t in ts]
                ids = np.fromiter(map(known.get, flat, repeat(-1)), np.int64, len(flat))
                doc = np.repeat(np.arange(len(split)), n)[ids >= 0]
                key, tf = np.unique(doc * (len(known) + 1) + ids[ids >= 0], return_counts=True)
                held = np.bincount(key // (len(known) + 1), minlength=len(split))
                ends = pa.array(np.r_[0, np.cumsum(held)].astype(np.int32))
                cols = [piece.column("doc_id"), pa.array(n)]
                cols += [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (key % (len(known) + 1), tf)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    rows = docs.select(F.expr("try_cast(doc_id AS long)").alias("doc_id"), "text")
    return rows.mapInArrow(read, "doc_id long, n long, terms array<int>, tfs array<int>")


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """Documents ``(first, term, tf, m)`` in the order of their vectors, terms by rank.

    ``lo``, ``hi``: a node's documents; ``kids``: its child nodes (none for a leaf);
    ``m``: the least factor below; ``most``: terms below and their most occurrences."""

    def __init__(self, first: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray):
        size = np.diff(first)
        raw = term.astype(">u4").tobytes()
        keys = [raw[4 * a : 4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        self.order = np.array(sorted(range(len(size)), key=keys.__getitem__), np.int64)
        size = size[self.order]
        self.first = np.r_[0, np.cumsum(size)]
        take = np.repeat(first[self.order] - self.first[:-1], size) + np.arange(self.first[-1])
        self.term, self.tf, self.factor = term[take], tf[take], m[self.order]
        self.lo, self.hi, self.kids = [], [], []
        self._split(size)
        self._sum_up(size)

    def _split(self, size: np.ndarray) -> None:
        todo = [(0, len(size), 0, -1)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            node = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(node)
            if hi - lo <= LEAF:
                continue
            # the documents are in order: one path is shared as long as the first and the last have it
            a, b = self.term[self.first[lo] : self.first[lo + 1]], self.term[self.first[hi - 1] : self.first[hi]]
            both = min(len(a), len(b))
            apart = np.flatnonzero(a[depth:both] != b[depth:both])
            depth = depth + int(apart[0]) if len(apart) else both
            here = np.where(size[lo:hi] > depth, self.term[np.minimum(self.first[lo:hi] + depth, len(self.term) - 1)].astype(np.int64), -1)
            cuts = [lo, *(np.flatnonzero(np.diff(here)) + 1 + lo).tolist(), hi]
            if len(cuts) == 2:
                continue  # equal vectors: one leaf
            start = cuts[0]
            for cut, after in zip(cuts[1:], [*cuts[2:], None], strict=True):  # small neighbours are one leaf
                if after is None or after - start > LEAF:
                    whole = here[start - lo] == here[cut - 1 - lo] and here[start - lo] >= 0
                    todo.append((start, cut, depth + 1 if whole else depth, node))
                    start = cut

    def _sum_up(self, size: np.ndarray) -> None:
        self.m, self.most = [0] * len(self.lo), [None] * len(self.lo)
        for node in range(len(self.lo) - 1, -1, -1):  # children come after their parents
            if self.kids[node]:
                parts = [self.most[k] for k in self.kids[node]]
                t, f = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                self.m[node] = min(self.m[k] for k in self.kids[node])
            else:
                part = slice(self.first[self.lo[node]], self.first[self.hi[node]])
                t, f = self.term[part], self.tf[part]
                self.m[node] = int(self.factor[self.lo[node] : self.hi[node]].min())
            by = np.argsort(t, kind="stable")
            t = t[by]
            at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.empty(0, np.int64)
            self.most[node] = (t[at], np.maximum.reduceat(f[by], at) if len(at) else f)


class Search:
    """Items as weights ``(first, term, weight)`` of terms by rank, each with its best
    documents so far."""

    def __init__(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, n_terms: int):
        self.first, self.term, self.weight, self.k = first, term, weight, k
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in range(len(first) - 1)]
        self.floor = np.ones(len(first) - 1, np.int64)  # what a document must score to be looked at
        self.dense, self.at = np.zeros(n_terms, np.int64), np.full(n_terms, -1, np.int64)
        self.scored = self.bounded = 0

    def _terms(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the terms of live items are, and each one's number among them."""
        size = self.first[live + 1] - self.first[live]
        start = np.cumsum(size) - size
        return np.repeat(self.first[live] - start, size) + np.arange(size.sum()), np.repeat(np.arange(len(live)), size)

    def bounds(self, tree: Tree, node: int, live: np.ndarray) -> np.ndarray:
        t, f = tree.most[node]
        self.dense[t] = gain(f.astype(np.int64), tree.m[node])
        at, _ = self._terms(live)
        size = self.first[live + 1] - self.first[live]
        out = np.add.reduceat(self.weight[at] * self.dense[self.term[at]], np.cumsum(size) - size)
        self.dense[t] = 0
        self.bounded += 1
        return out

    def run(self, tree: Tree, ids: np.ndarray, none: np.ndarray) -> None:
        """Go down ``tree`` with all items; ``ids`` and ``none`` (no id) of its documents."""
        every = np.flatnonzero(np.diff(self.first) > 0)
        if not len(every):
            return
        todo = [(0, every, self.bounds(tree, 0, every))]
        while todo:
            node, live, bound = todo.pop()
            reach = bound >= self.floor[live]
            live, bound = live[reach], bound[reach]
            if not len(live):
                continue
            if not tree.kids[node]:
                self._leaf(tree, node, live, bound, ids, none)
                continue
            found = [(k, live, self.bounds(tree, k, live)) for k in tree.kids[node]]
            todo += sorted(found, key=lambda x: int((x[2] - self.floor[live]).max()))

    def _leaf(self, tree: Tree, node: int, live: np.ndarray, bound: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        lo, hi = tree.lo[node], tree.hi[node]
        self.scored += (hi - lo) * len(live)
        kind = np.float64 if int(bound.max()) < 2**53 else np.int64
        t = tree.most[node][0]
        self.at[t] = np.arange(len(t))
        place, item = self._terms(live)
        col = self.at[self.term[place]]
        has = col >= 0
        weights = np.zeros((len(t), len(live)), kind)
        weights[col[has], item[has]] = self.weight[place[has]]
        for a in range(lo, hi, LEAF * 4):  # many equal vectors make a large leaf
            b = min(a + LEAF * 4, hi)
            part = slice(tree.first[a], tree.first[b])
            doc = np.repeat(np.arange(b - a), np.diff(tree.first[a : b + 1]))
            values = np.zeros((b - a, len(t)), kind)
            values[doc, self.at[tree.term[part]]] = gain(tree.tf[part].astype(np.int64), tree.factor[a:b][doc])
            scores = values @ weights
            for i in np.flatnonzero((scores >= self.floor[live]).any(0)).tolist():
                rows = np.flatnonzero(scores[:, i] >= self.floor[live[i]])
                self._offer(int(live[i]), scores[rows, i].astype(np.int64), ids[a:b][rows], none[a:b][rows])
        self.at[t] = -1

    def _offer(self, item: int, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        score, ids, none = (np.concatenate(x) for x in zip(self.best[item], (score, ids, none), strict=True))
        keep = np.lexsort((ids, none, -score))[: self.k]
        self.best[item] = score[keep], ids[keep], none[keep]
        if len(keep) == self.k:
            self.floor[item] = max(int(score[keep[-1]]), 1)


def _trees(batches: Iterator[pa.RecordBatch], rank: np.ndarray, n_docs: int, n_terms: int) -> Iterator[tuple[Tree, np.ndarray, np.ndarray]]:
    """Trees of the rows of :func:`vectors`, with the ids of their documents."""
    held, entries, docs = [], 0, 0

    def grown() -> tuple[Tree, np.ndarray, np.ndarray]:
        ids, none, n, size, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        term = rank[term]
        by = np.lexsort((term, np.repeat(np.arange(len(size)), size)))
        m = 25 + (75 * n * n_docs // n_terms if 75 * int(n.max()) * n_docs < 2**63 else np.array([75 * int(x) * n_docs // n_terms for x in n], np.int64))
        tree = Tree(np.r_[0, np.cumsum(size)], term[by], tf[by], m)
        return tree, ids[tree.order], none[tree.order]

    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            ids, lists = part.column("doc_id"), part.column("terms")
            none = ids.is_null().to_numpy(zero_copy_only=False)
            row = (ids.fill_null(0).to_numpy(), none, part.column("n").to_numpy(), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), part.column("tfs").flatten().to_numpy())
            held.append(row)
            entries, docs = entries + len(row[4]), docs + len(none)
            if entries >= TREE_ENTRIES or docs >= TREE_DOCS:
                yield grown()
                entries = docs = 0
    if held:
        yield grown()


def _search_block(docs: DataFrame, queries: list[tuple[int, bytes]], k: int) -> DataFrame:
    """``(qid, doc_id, score, part)``: the best documents of each task for each item."""
    bags = [Counter(terms(t)) for _, t in queries]
    names = sorted(set().union(*bags))
    known = {t: i for i, t in enumerate(names)}
    rows = stash(vectors(docs, known), "vectors")
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's terms
        df[r.t] = r["count"]
    rank = np.empty(len(names), np.int32)
    rank[np.lexsort((np.arange(len(names)), -df))] = np.arange(len(names), dtype=np.int32)
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()]
    lists = [sorted((int(rank[known[t]]), c * weight[known[t]]) for t, c in bag.items()) for bag in bags]
    first = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
    term = np.array([t for x in lists for t, _ in x], np.int64)
    worth = np.array([w for x in lists for _, w in x], np.int64)
    ids = np.array([q for q, _ in queries], np.int64)

    def search(batches):
        from pyspark import TaskContext

        found = Search(first, term, worth, k, len(rank))
        for tree, doc_ids, none in _trees(batches, rank, n_docs, n_terms):
            found.run(tree, doc_ids, none)
        size = [len(b[0]) for b in found.best]
        score, doc, none = (np.concatenate([b[i] for b in found.best]) for i in range(3))
        cols = [pa.array(np.repeat(ids, size)), pa.array(doc, pa.int64(), mask=none), pa.array(score), pa.array(np.full(len(doc), TaskContext.get().partitionId(), np.int32))]
        if len(doc):
            yield pa.RecordBatch.from_arrays(cols, ["qid", "doc_id", "score", "part"])

    return rows.select("doc_id", "n", "terms", "tfs").mapInArrow(search, "qid long, doc_id long, score long, part int")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", "text").where("text IS NOT NULL")
    texts = stash(asked.select("text").distinct().select("text", F.monotonically_increasing_id().alias("qid")), "items")
    count, held = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not count:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    blocks = max(math.ceil(count / BLOCK_ITEMS), math.ceil(held / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("text"), F.lit(blocks))
    found = None
    for b in range(blocks):
        queries = [(r.qid, r.text.encode()) for r in texts.where(block == b).collect()]
        if queries:
            here = stash(_search_block(docs, queries, k), "found")
            found = here if found is None else found.unionByName(here)
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.col("part") % math.isqrt(parts))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "salt").orderBy(*best))).where(F.col("rank") <= k)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*best))).where(F.col("rank") <= k)
    lists = top.groupBy("qid").agg(F.collect_list(F.struct("rank", "doc_id", "score")).alias("hits"))  # at most k
    lists = stash(texts.join(lists, "qid").select("text", "hits"), "hits")
    return skew_join(asked, lists, ["text"]).select("item_id", F.inline("hits")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
