"""MinHash near duplicates by a multi-index Hamming join over b-bit signatures.

Each distinct shingle set gets ``6 * chunks`` MinHash values of 16 bits. Two
sets whose signatures differ in at most ``2 * chunks - 1`` places have, by the
pigeonhole principle, a chunk of six values with at most one difference. All
six ways of leaving one value of a chunk out are enumerated as keys, so every
pair below that distance shares a key. With the default 32 chunks (192 values,
distance 63) a pair of Jaccard similarity exactly 0.8 is beyond the distance
with probability about 3e-6, a more similar one with less. Candidates are then
confirmed on the full sets.

Equal sets are one node from the start. A large group of near copies isn't
expanded into pairs:

1. Nodes are ranked by the sizes of their keys, and in each key the first leads. Of
   its keys' leaders a node takes the first as its head, if a fifth of their
   signatures agrees, and both full sets are compared: a link or not, and the
   node's edits, the shingles that only one of the two has.
2. Of two nodes of one head the similarity follows from sizes and the number of
   edits that they share; if one isn't linked to the head, a link needs some.
   How many bounds a prefix of each node's edits, rarest first, and only nodes
   that share an edit of that prefix are compared, exactly.
3. Nodes of different heads are compared when they share a key and no component:
   in each key, the nodes outside the most frequent family with all others.

So every pair below the signature distance is linked, rejected by its full sets,
or within one component already.

Edge cases: null or empty text, or text without words, is an empty set and
linked with nothing; with fewer words than a shingle the whole sequence is one
shingle; repeated rows are copies; a null ``doc_id`` counts as larger than all
others. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, forest_roots, partitions, skew_join, slices, stash, utf8

WIDTH = 6
#: Rows of node keys that may be broadcast (16 bytes each).
BROADCAST_ROWS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles."""
    split = [t.lower().split() for t in texts]  # bytes: A-Z and ASCII white space only
    flat = [w for ws in split for w in ws]
    if not flat:
        return [np.empty(0, np.uint64) for _ in texts]
    h = pd.util.hash_array(np.array(flat, dtype=object), categorize=False).astype(np.uint64)
    out, at = [], 0
    for ws in split:
        n = len(ws)
        own, at = h[at : at + n], at + n
        k = min(size, n)
        if not k:
            out.append(np.empty(0, np.uint64))
            continue
        x = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            x = _mix(x * _MIX + own[i : n - k + 1 + i])
        out.append(np.unique(x))
    return out


def signature(x: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """16-bit MinHash values of a set of 64-bit hashes."""
    low = (x >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        least = np.minimum(least, (low[i : i + 512, None] * factors[None, :]).min(0))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _factors(chunks: int) -> np.ndarray:
    return (np.random.default_rng(2024).integers(0, 1 << 32, WIDTH * chunks, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def _signed(docs: DataFrame, size: int, chunks: int) -> DataFrame:
    """A row for each document: set size, 128-bit set fingerprint and signature."""
    factors = _factors(chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets = shingle_sets(utf8(b.column("text")), size)
                f1 = [int(np.bitwise_xor.reduce(_mix(x + _MIX))) if len(x) else 0 for x in sets]
                f2 = [int(np.add.reduce(_mix(x ^ _MIX))) if len(x) else 0 for x in sets]
                yield pa.record_batch(
                    [b.column("doc_id"), b.column("text_key"), pa.array([len(x) for x in sets], pa.int64()),
                     pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)),
                     pa.array([signature(x, factors).tobytes() if len(x) else None for x in sets], pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "f1", "f2", "sig"],
                )

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key"))
    return src.mapInArrow(run, "doc_id long, text_key long, n_shingles long, f1 long, f2 long, sig binary")


def _keyed(nodes: DataFrame, chunks: int) -> DataFrame:
    """``(key, node, n)``: the six keys of each chunk of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _mix(np.arange(1, chunks + 1, dtype=np.uint64) * _MIX)[None, :]
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, chunks, WIDTH).astype(np.uint64)
                keys = []
                for out in range(WIDTH):
                    x = chunk + np.uint64(out + 1)
                    for i in range(WIDTH):
                        if i != out:
                            x = _mix(x * _MIX + sig[:, :, i])
                    keys.append(x)
                keys = np.concatenate(keys, axis=1)
                per = keys.shape[1]
                node = b.column("node").to_numpy(zero_copy_only=False)
                n = b.column("n_shingles").to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(node, per)), pa.array(np.repeat(n, per).astype(np.int32))], names=["key", "node", "n"])

    return nodes.select("node", "n_shingles", "sig").mapInArrow(run, "key long, node long, n int")


_RUN = "key long, node long, n int, pop long, rep long, rep_n int, rep_pop long, place long"


def _shared(keyed: DataFrame, n_parts: int, order: list) -> DataFrame:
    """The rows ``(key, node, n, pop)`` of keys of two nodes or more, with the key's
    first row in ``order`` as ``rep`` and the row's place among them. One shuffle;
    runs of a key are followed across batches and never held."""
    names = [x.split(" ")[0] for x in _RUN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last run's key, its first node, n and pop, whether that row is out, and its length
        for b in batches:
            if not b.num_rows:
                continue
            key, *rest = (b.column(c).to_numpy(zero_copy_only=False) for c in names[:4])
            first = np.r_[True, key[1:] != key[:-1]]
            carried = last is not None and key[0] == last[0]
            starts = np.flatnonzero(first)
            run_of = np.cumsum(first) - 1
            reps = [x[starts] for x in rest]
            size = np.diff(np.r_[starts, len(key)])
            place = np.arange(len(key)) - starts[run_of]
            if carried:
                place[: size[0]] += last[3]
                size[0] += last[3]
                for r, v in zip(reps, last[1], strict=True):
                    r[0] = v
            keep = size[run_of] > 1
            cols = [key[keep], *[x[keep] for x in rest], *[r[run_of][keep] for r in reps], place[keep]]
            if carried and not last[2]:
                cols = [np.r_[np.array([v], c.dtype), c] for v, c in zip((last[0], *last[1], *last[1], 0), cols, strict=True)]
            last = (key[-1], [r[-1] for r in reps], bool(size[-1] > 1), int(size[-1]))
            yield pa.record_batch([pa.array(c) for c in cols], names=names)

    return keyed.select("key", "node", "n", "pop").repartition(n_parts, "key").sortWithinPartitions("key", *order).mapInArrow(run, _RUN)


def _close(pairs: DataFrame, nodes: DataFrame, distance: int) -> DataFrame:
    """Of pairs ``(a, b, w)`` of nodes those with signatures within the distance."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield b.select(["a", "b", "w"]).filter(pa.array((x != y).sum(1) <= distance))

    sigs = nodes.select("node", "sig")
    both = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")
    return both.select("a", "b", "w", "sig_a", "sig_b").mapInArrow(near, "a long, b long, w int")


def _compared(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes compared on their full sets: set sizes, ``both`` in
    common, ``linked``, and the ``edits``, hashes that only one has."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text_b"):
                xs, ys = (shingle_sets(utf8(b.column(c)), size) for c in ("text_a", "text_b"))
                edits = [np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in zip(xs, ys, strict=True)]
                n_a, n_b, n_e = (np.fromiter(map(len, v), np.int64, b.num_rows) for v in (xs, ys, edits))
                both = (n_a + n_b - n_e) // 2
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_e)].astype(np.int32)), pa.array(np.concatenate(edits)))
                cols = [b.column("a"), b.column("b"), pa.array(n_a), pa.array(n_b), pa.array(both), pa.array(100 * both >= percent * (n_a + n_b - both)), lists]
                yield pa.record_batch(cols, names=["a", "b", "n_a", "n_b", "both", "linked", "edits"])

    pairs = pairs.select("a", "b")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stash(nodes.join(ends, "node").select("node", F.coalesce("doc_id", F.lit(-1)).alias("doc_key"), "text_key"), "ends")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_key"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    texts = stash(rows.join(bounded(wanted, BROADCAST_ROWS), ["doc_key", "text_key"]).select("node", "text").dropDuplicates(["node"]), "texts")
    full = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(alike, "a long, b long, n_a long, n_b long, both long, linked boolean, edits array<long>")


def _within_families(family: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between nodes of one head of which one isn't linked to it.

    With head size m, removed r and added d shingles of each node, two nodes have
    ``m - r1 - r2 + s`` shingles in common, s being the edits that they share. For
    a node not linked to the head, any partner y needs more than
    ``c * (n_y - m) + r_y`` shared edits, where ``c = percent / (100 + percent)``.
    """
    c = percent / (100 + percent)
    stray = family.where("NOT linked")
    rows = stash(family.join(stray.select("a").distinct(), "a", "left_semi").selectExpr("a AS head", "b AS node", "n_a AS m", "n_b AS n", "n_a - both AS r", "linked", "edits"), "family")
    node = ["head", "node", "linked", "m", "n", "r", "prefix", "total"]
    flat = rows.withColumn("prefix", F.expr(f"size(edits) - cast(floor({c!r}D * (n - m) + r + 1e-9D) AS int)")).withColumn("total", F.size("edits")).select(*node, F.explode("edits").alias("edit"))
    counts = flat.groupBy("head", "edit").agg(F.count("*").alias("freq"), F.count_if(~F.col("linked")).alias("strays")).where("freq > 1 AND strays > 0").drop("strays")
    # an edit that no other node has, or no stray node, matches nothing and isn't joined; it stays in the order as the rarest
    seen = flat.join(counts, ["head", "edit"]).groupBy(*node).agg(F.sort_array(F.collect_list(F.struct("freq", "edit"))).alias("e"))
    seen = seen.withColumn("alone", F.col("total") - F.size("e"))
    seen = stash(seen.withColumn("k", F.size("e")), "edits")
    left = seen.where("NOT linked").select("head", "m", F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("r").alias("r_x"), F.col("k").alias("k_x"), F.posexplode("e.edit").alias("at_x", "edit"))
    kept = F.slice("e", F.lit(1), F.greatest(F.least(F.col("prefix").cast("long") - F.col("alone"), F.col("k").cast("long")), F.lit(0).cast("long")).cast("int"))
    right = seen.withColumn("e", kept).select("head", F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("r").alias("r_y"), F.col("k").alias("k_y"), F.col("linked").alias("linked_y"), F.posexplode("e.edit").alias("at_y", "edit"))
    # at the first edit that a pair shares, what is left of both lists must do
    needed = f"ceil({c!r}D * (n_x + n_y) - 1e-9D) - m + r_x + r_y"
    may = f"least(k_x - at_x, k_y - at_y) >= {needed} AND 100 * least(n_x, n_y) >= {int(percent)} * greatest(n_x, n_y) AND x != y AND (linked_y OR x < y)"
    pairs = left.join(right, ["head", "edit"]).where(may).select("head", "x", "y").distinct()
    side = lambda p: rows.select("head", F.col("node").alias(p), "m", *[F.col(k).alias(f"{k}_{p}") for k in ("n", "r", "edits")])
    both = pairs.join(side("x"), ["head", "x"]).join(side("y").drop("m"), ["head", "y"])
    common = F.col("m") - F.col("r_x") - F.col("r_y") + F.size(F.array_intersect("edits_x", "edits_y"))
    return both.withColumn("i", common).where(f"100 * i >= {int(percent)} * (n_x + n_y - i)").select(F.col("x").alias("a"), F.col("y").alias("b"))


def _grouped(docs: DataFrame, shingle_words: int, percent: int, chunks: int) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`_signed`, and each distinct set (``f1, f2, n_shingles``) with the
    least ``doc_id, text_key`` of its rows and its component's number ``comp``."""
    parts = max(partitions(docs.sparkSession), 1)
    signed = stash(_signed(docs, shingle_words, chunks), "signed")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    classes = signed.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min(first).alias("x"), F.first("sig").alias("sig"))
    nodes = stash(classes.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "n_shingles", "sig", "x.doc_id", "x.text_key"), "nodes")
    ratio = f"100L * least(n_a, n_b) >= {int(percent)}L * greatest(n_a, n_b)"

    # keys that nodes share. In a random order of each key's nodes the places of a node
    # add up to half the sizes of its keys: that ranks the nodes, and the first leads
    keyed = _keyed(nodes, chunks).withColumn("pop", F.lit(0).cast("long"))
    shared = stash(_shared(keyed, parts, [F.xxhash64("node", "key"), "node"]).select("key", "node", "n", "place"), "shared")
    pop = shared.groupBy("node").agg(F.sum(F.col("place") + 1).alias("pop"))
    shared = stash(_shared(shared.join(pop, "node"), parts, [F.desc("pop"), "node"]), "led")

    # heads, and the links to them
    heads = shared.where("node != rep").groupBy("node").agg(F.max_by("rep", F.struct("rep_pop", -F.col("rep"))).alias("a")).select("a", F.col("node").alias("b"), F.lit(0).alias("w"))
    heads = _close(heads, nodes, WIDTH * chunks * 4 // 5)
    family = stash(_compared(stash(heads, "heads"), nodes, docs, shingle_words, percent), "compared")
    roots = forest_roots(family.where("linked").selectExpr("b AS node", "a AS parent"), "roots")
    inside = stash(_within_families(family, percent), "inside")

    # pairs of different heads and components that share a key
    fam = family.select(F.col("b").alias("node"), F.col("a").alias("head"))
    labelled = shared.select("key", "node", "n").join(roots, "node", "left").join(fam, "node", "left")
    labelled = stash(labelled.select("key", "node", "n", F.coalesce("root", "node").alias("comp"), F.coalesce("head", "node").alias("head")), "labelled")
    per = labelled.groupBy("key", "head").count().groupBy("key").agg(F.max_by("head", F.struct("count", -F.col("head"))).alias("main"), F.count("*").alias("heads")).where("heads > 1")
    mixed = stash(labelled.join(per.select("key", "main"), "key"), "mixed")
    out = mixed.where("head != main").selectExpr("key", "node AS a", "n AS n_a", "comp AS comp_a", "head AS head_a")
    cross = out.join(mixed.selectExpr("key", "node AS b", "n AS n_b", "comp AS comp_b", "head AS head_b"), "key").where(f"comp_a != comp_b AND head_a != head_b AND {ratio}")
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0).alias("w")).distinct()
    close = stash(_close(cross, nodes, 2 * chunks - 1), "close")
    over = stash(_compared(close, nodes, docs, shingle_words, percent).where("linked").select("a", "b").unionByName(inside), "links")
    for side in ("a", "b"):
        up = roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        over = stash(skew_join(over, up, [side], "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side)), "over")
    final = components(over.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), "final").toDF("comp", "top")

    comp = stash(nodes.drop("sig").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")), "rooted")
    comp = skew_join(comp, final, ["comp"], "left").select("f1", "f2", "n_shingles", "doc_id", "text_key", F.coalesce("top", "comp").alias("comp"))
    return signed, stash(comp, "comp")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, chunks: int = 32) -> DataFrame:
    """Components of near duplicates: ``doc_id, text_key, n_shingles, component_id,
    kept`` for each row of ``docs`` (``doc_id``, ``text``).

    ``component_id`` is the smallest ``doc_id`` reachable over links; ``kept``
    says that the row has it. ``text_key`` (xxhash64 of the text) tells rows of
    one ``doc_id`` apart.
    """
    signed, comp = _grouped(docs, shingle_words, percent, chunks)
    ids = comp.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    key = ["f1", "f2", "n_shingles"]
    by_set = stash(skew_join(comp, ids, ["comp"]).select(*key, "component_id"), "by_set")
    rows = signed.drop("sig")
    joined = skew_join(rows.where("n_shingles > 0"), by_set, key).select("doc_id", "text_key", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def least_of_groups(docs: DataFrame, shingle_words: int = 5, percent: int = 80, chunks: int = 32) -> tuple[DataFrame, bool]:
    """``(doc_id, text_key)`` of the least row of each component, nulls last, and whether
    rows of ``docs`` with words are equal in both. Components are told apart by their
    own number, so rows that only share a ``doc_id``, or have none, stay apart; rows
    without words are in no component."""
    signed, comp = _grouped(docs, shingle_words, percent, chunks)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("x")
    repeated = not signed.where("n_shingles > 0").groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()
    return stash(comp.groupBy("comp").agg(least).select("x.doc_id", "x.text_key"), "least"), repeated
