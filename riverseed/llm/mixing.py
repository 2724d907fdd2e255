"""Mixing sources to target weights by packed blocks.

The words of a source, its documents in ascending ``doc_id``, are packed into
blocks of ``block_words``. The mixture is a sequence of output shards of
``shard_slots`` block slots; each shard draws how many slots each source gets
from a multinomial over what the sources still miss. The slots of a source are
numbered through all shards; slot ``j`` holds block ``perm(j mod n)``, where
``perm`` is a pseudorandom permutation of the source's ``n`` block numbers that
changes with each pass ``j div n`` (a keyed Feistel network, walked until it
falls below ``n``). Blocks are joined by their number: nothing is shuffled by
content, and a rerun gives the same mixture.

Targets: sources by code point, null last, weigh 1, 2, 3 in turn and share all
words; a target stops at ``most`` times its source's words, the excess going to
the others by weight until none is above. No source gets more than ``most``
passes over its blocks.

Edge cases: a document without words is in no block and has 0 taken; a null
source is a source; null ids come first in their source; rows of one id go by a
hash of their text; an empty table gives an empty mixture.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, partitions, slices, stash, utf8, words

WEIGHTS = (1, 2, 3)
#: Sources of a mixture, and shares of sources in shards, that the driver holds.
MAX_SOURCES, MAX_CELLS = 100_000, 2_000_000
#: Partial sums that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Whether a byte is ASCII white space.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: The mixture's order: slots are numbered by source, so a source's slots, and in them
#: the documents of the block, follow each other inside a shard.
ORDER = ["shard", "slot", "source", "place"]


def targets(sizes: dict[str | None, int], most: float = 3.0, weights: tuple[float, ...] = WEIGHTS) -> dict[str | None, float]:
    """Target words of each source."""
    names = sorted(sizes, key=lambda s: (s is None, "" if s is None else s))  # str order is code-point order
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out = float(sum(sizes.values())), {}
    free = list(names)
    while free:
        share = (total - sum(out.values())) / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * share > most * sizes[s]]
        if not above:
            return {s: out.get(s, weight[s] * share) for s in names}
        out |= {s: most * sizes[s] for s in above}
        free = [s for s in free if s not in above]
    return {s: out[s] for s in names}


def draw_shards(want: np.ndarray, limit: np.ndarray, shard_slots: int, seed: int) -> np.ndarray:
    """Slots of each source (column) in each shard (row): multinomial draws by what is
    still missing of ``want``, and no more than that (a shard is then shorter), at most
    ``limit`` in all. The last shards halve, so that few slots are left to the last draw."""
    total = int(round(want.sum()))
    rng, left, used, rows = np.random.default_rng(seed), want.astype(float).copy(), np.zeros(len(want), np.int64), []
    while total > 0:
        room = np.where(used < limit, np.maximum(left, 0), 0)
        if room.sum() <= 0:
            break
        size = min(shard_slots, total, max(total // 2, 4))
        n = np.minimum(rng.multinomial(size, room / room.sum()), np.minimum(limit - used, np.ceil(room).astype(np.int64)))
        used, left = used + n, left - n
        total -= int(n.sum())
        rows.append(n)
    return np.array(rows, np.int64).reshape(len(rows), len(want))


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of ``0..n-1`` for each ``(n, key)``, at ``j``."""
    bits = np.maximum(np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1 >> 1, 1).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = j.astype(np.uint64).copy(), np.arange(len(j))
    while len(todo):
        x, b, m = out[todo], bits[todo], mask[todo]
        low, high = x & m, x >> b
        for r in range(4):
            turn = np.uint64((r + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
            f = (low + key[todo].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + turn) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            low, high = high ^ ((f >> np.uint64(33)) & m), low
        out[todo] = (high << b) | low
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def placed(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Each row's ``size`` in words and ``start``: the words of its source before it.

    One shuffle by ranges of ``(source, doc_id)``; running sums inside a range, then
    the sums of the ranges before (a row for each range and source).
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words(F.col("text").cast("string"))).cast("long").alias("size"), F.xxhash64("text").alias("text_key"), *(keep or []))
    src = stash(src, "sizes")
    n = partitions(docs.sparkSession)
    by = [F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_first(), F.col("text_key")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = {}, TaskContext.get().partitionId()
        for b in batches:
            size = b.column("size").to_numpy()
            names = b.column("source").to_pylist()
            start = np.empty(len(size), np.int64)
            edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi > lo:
                    sums = np.cumsum(size[lo:hi])
                    start[lo:hi] = at.get(names[lo], 0) + sums - size[lo:hi]
                    at = {names[lo]: at.get(names[lo], 0) + int(sums[-1])}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start), pa.array(np.full(len(size), part, np.int64))], names=[*b.schema.names, "start_in", "part"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    local = stash(src.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(run, f"{kind}, start_in long, part long"), "local")
    sums = local.groupBy("source", "part").agg(F.sum("size").alias("s"))
    # at most a row for each range of a source, in all ranges + sources
    sums = sums.withColumn("before", F.sum("s").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = stash(sums.select(F.col("source").alias("s2"), F.col("part").alias("p2"), "before"), "before")
    out = local.join(bounded(before, BROADCAST_ROWS, BROADCAST_BYTES), F.expr("source <=> s2 AND part = p2"), "left")
    return out.select("doc_id", "source", "size", "text_key", *(keep or []), (F.col("start_in") + F.coalesce("before", F.lit(0))).alias("start"))


def mixture(rows: DataFrame, block_words: int = 32, shard_slots: int = 4096, seed: int = 1, most: float = 3.0, weights: tuple[float, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """The slots of the mixture, ``(source, block, shard, slot, pass_no)``, and the
    sources, ``(source, source_size, target)``, of ``rows`` (of :func:`placed`).

    ``shard_slots`` is raised so that there are at most some 20,000 shards to draw, and
    ``MAX_CELLS`` shares of sources in shards. Sources are labels of the collection: a
    table with more than ``MAX_SOURCES`` of them is an error.
    """
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums = {r.source: r.n or 0 for r in found}
    want = targets(sums, most, weights)
    names = list(want)
    kinds = spark.createDataFrame([(s, int(sums[s]), float(want[s])) for s in names], "source string, source_size long, target double")
    blocks = np.array([-(-sums[s] // block_words) for s in names], np.int64)
    # a source's last block may be short: its slots are counted by its mean block
    mean = np.array([sums[s] / b if b else 1 for s, b in zip(names, blocks, strict=True)])
    slots = np.array([want[s] for s in names]) / mean
    shard_slots = max(shard_slots, int(slots.sum()) // min(20_000, max(MAX_CELLS // max(len(names), 1), 1)))
    drawn = draw_shards(slots, (np.ceil(most) * blocks).astype(np.int64), shard_slots, seed)
    first = np.cumsum(drawn, axis=0) - drawn
    plan = [(int(k), int(s), int(first[k, s]), int(drawn[k, s]), int(blocks[s])) for k, s in zip(*np.nonzero(drawn), strict=True)]
    schema = "shard long, source_no int, first long, n long, blocks long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                j = r["first"] + np.arange(r["n"])
                n = np.full(len(j), r["blocks"])
                key = (j // r["blocks"] + 1) * 1009 + r["source_no"] + seed * 7919
                block = permuted(j % r["blocks"], n, key)
                yield pa.record_batch([pa.array(np.full(len(j), r["source_no"], np.int32)), pa.array(block), pa.array(np.full(len(j), r["shard"])), pa.array(j), pa.array(j // r["blocks"])], names=["source_no", "block", "shard", "slot", "pass_no"])

    wide = spark.createDataFrame(plan, schema).repartition(partitions(spark))
    slots_df = wide.mapInArrow(run, "source_no int, block long, shard long, slot long, pass_no long")
    numbered = spark.createDataFrame(list(enumerate(names)), "source_no int, source string")
    return slots_df.join(F.broadcast(numbered), "source_no").drop("source_no"), kinds  # MAX_SOURCES rows at most


def overlaps(rows: DataFrame, block_words: int) -> DataFrame:
    """A row for each block that a document has words in: ``block``, and the
    document's words ``[w0, w1)`` that lie there."""
    b = F.lit(block_words)
    some = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
    w0 = F.greatest(F.col("block") * b - F.col("start"), F.lit(0).cast("long"))
    w1 = F.least((F.col("block") + 1) * b - F.col("start"), F.col("size"))
    return some.withColumns({"w0": w0, "w1": w1})


def mix_taken(docs: DataFrame, block_words: int = 32, **options) -> DataFrame:
    """What the mixture holds of each row of ``docs`` (``doc_id``, ``text``, ``source``):
    ``doc_id, size, source, source_size, target, taken``, the words counted in the
    mixture as it was written."""
    docs = docs.select("doc_id", "text", "source")
    rows = stash(placed(docs), "placed")
    slots, kinds = mixture(rows, block_words, **options)
    mixed = stash(_pieces(docs, rows, slots, block_words), "mixture")
    null_safe = lambda df: df.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    taken = null_safe(mixed).groupBy("source_key", F.col("row_start").alias("at")).agg(F.sum(F.size(words(F.col("text")))).alias("taken"))
    # a document with words is the only one of its source at its start; those without are not in `taken`
    left = null_safe(rows).withColumn("at", F.when(F.col("size") > 0, F.col("start"))).drop("start")
    out = left.join(taken, ["source_key", "at"], "left").select("doc_id", "size", "source", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    kinds = kinds.withColumnRenamed("source", "s2")
    return out.join(F.broadcast(kinds), F.col("source").eqNullSafe(F.col("s2"))).select("doc_id", "size", "source", "source_size", "target", "taken")  # MAX_SOURCES rows at most


def mix_documents(docs: DataFrame, block_words: int = 512, **options) -> DataFrame:
    """The mixture as documents: for each slot and each document in its block a row
    with the document's columns, ``text`` being its words there (white space
    between them as it was) and ``n_chars`` their length, with ``shard`` and ``slot``,
    ``place``, the words before it in its block, and ``row_start``, those of its source
    before its document. The mixture is in the order of :data:`ORDER`. Documents
    without words aren't in it."""
    rows = stash(placed(docs), "placed")
    slots, _ = mixture(rows, block_words, **options)
    return _pieces(docs, rows, slots, block_words)


def _pieces(docs: DataFrame, rows: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """The rows of :func:`mix_documents`, of ``rows`` of :func:`placed` and slots.

    Rows equal in id, text and source have takes each; the other columns are those
    of one of them."""
    names = docs.columns
    key = ["_dk", "_no", "_tk", "_sk"]
    source_key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("_sk")
    parts = overlaps(rows, block_words).select("doc_id", "text_key", "source", "start", "block", "w0", "w1")
    same = F.expr("p.source <=> s.source AND p.block = s.block")
    place = F.greatest(F.col("p.start") - F.col("p.block") * F.lit(block_words), F.lit(0).cast("long")).alias("place")
    takes = parts.alias("p").join(slots.alias("s"), same).groupBy("p.doc_id", "p.text_key", "p.source", "p.start").agg(F.collect_list(F.struct("s.shard", "s.slot", "p.w0", "p.w1", place)).alias("takes"))
    takes = takes.select(F.coalesce("doc_id", F.lit(-1)).alias("_dk"), F.col("doc_id").isNull().alias("_no"), F.col("text_key").alias("_tk"), source_key, F.col("start").alias("row_start"), "takes")
    left = docs.select(*names, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_dk"), F.col("doc_id").isNull().alias("_no"), F.xxhash64("text").alias("_tk"), source_key)
    if not rows.where("size > 0").groupBy("doc_id", "text_key", "source").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(key)
    picked = left.join(takes, key).drop(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_chars = names.index("n_chars") if "n_chars" in names else None
        for whole in batches:
            for b in slices(whole, "text"):
                parts = utf8(b.column("text"))
                data = b"".join(parts)
                edge = np.cumsum([0, *map(len, parts)])
                black = np.r_[~SPACES[np.frombuffer(data, np.uint8)], False]
                # a word begins after white space or where its text begins
                begins, ends = black.copy(), np.zeros(len(black) + 1, bool)
                begins[1:] &= ~black[:-1]
                begins[edge[:-1]] = black[edge[:-1]]
                ends[1:] = black
                ends[:-1] &= ~black
                ends[edge[1:]] |= np.r_[False, black][edge[1:]]
                begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
                takes = b.column("takes")
                take = takes.flatten()
                field = lambda c, take=take: take.field(c).to_numpy(zero_copy_only=False)
                index = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(takes), 0).to_numpy(zero_copy_only=False))
                first = np.searchsorted(begins, edge[:-1])[index]
                lo, hi = begins[first + field("w0")], ends[first + field("w1") - 1]
                texts = pa.array([data[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()).cast(pa.string())
                index = pa.array(index, pa.int64())
                cols = [texts if c == "text" else b.column(c).take(index) for c in names]
                if at_chars is not None:
                    cols[at_chars] = pc.utf8_length(texts).cast(b.schema.field("n_chars").type)
                cols += [*(take.field(c) for c in ("shard", "slot", "place")), b.column("row_start").take(index)]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "shard", "slot", "place", "row_start"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return picked.mapInArrow(run, f"{kind}, shard long, slot long, place long, row_start long")
