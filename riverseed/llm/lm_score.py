"""Log-bilinear language model, trained in numpy with noise-contrastive estimation.

Counts of all training tokens come from one pass and one pre-aggregated shuffle.
Outputs of the model are the ``vocab`` most frequent words, the end token, and a
class for each group of all other words (by the hash of a word's last two bytes,
its ending): a word of a class has the class's probability times its smoothed
share of the class's counts, so the whole is normalised over all words and one
unseen of each class. The prediction from the two words before, or their classes,
is ``q_w . (C1 r_1 + C2 r_2) + b_w``.

Training texts are turned into output numbers once (two bytes a token) and dealt
by a hash of id and text into copies and rounds; how many copies there are follows
from the number of tokens alone. In a round every copy trains on its share in the
order of the hashes (noise words shared by a mini-batch, so that the work is dense
matrix products; AdaGrad); then parameters and AdaGrad sums are averaged by tokens
in a tree of tasks, and the next round goes on from there. So the model depends on
the rows, not on the files or partitions that they came in (but for rounding, and
for which copy gets which of equal rows where one row repeats very often).

The normaliser of each of the ``(outputs + 1)**2`` contexts is computed once by
batched products. Scoring then is a look-up and a dot product for each token.

Words are known by a 64-bit hash. Counts of the ``top`` most frequent words go to
all tasks (16 bytes each); those of rarer words are joined by a shuffle.

Edge cases: null or empty text is the end token alone; a null ``doc_id`` is
trained on; with nothing to train on all counts are 0 and the model is uniform
over the end and the classes; repeated rows are scored each; other columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stash, utf8

CLASSES = 128
END = CLASSES  # outputs: classes, the end, words; the begin of a text is the last context
DIM, BATCH, NOISE, RATE = 16, 4096, 64, 0.15
#: Rounds of averaging; tokens that a copy trains on in all: ``SHARE`` or ``GROWTH`` roots of the corpus.
ROUNDS, SHARE, GROWTH = 4, 1_000_000, 250
FLUSH = 400_000


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, how many each text has, and the words."""
    split = [t.lower().split() for t in texts]  # bytes: A-Z and ASCII white space only
    n = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.empty(int(n.sum()), dtype=object)
    flat[:] = [w for ws in split for w in ws]
    return (pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)), n, flat


def class_of(words: np.ndarray) -> np.ndarray:
    """The classes of words, by their endings."""
    return np.fromiter((zlib.crc32(w[-2:]) % CLASSES for w in words), np.int64, len(words))


def _counted(rows: DataFrame) -> DataFrame:
    """``(h, c, n)``: counts of words of ``rows`` and their classes; ``h`` null counts the texts."""

    names = ["h", "c", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        texts = size = 0

        def merged():
            h, first, inverse = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
            return h, np.concatenate([x[1] for x in held])[first], np.bincount(inverse, np.concatenate([x[2] for x in held]), len(h)).astype(np.int64)

        def out(h, c, n) -> pa.RecordBatch:
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n)], names=names)

        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                h, n, flat = hashed_words(utf8(b.column("text")))
                texts += len(n)
                own, first, count = np.unique(h, return_index=True, return_counts=True)
                held.append((own, class_of(flat[first]), count))
                size += len(own)
                if size > 4 * FLUSH:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > FLUSH:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*merged())
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([0], pa.int32()), pa.array([texts], pa.int64())], names=names)

    return rows.select("text").mapInArrow(run, "h long, c int, n long").groupBy("h").agg(F.min("c").alias("c"), F.sum("n").alias("n"))


@dataclass
class Model:
    """Parameters; ``ids`` maps the sorted hashes of the words to outputs."""

    words: np.ndarray  # sorted hashes of the words that are outputs
    ids: np.ndarray
    r: np.ndarray  # contexts x DIM: outputs, then the begin
    q: np.ndarray
    b: np.ndarray
    c: np.ndarray  # 2 x DIM x DIM
    noise: np.ndarray  # of outputs

    def outputs(self, h: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Output numbers of words by hash; those that have none by their class."""
        out = np.full(len(h), -1, np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            out = np.where(self.words[at] == h, self.ids[at], -1)
        rest = np.flatnonzero(out < 0)
        out[rest] = class_of(flat[rest])
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.b, self.c)]).astype(np.float32)

    def with_flat(self, x: np.ndarray) -> Model:
        parts, at = [], 0
        for y in (self.r, self.q, self.b, self.c):
            parts.append(x[at : at + y.size].reshape(y.shape).astype(np.float32))
            at += y.size
        return Model(self.words, self.ids, *parts, self.noise)


def start_model(words: np.ndarray, counts: np.ndarray, in_class: np.ndarray, n_end: int) -> Model:
    """A model whose biases are the unigram's; ``words`` in descending count, ``in_class``
    the tokens of each class."""
    rng = np.random.default_rng(11)
    size = len(words) + CLASSES + 1
    p = np.r_[in_class, n_end, counts].astype(float) + 1
    p /= p.sum()
    order = np.argsort(words)
    noise = p**0.75
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    c = np.stack([np.eye(DIM), 0.5 * np.eye(DIM)]).astype(np.float32)
    return Model(words[order], order + END + 1, small(size + 1, DIM), small(size, DIM), np.log(p).astype(np.float32), c, noise / noise.sum())


def encoded(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Output numbers of texts, each with its end, and how many each has."""
    h, n, flat = hashed_words(texts)
    return np.insert(model.outputs(h, flat), np.cumsum(n), END), n + 1


def contexts(w: np.ndarray, n: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The one and the two before each output of texts of ``n`` outputs."""
    first = np.cumsum(n) - n
    one = np.r_[begin, w[:-1]] if len(w) else w
    one[first] = begin
    two = np.r_[begin, one[:-1]] if len(w) else w
    two[first] = begin
    return one, two


def _add(grad: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``grad`` summed by ``at``."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return own[starts], np.add.reduceat(grad[order], starts, axis=0)


class Trainer:
    """AdaGrad on the noise-contrastive loss, mini-batch by mini-batch."""

    def __init__(self, model: Model, seed: list[int], seen: np.ndarray | None = None):
        self.m = model.with_flat(model.flat())
        self.rng = np.random.default_rng(seed)
        kept = model.with_flat(np.full(len(model.flat()), 1e-2) if seen is None else seen)
        self.seen = [kept.r, kept.q, kept.b, kept.c]
        self.cdf, self.log_noise = np.cumsum(model.noise), np.log(model.noise * NOISE).astype(np.float32)
        self.tokens = 0

    def _step(self, k: int, x: np.ndarray, at, grad: np.ndarray) -> None:
        self.seen[k][at] += grad * grad
        x[at] -= RATE * grad / np.sqrt(self.seen[k][at])

    def batch(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m, n = self.m, len(w)
        self.tokens += n
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random(NOISE)), len(self.cdf) - 1)
        r1, r2 = m.r[one], m.r[two]
        guess = r1 @ m.c[0] + r2 @ m.c[1]
        up = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        qw, qn = m.q[w], m.q[noise]
        gp = up(np.einsum("ij,ij->i", guess, qw) + m.b[w] - self.log_noise[w]) - 1
        gn = up(guess @ qn.T + (m.b[noise] - self.log_noise[noise])[None, :])
        dg = gp[:, None] * qw + gn @ qn
        rows, dq = _add(np.concatenate([gp[:, None] * guess, gn.T @ guess]), np.r_[w, noise])
        db = np.bincount(np.r_[w, noise], np.r_[gp, gn.sum(0)], len(m.b)).astype(np.float32)[rows]
        ctx, dr = _add(np.concatenate([dg @ m.c[0].T, dg @ m.c[1].T]), np.r_[one, two])
        dc = np.stack([r1.T @ dg, r2.T @ dg])
        scale = np.float32(1 / math.sqrt(n))
        self._step(1, m.q, rows, dq * scale)
        self._step(2, m.b, rows, db * scale)
        self._step(0, m.r, ctx, dr * scale)
        self._step(3, m.c, slice(None), dc * scale)

    def texts(self, w: np.ndarray, n: np.ndarray) -> None:
        one, two = contexts(w, n, len(self.m.q))
        order = self.rng.permutation(len(w))
        for lo in range(0, len(w), BATCH):
            at = order[lo : lo + BATCH]
            self.batch(w[at], one[at], two[at])

    def state(self) -> np.ndarray:
        """Parameters, then AdaGrad sums."""
        return np.concatenate([self.m.flat(), *[x.ravel() for x in self.seen]])


def copies_for(tokens: int) -> int:
    """Copies that train a corpus of so many tokens: more with it, by its root in the end."""
    return max(1, math.ceil(tokens / max(SHARE, GROWTH * math.sqrt(max(tokens, 1)))))


def _dealt(rows: DataFrame, model: Model, n_copies: int) -> DataFrame:
    """Training texts as outputs, ``(share, h, w)``: ``share`` numbers copy and round."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                w, n = encoded(shared.value, utf8(b.column("text")))
                w = w.astype("<u2").tobytes()
                ends = np.cumsum(2 * n)
                yield pa.record_batch([b.column("h"), pa.array([w[i:j] for i, j in zip((ends - 2 * n).tolist(), ends.tolist(), strict=True)], pa.binary())], names=["h", "w"])

    keyed = rows.select("text", F.xxhash64("doc_id", "text").alias("h"))
    made = stash(keyed.mapInArrow(run, "h long, w binary"), "encoded")
    # of rows that repeat more than a tenth of a share the hash is salted
    often = stash(made.groupBy("h").count().where(F.col("count") > made.count() // (10 * n_copies * ROUNDS) + 1).select("h"), "often")
    salted = made.join(F.broadcast(often.withColumn("many", F.lit(True))), "h", "left")  # 10 rows a share at most
    turn = F.when(F.col("many"), F.pmod(F.monotonically_increasing_id(), F.lit(100_003))).otherwise(0)
    return salted.select(F.pmod(F.xxhash64("h", turn), F.lit(n_copies * ROUNDS)).cast("int").alias("share"), "h", "w")


def _trained(rows: DataFrame, model: Model, n_tokens: int) -> Model:
    """The rounds: every copy goes on from the average of the last round."""
    spark, n_copies = rows.sparkSession, copies_for(n_tokens)
    schema = "copy long, tokens long, flat binary"
    dealt = stash(_dealt(rows, model, n_copies), "dealt")
    seen = None
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, seen))

        def train(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            t = copy = None
            for whole in batches:
                for b in slices(whole, "w", 1 << 20):
                    if t is None:
                        copy = b.column("share")[0].as_py() // ROUNDS
                        t = Trainer(shared.value[0], [turn, copy], shared.value[1])
                    parts = b.column("w").to_pylist()
                    t.texts(np.frombuffer(b"".join(parts), "<u2").astype(np.int64), np.fromiter((len(x) // 2 for x in parts), np.int64, len(parts)))
            if t is not None:
                yield pa.record_batch([pa.array([copy], pa.int64()), pa.array([t.tokens], pa.int64()), pa.array([t.state().tobytes()], pa.binary())], names=["copy", "tokens", "flat"])

        own = dealt.where(F.col("share") % ROUNDS == turn).select("share", "h", "w", F.expr(f"cast(share div {ROUNDS} as int)").alias("_c"))
        own = own.repartitionById(n_copies, "_c").sortWithinPartitions("h", "w").select("share", "w")
        copies = stash(own.mapInArrow(train, schema), "copies")
        while (n := copies.count()) > 32:
            group = F.expr("cast(copy div 32 as int)")
            size = copies.agg(F.max(group)).first()[0] + 1
            copies = stash(copies.withColumn("_g", group).repartitionById(size, "_g").sortWithinPartitions("copy").select("_g", "tokens", "flat").mapInArrow(_mean, schema), "copies")
        left = copies.orderBy("copy").collect()  # at most 32 copies of bounded size
        total = sum(x.tokens for x in left)
        if not left:
            continue
        flat = sum(np.frombuffer(x.flat, np.float32).astype(float) * (x.tokens / total) for x in left)
        model, seen = model.with_flat(flat[: len(flat) // 2]), flat[len(flat) // 2 :]
    return model


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The average of a task's copies, by tokens."""
    total, acc, number = 0, 0.0, None
    for b in batches:
        for g, n, x in zip(*(b.column(c).to_pylist() for c in ("_g", "tokens", "flat")), strict=True):
            acc, total, number = acc + n * np.frombuffer(x, np.float32).astype(float), total + n, g
    if total:
        yield pa.record_batch([pa.array([number], pa.int64()), pa.array([total], pa.int64()), pa.array([(acc / total).astype(np.float32).tobytes()], pa.binary())], names=["copy", "tokens", "flat"])


def _normalisers(spark, model: Model) -> np.ndarray:
    """log Z of each context ``[two, one]``."""
    r1, r2, q, b = model.r @ model.c[0], model.r @ model.c[1], model.q, model.b
    size = len(model.r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for two in batch.column("id").to_pylist():
                s = (r1 + r2[two]) @ q.T + b
                top = s.max(1, keepdims=True)
                z = (np.log(np.exp(s - top).sum(1)) + top[:, 0]).astype(np.float32)
                yield pa.record_batch([pa.array([two], pa.int64()), pa.array([z.tobytes()], pa.binary())], names=["two", "z"])

    rows = spark.range(0, size, 1, min(size, 24)).mapInArrow(run, "two long, z binary").collect()
    out = np.empty((size, size), np.float32)
    for x in rows:
        out[x.two] = np.frombuffer(x.z, np.float32)
    return out


def lm_scores(docs: DataFrame, train: str, vocab: int = 1000, top: int = 65_536) -> DataFrame:
    """For each row of ``docs`` (``doc_id``, ``text``): ``doc_id, train, n_tokens,
    n_known, train_tokens, base_score, score``; ``train`` is SQL on ``doc_id`` that
    says which rows are learned from."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("train", F.coalesce(F.expr(train), F.lit(True)))
    learned = rows.where("train")
    counts = stash(_counted(learned), "counts")
    by_class = {r.c: (r.n, r.k) for r in counts.where("h IS NOT NULL").groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}  # a row a class
    n_words, n_types, n_end = counts.agg(F.coalesce(F.sum(F.when(F.col("h").isNotNull(), F.col("n"))), F.lit(0)), F.count("h"), F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("n"))), F.lit(0))).first()
    total, types = n_words + n_end, n_types + bool(n_end)
    head = counts.where("h IS NOT NULL").orderBy(F.desc("n"), "h").limit(top).collect()  # bounded by `top`
    hashes = np.array([x.h for x in head], np.int64).view(np.uint64)
    ns = np.array([x.n for x in head], np.int64)
    in_class, types_in = (np.array([by_class.get(c, (0, 0))[i] for c in range(CLASSES)], np.int64) for i in (0, 1))
    for x in head[:vocab]:
        in_class[x.c] -= x.n
        types_in[x.c] -= 1
    model = _trained(learned, start_model(hashes[:vocab], ns[:vocab], in_class, n_end), total)
    z = _normalisers(spark, model)
    order = np.argsort(hashes)
    class_mass = np.log10(in_class + types_in + 1.0)  # (c + 1) of all words of the class, and one unseen
    shared = spark.sparkContext.broadcast((model, z, model.r @ model.c[0], model.r @ model.c[1], hashes[order], np.log10(ns[order] + 1.0)))
    log_end, complete = math.log10(n_end + 1), len(head) == n_types

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, z, r1, r2, sorted_h, log_c = shared.value
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                h, n, flat = hashed_words(utf8(b.column("text")))
                word_out = m.outputs(h, flat)
                w = np.insert(word_out, np.cumsum(n), END)
                one, two = contexts(w, n + 1, len(m.q))
                s = np.einsum("ij,ij->i", r1[one] + r2[two], m.q[w]) + m.b[w] - z[two, one]
                of_token, of_word = np.repeat(np.arange(len(n)), n + 1), np.repeat(np.arange(len(n)), n)
                lbl = np.bincount(of_token, s.astype(float) / math.log(10), len(n))
                at = np.minimum(np.searchsorted(sorted_h, h), max(len(sorted_h) - 1, 0))
                hit = (sorted_h[at] == h) if len(sorted_h) else np.zeros(len(h), bool)
                logs = np.where(hit, log_c[at], 0.0) if len(sorted_h) else np.zeros(len(h))
                in_class = word_out < CLASSES
                base = np.bincount(of_word, logs, len(n)) + log_end
                share = np.where(hit, logs, 0.0) - class_mass[np.where(in_class, word_out, 0)]
                extra = np.bincount(of_word, np.where(in_class, share, 0.0), len(n))
                rest = ~hit & in_class
                if complete:
                    rest &= False  # all counts are in the head: what isn't has none
                tail, k = h[rest], np.bincount(of_word[rest], minlength=len(n))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(k)].astype(np.int32)), pa.array(tail.view(np.int64)))
                yield pa.record_batch(
                    [b.column("doc_id"), b.column("train"), b.column("row"), pa.array(n + 1), pa.array(np.bincount(of_word, hit, len(n)).astype(np.int64) + bool(n_end)), pa.array(base), pa.array(lbl + extra), lists],
                    names=["doc_id", "train", "row", "n_tokens", "known", "base", "lbl", "tail"],
                )

    schema = "doc_id long, train boolean, row long, n_tokens long, known long, base double, lbl double, tail array<long>"
    scored = stash(rows.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "train", "row", "text").mapInArrow(score, schema), "scored")
    rare = counts.where("h IS NOT NULL")
    tails = scored.select("row", F.explode("tail").alias("h"))
    sums = tails.join(rare, "h").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("logs"))
    out = scored.drop("tail").join(sums, "row", "left")
    more = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "train", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * math.log10(total + types + 1)).alias("base_score"), (F.col("lbl") + more).alias("score"),
    )
