"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A text's indicators say which n-grams it holds: runs of one to four bytes, and of one to
three word shapes (first and last character's class, length, capitals, same as the word
before) and one to four coarse shapes (capitals, symbol or not at the end, same as the
word before), each hashed to one of ``2**BITS`` buckets, whatever the text's length.

Fitting, on the labelled rows that the caller's condition admits:

1. how many texts of each class hold each bucket, over all those rows; a task sums in two
   arrays and tasks are summed in a tree of ``FAN``; the log-count ratio of the classes
   (smoothed by one) scales a bucket's indicator;
2. a linear model with squared hinge loss on the scaled indicators of a text, at unit
   length, by dual coordinate descent, in one task on a bounded sample: at most
   ``max_rows`` labelled rows, half of each class, those of the smallest hashes of the id;
3. the margin's probability, by logistic regression on a fourth of that sample that
   descent has not seen, with the classes weighted as in all labelled rows.

Scoring is a sum of one weight for each bucket of a text, over the root of another.

Edge cases: null and empty texts have no indicators and get the score of the intercept;
labels are matched by the integer id, a null id has none; an id with both labels, or with
none of 0 and 1, counts as unlabelled, repeated equal labels count once; repeated rows of
an id are each counted, and one of each text is fitted; without labelled rows every score
is 0.5, with rows of one class alone ``(ones + 1) / (rows + 2)``; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, skew_join, slices, stash, utf8

BITS = 18
#: Texts made to indicators at once (their bytes, and their number); tasks summed by one.
PIECE_BYTES, PIECE_TEXTS, FAN = 1 << 19, 64, 32
#: Rows of labels that are broadcast; beyond that the join shuffles.
MAX_LABELS = 4_000_000
COST, ROUNDS = 1.0, 20

# Classes of bytes. 0 other letters (beyond ASCII), 1 a-z, 2 A-Z, 3 digits, 4 .,;:'"()-, 5 other signs.
_CLASS = np.zeros(256, np.uint64)
_CLASS[33:128] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[list(b".,;:'\"()-")] = 4
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bucket(code: np.ndarray, stream: int) -> np.ndarray:
    """Buckets of n-gram codes; each stream has its own hash."""
    mixed = (code + np.uint64(stream + 1)) * _ODD
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def indicators(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many buckets each text holds, and these buckets, ascending for each text."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    of = np.repeat(np.arange(len(texts), dtype=np.int64) << BITS, sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(buf)) - 1  # bytes of the text from here on
    mark = np.zeros(len(texts) << BITS, bool)
    code = np.zeros(len(buf), np.uint64)
    for n in range(1, 5):
        m = len(buf) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint64(8)) | buf[n - 1 :]
        mark[(of[:m] + _bucket(code, n))[left[:m] >= n]] = True
    dark = ~_SPACE[buf]
    at = np.flatnonzero(dark)
    if len(at):
        opens = np.flatnonzero(dark & ~np.r_[False, dark[:-1]])
        length = np.flatnonzero(dark & ~np.r_[dark[1:], False]) - opens + 1
        first = np.cumsum(length) - length
        place = at - np.repeat(opens, length)
        power = np.cumprod(np.full(int(length.max()), 0x100000001B3, np.uint64))
        word = np.add.reduceat((buf[at] + np.uint64(1)) * power[place], first)
        kind = _CLASS[buf[at]]
        upper = np.add.reduceat(kind == 2, first, dtype=np.int64) > 1
        upper &= np.add.reduceat(kind == 1, first, dtype=np.int64) == 0
        doc = of[opens]
        same = np.r_[False, (word[1:] == word[:-1]) & (length[1:] == length[:-1]) & (doc[1:] == doc[:-1])]
        end = kind[first + length - 1]
        flags = same.astype(np.uint64) | (upper.astype(np.uint64) << np.uint64(1))
        size = np.minimum(length // 4, 3).astype(np.uint64)
        shape = flags | (kind[first] << np.uint64(2)) | (end << np.uint64(5)) | (size << np.uint64(8))
        coarse = flags | ((end == 5).astype(np.uint64) << np.uint64(2))
        for stream, values, bits, most in ((10, shape, 10, 3), (20, coarse, 3, 4)):
            code = np.zeros(len(values), np.uint64)
            for n in range(1, most + 1):
                m = len(values) - n + 1
                if m <= 0:
                    break
                code = (code[:m] << np.uint64(bits)) | values[n - 1 :]
                mark[(doc[:m] + _bucket(code, stream + n))[doc[:m] == doc[n - 1 :]]] = True
    found = np.flatnonzero(mark)
    return np.bincount(found >> BITS, minlength=len(texts)), found & ((1 << BITS) - 1)


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in pieces of bounded bytes and rows, with their indicators."""
    for part in slices(batch, "text", PIECE_BYTES):
        for lo in range(0, part.num_rows, PIECE_TEXTS):
            piece = part.slice(lo, PIECE_TEXTS)
            yield piece, *indicators(utf8(piece.column("text")))


@dataclass
class Model:
    """``score = 1 / (1 + exp(-(slope * (sum(weight) / sqrt(sum(square)) + bias) + shift)))``."""

    weight: np.ndarray | None
    square: np.ndarray | None
    bias: float
    slope: float
    shift: float

    def score(self, counts: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        margin = np.full(len(counts), self.bias)
        if self.weight is not None and len(buckets):
            text = np.repeat(np.arange(len(counts)), counts)
            size = np.bincount(text, self.square[buckets], len(counts))
            margin += np.bincount(text, self.weight[buckets], len(counts)) / np.sqrt(np.where(size > 0, size, 1))
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -700, 700)))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, rounds: int = ROUNDS, still: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights and intercept of the squared hinge loss on unit rows of scaled indicators:
    one dual coordinate at a time in a new random order each round, until none moves by ``still``."""
    w, bias, alpha, rng = np.zeros(len(ratio)), 0.0, np.zeros(len(rows)), np.random.default_rng(1)
    norm = [float(np.sqrt((ratio[r] ** 2).sum())) or 1.0 for r in rows]
    scaled = [ratio[r] / s for r, s in zip(rows, norm, strict=True)]
    own = np.array([float(s @ s) for s in scaled]) + 1 + 1 / (2 * cost)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            r, x = rows[i], scaled[i]
            slope = y[i] * (float(w[r] @ x) + bias) - 1 + alpha[i] / (2 * cost[i])
            new = max(alpha[i] - slope / own[i], 0.0)
            step = new - alpha[i]
            if step:
                w[r] += step * y[i] * x
                bias += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step) * own[i])
        if moved < still:
            break
    return w, bias


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic of a margin: Newton steps with softened targets."""
    ones, zeros = weight[y > 0].sum(), weight[y < 0].sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, float(np.log((ones + 1) / (zeros + 1)))

    def loss(a: float, b: float) -> float:
        t = a * margin + b
        return float((weight * (np.logaddexp(0, t) - target * t)).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -700, 700)))
        g, h = weight * (p - target), weight * p * (1 - p)
        grad = np.array([(g * margin).sum(), g.sum()])
        hess = np.array([[(h * margin * margin).sum(), (h * margin).sum()], [(h * margin).sum(), h.sum()]]) + 1e-9 * np.eye(2)
        step, scale, now = np.linalg.solve(hess, grad), 1.0, loss(a, b)
        while scale > 1e-6 and loss(a - scale * step[0], b - scale * step[1]) > now:
            scale /= 2
        a, b = a - scale * step[0], b - scale * step[1]
        if abs(scale * step).max() < 1e-8:
            break
    return a, b


def log_ratio(held: np.ndarray) -> np.ndarray:
    """Log-count ratio of a bucket between the classes (rows 0, 1 of ``held``), smoothed."""
    share = (held + 1.0) / (held + 1.0).sum(1, keepdims=True)
    return np.log(share[1] / share[0])


def training_rows(docs: DataFrame, labels: DataFrame, train: str, max_rows: int) -> DataFrame:
    """``(text, label, h, sampled)`` of the labelled rows that ``train``, an SQL condition on
    ``doc_id``, admits; ``h`` hashes the id and ``sampled`` marks those of the smallest."""
    marks = labels.select(F.expr("try_cast(doc_id AS long)").alias("doc_id"), F.expr("try_cast(quality AS int)").alias("q")).where("doc_id IS NOT NULL").where(train)
    marks = marks.groupBy("doc_id").agg(F.min("q").alias("label"), F.max("q").alias("_q"), F.count_if(F.col("q").isNull()).alias("_none"))
    marks = marks.where("label = _q AND label IN (0, 1) AND _none = 0").select("doc_id", "label")
    marks = stash(marks.withColumn("h", F.xxhash64("doc_id")), "marks")
    cut = lambda label: [r.h for r in marks.where(F.col("label") == label).select("h").orderBy("h").limit(max_rows // 2).collect()]
    last = {label: max(cut(label), default=-(2**63)) for label in (0, 1)}
    rows = docs.select(F.expr("try_cast(doc_id AS long)").alias("doc_id"), "text")
    near = bounded(marks, MAX_LABELS, 32 * MAX_LABELS)
    joined = rows.join(near, "doc_id") if near is not marks else skew_join(rows, marks, ["doc_id"])
    return joined.select("text", "label", "h", F.expr(f"h <= IF(label = 1, {last[1]}, {last[0]})").alias("sampled"))


STATE = "kind int, part int, label int, h long, data binary"


def fit(rows: DataFrame, max_rows: int) -> Model:
    """The model of :func:`training_rows`."""
    size = 1 << BITS

    def read(batches):
        from pyspark import TaskContext

        held, texts = np.zeros((2, size), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for piece, counts, buckets in pieces(batch):
                label = piece.column("label").to_numpy()
                held[1] += np.bincount(buckets[np.repeat(label == 1, counts)], minlength=size)
                held[0] += np.bincount(buckets[np.repeat(label == 0, counts)], minlength=size)
                texts += np.bincount(label, minlength=2)
                ends = np.cumsum(counts)
                some = np.flatnonzero(piece.column("sampled").to_numpy(zero_copy_only=False))
                data = [buckets[ends[i] - counts[i] : ends[i]].astype(np.int32).tobytes() for i in some.tolist()]
                h = piece.column("h").to_numpy()[some]
                if len(some):
                    yield _rows([1] * len(some), [0] * len(some), label[some].tolist(), h.tolist(), data)
        if texts.any():
            yield _rows([0], [TaskContext.get().partitionId()], [0], [0], [np.r_[texts, held.ravel()].tobytes()])

    def total(key, table):
        sums = sum(np.frombuffer(d.as_py(), np.int64) for d in table.column("data"))
        return pa.Table.from_batches([_rows([0], [key[0].as_py()], [0], [0], [sums.tobytes()])])

    states = stash(rows.mapInArrow(read, STATE), "class-counts")
    sums = states.where("kind = 0")
    while (sums.agg(F.max("part")).first()[0] or 0) > 0:
        sums = stash(sums.withColumn("part", F.expr(f"part div {FAN}").cast("int")).groupBy("part").applyInArrow(total, STATE), "class-counts")
    one = sums.first()
    if one is None:
        return Model(None, None, 0.0, 1.0, 0.0)
    flat = np.frombuffer(bytes(one.data), np.int64)
    texts = flat[:2].copy()
    if not texts.all():
        return Model(None, None, 0.0, 1.0, float(np.log((texts[1] + 1) / (texts[0] + 1))))
    ratio = log_ratio(flat[2:].reshape(2, size))

    def solve(key, table):
        order = np.lexsort((table.column("label").to_numpy(), table.column("h").to_numpy()))
        y = np.where(table.column("label").to_numpy()[order] == 1, 1.0, -1.0)
        data = table.column("data")
        sets = [np.frombuffer(data[i].as_py(), np.int32) for i in order.tolist()]
        share = np.where(y > 0, texts[1] / max((y > 0).sum(), 1), texts[0] / max((y < 0).sum(), 1))
        held = np.zeros(len(y), bool)  # each fourth of a class
        for c in (1.0, -1.0):
            held[np.flatnonzero(y == c)[3::4]] = True
        used = np.flatnonzero(~held)
        each = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
        w, bias = descend([sets[i] for i in used.tolist()], y[used], ratio, COST * each[used])
        model = Model(w * ratio, ratio * ratio, bias, 1.0, 0.0)
        look = held if len(np.unique(y[held])) == 2 else ~held
        some = [sets[i] for i in np.flatnonzero(look).tolist()]
        counts = np.fromiter(map(len, some), np.int64, len(some))
        odds = model.score(counts, np.concatenate(some) if some else np.empty(0, np.int32))
        margin = np.log(odds) - np.log1p(-np.clip(odds, 0, 1 - 1e-16))
        slope, shift = calibrate(margin, y[look], share[look])
        return pa.table({"data": pa.array([np.r_[w * ratio, bias, slope, shift].tobytes()], pa.binary())})

    # one of each text of an id: copies of a row must not fill the sample
    sample = states.where("kind = 1").groupBy("h", "label", F.xxhash64("data").alias("x")).agg(F.first("data").alias("data"))
    sample = sample.orderBy("h", "label", "x").limit(max_rows)
    weights = np.frombuffer(bytes(sample.groupBy(F.lit(0).alias("one")).applyInArrow(solve, "data binary").first().data))
    return Model(weights[:size].copy(), ratio * ratio, *(float(v) for v in weights[size:]))


def _rows(kind: list, part: list, label: list, h: list, data: list) -> pa.RecordBatch:
    cols = [pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(label, pa.int32()), pa.array(h, pa.int64()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["kind", "part", "label", "h", "data"])


def quality_scores(docs: DataFrame, labels: DataFrame, train: str, max_rows: int = 8192) -> DataFrame:
    """``(doc_id, score)`` of each row of ``docs``; ``labels`` ``(doc_id, quality)`` are learnt
    from where ``train`` holds."""
    model = fit(training_rows(docs, labels, train, max_rows), max_rows)
    if model.weight is None:
        return docs.select("doc_id", F.lit(1 / (1 + np.exp(-model.shift))).cast("double").alias("score"))

    def score(batches):
        for batch in batches:
            for piece, counts, buckets in pieces(batch):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(model.score(counts, buckets))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
