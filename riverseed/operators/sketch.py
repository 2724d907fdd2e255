"""Seeds of texts read as bases, and of signals: levels to buckets to hashed e-grams."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signal_math import hash64_np, pore_levels, quantize_np
from ..options import Options
from ..work import spread
from .clock import marks

K, GRAM = 6, 8
SEEDS = "id long, pos int, hash long"
_DROP = bytes(i for i in range(256) if not (65 <= i <= 90 or 97 <= i <= 122))
_WHITE = b" \t\r\n\x0b\x0c"
#: The codes of the bases, U as T, in either case; 4 is any other character.
BASES = {"A": 0, "C": 1, "G": 2, "T": 3, "U": 3}
_CODE = np.full(256, 4, np.int64)
for _c, _v in BASES.items():
    _CODE[[ord(_c), ord(_c.lower())]] = _v


def bases(text: bytes, strand: int = 0, alphabet: str = "letters") -> np.ndarray:
    """Base codes of a text; strand 1 is the reverse complement. ``dna``: A, C, G, T or U;
    white space is no base, and any other character leaves the k-mer before it as it is, so
    it is marked 4. ``letters`` folds all letters to four bases and drops the rest."""
    if alphabet == "letters":
        base = (np.frombuffer(text.translate(None, _DROP).lower(), np.uint8).astype(np.int64) - 97) % 4
    elif alphabet == "dna":
        base = _CODE[np.frombuffer(text.translate(None, _WHITE), np.uint8)]
    else:
        raise ValueError(f"no alphabet {alphabet!r}")
    return np.where(base[::-1] < 4, 3 - base[::-1], 4) if strand else base


def kmer_codes(base: np.ndarray, k: int = K) -> np.ndarray:
    """The code at each place that has ``k`` characters up to it: that of the last ``k``
    bases, fewer at the begin, as characters that are no base are passed over."""
    if len(base) < k:
        return np.empty(0, np.int64)
    known = base < 4
    real = np.r_[np.zeros(k, np.int64), base[known]]
    codes = sum(real[i + 1 : len(real) - k + i + 1] << 2 * (k - 1 - i) for i in range(k))
    return np.r_[0, codes][np.cumsum(known)[k - 1 :]]


def revcomp_codes(code: np.ndarray, k: int = K) -> np.ndarray:
    """Codes of the reverse complements of k-mers."""
    return sum((3 - (code >> 2 * i & 3)) << 2 * (k - 1 - i) for i in range(k))


def kept(levels: np.ndarray, diff: float, last: float = np.inf) -> np.ndarray:
    """Places of the values that differ by ``diff`` or more from the last one kept, of which
    ``last`` is the one before them."""
    if diff <= 0 or not len(levels):
        return np.arange(len(levels))
    n = len(levels)
    after = np.arange(1, n + 1)  # the next place that differs enough from each; further looks only for those that need it
    open_ = np.flatnonzero(np.abs(np.diff(levels)) < diff)
    for step in range(2, 9):
        after[open_] = open_ + step
        open_ = open_[open_ < n - step]
        open_ = open_[np.abs(levels[open_ + step] - levels[open_]) < diff]
    after[open_] = 0
    after, far = after.tolist(), np.flatnonzero(np.abs(levels - last) >= diff) if last < np.inf else [0]
    i, out = int(far[0]) if len(far) else n, []
    while i < n:
        out.append(i)
        i = after[i] or _later(levels, i, diff)
    return np.array(out, np.int64)


def _later(levels: np.ndarray, i: int, diff: float) -> int:
    """The first place nine or more after ``i`` whose value differs by ``diff`` or more."""
    lo, size = i + 9, 16
    while lo < len(levels):
        hit = np.abs(levels[lo : lo + size] - levels[i]) >= diff
        if hit.any():
            return lo + int(np.argmax(hit))
        lo, size = lo + size, min(2 * size, 4096)
    return len(levels)


def grams(buckets: np.ndarray, e: int = GRAM, bits: int = 4) -> np.ndarray:
    n = len(buckets) - e + 1
    return sum(buckets[i : n + i] << bits * (e - 1 - i) for i in range(e)) if n > 0 else np.empty(0, np.int64)


def minimizers(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of hashes that are the least of some ``w`` in a row, ties included; of a
    shorter run the last of its least ones."""
    n = len(hashes)
    if w <= 1 or not n:
        return np.arange(n)
    if n < w:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    least = np.lib.stride_tricks.sliding_window_view(hashes, w).min(axis=1)
    pad = np.r_[np.full(w - 1, -1), least, np.full(w - 1, -1)]
    return np.flatnonzero(np.lib.stride_tricks.sliding_window_view(pad, w).max(axis=1) == hashes)


def pore_of(model: DataFrame | None, k: int) -> np.ndarray:
    """Levels by code of a pore model ``(code, level)`` of k-mers, at most ``4**k`` rows; of
    none the model that is made by rule."""
    if model is None:
        return pore_levels(k)
    out = np.full(4**k, np.nan)
    for r in model.select("code", "level").collect():
        out[r.code] = r.level
    if np.isnan(out).any():
        raise ValueError(f"the pore model lacks {int(np.isnan(out).sum())} of {4**k} k-mers")
    return out


def buckets_of(values: np.ndarray, o: Options) -> np.ndarray:
    return quantize_np(values, o.fine_range, o.fine_min, o.fine_max, o.q)


def sketch_values(values: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the seeds of a run of events."""
    at = kept(values, o.diff)
    h = hash64_np(grams(buckets_of(values[at], o), o.e, o.q))
    pick = minimizers(h, o.w)
    return at[: len(h)][pick], h[pick]


def seed_hashes(text: bytes, buckets: np.ndarray) -> np.ndarray:
    """Hash of the e-gram that starts at each place of the text's letters."""
    return hash64_np(grams(buckets[kmer_codes(bases(text))]))


def _flat(ids: pa.Array, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ids = ids.take(pa.array(np.repeat(np.arange(len(found)), [len(p) for p, _ in found])))
    return pa.record_batch([ids, *[pa.array(np.concatenate([x[i] for x in found] or [np.empty(0)]).astype(t)) for i, t in ((0, np.int32), (1, np.int64))]], names=["id", "pos", "hash"])


def _marked(ids: pa.Array, found: list[tuple[np.ndarray, np.ndarray]], at: list[int], clock: bool) -> Iterator[pa.RecordBatch]:
    """The seeds of each id, and with ``clock`` the time from one of ``at`` to the next."""
    if not clock:
        yield _flat(ids, found)
    else:
        yield from marks(_flat(ids, found), ids, [(y - x) // 1000 for x, y in zip(at[:-1], at[1:])])


def _texts(rows: DataFrame, key: str) -> DataFrame:
    """``(id, text)``; a stream stays as it is."""
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows if rows.isStreaming else spread(rows)


def seeds(rows: DataFrame, key: str, strand: int = 0, o: Options | None = None, pore: np.ndarray | None = None, clock: bool = False, **how) -> DataFrame:
    """``(id, pos, hash)`` of the whole ``text`` of each row by the settings ``o`` (regular
    seeds without collapse if none are given, with ``how`` in their place); no shuffle but
    that of a small table to all cores. With ``clock`` there are :func:`clock.marks`."""
    o = Options(**{"w": 0, "diff": 0.0, **how}) if o is None else o
    levels = pore_levels(o.k) if pore is None else pore

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                found, at = [], [time.perf_counter_ns()]
                for t in texts:
                    found.append(sketch_values(levels[kmer_codes(bases(t or b"", strand, o.alphabet), o.k)], o))
                    at.append(time.perf_counter_ns())
                yield from _marked(part.column("id"), found, at, clock)

    return _texts(rows, key).mapInArrow(run, SEEDS + ", us long" * clock)


def signal_seeds(chunks: DataFrame, o: Options, clock: bool = False) -> DataFrame:
    """``(id, pos, hash)`` of the used chunks of :func:`signal.chunk_events`; no seed crosses
    a chunk's border, and places are events of the whole read. With ``clock`` there are
    :func:`clock.marks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("events")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(b.column("n_events").to_numpy())
            found, at = [], [time.perf_counter_ns()]
            for lo, hi, x in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), b.column("offset").to_pylist(), strict=True):
                p, h = sketch_values(flat[lo:hi], o)
                found.append((p + x, h))
                at.append(time.perf_counter_ns())
            yield from _marked(b.column("id"), found, at, clock)

    rows = chunks.where("used").select(F.col("read_id").cast("long").alias("id"), "offset", "n_events", "events")
    return rows.mapInArrow(run, SEEDS + ", us long" * clock)


def kmers(rows: DataFrame, key: str, o: Options | None = None, pore: np.ndarray | None = None) -> DataFrame:
    """``(id, pos, code, rc_code, level)`` of each k-mer of the ``text``."""
    o = o or Options()
    levels = pore_levels(o.k) if pore is None else pore

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                codes = [kmer_codes(bases(t or b"", 0, o.alphabet), o.k) for t in part.column("text").cast(pa.binary()).to_pylist()]
                n = [len(c) for c in codes]
                code = np.concatenate([np.empty(0, np.int64), *codes])
                pos = np.concatenate([np.empty(0, np.int32), *[np.arange(x, dtype=np.int32) for x in n]])
                ids = part.column("id").take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.record_batch([ids, pa.array(pos), pa.array(code), pa.array(revcomp_codes(code, o.k)), pa.array(levels[code])], names=["id", "pos", "code", "rc_code", "level"])

    return _texts(rows, key).mapInArrow(run, "id long, pos int, code long, rc_code long, level double")
