"""Scalar pieces of the sketch: the 32-bit hash and the quantizer, as columns and in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The mask, and the shifts 21, 24, 3 and 8, 14, 2 and 4, 28, 31 of the hash in both forms below.
MASK = 0xFFFFFFFF


def hash64(key: Column) -> Column:
    """Invertible hash of the low 32 bits; every step is masked, so nothing overflows."""
    m = F.lit(MASK)
    keep = lambda c: c.bitwiseAND(m)
    k = keep(key.cast("long"))
    k = keep((m - k) + F.shiftleft(k, 21))
    k = k.bitwiseXOR(F.shiftright(k, 24))
    k = keep(k + F.shiftleft(k, 3) + F.shiftleft(k, 8))
    k = k.bitwiseXOR(F.shiftright(k, 14))
    k = keep(k + F.shiftleft(k, 2) + F.shiftleft(k, 4))
    k = k.bitwiseXOR(F.shiftright(k, 28))
    return keep(k + F.shiftleft(k.bitwiseAND(F.lit(1)), 31))


def hash64_np(key: np.ndarray) -> np.ndarray:
    m = np.uint64(MASK)
    s = lambda k, n: k << np.uint64(n)
    k = key.astype(np.uint64) & m
    k = ((m - k) + s(k, 21)) & m
    k ^= k >> np.uint64(24)
    k = (k + s(k, 3) + s(k, 8)) & m
    k ^= k >> np.uint64(14)
    k = (k + s(k, 2) + s(k, 4)) & m
    k ^= k >> np.uint64(28)
    return ((k + s(k & np.uint64(1), 31)) & m).astype(np.int64)


def quantize(s: Column, fine_range: float = 0.4, fine_min: float = -2.0, fine_max: float = 2.0, bits: int = 4) -> Column:
    """Bucket of a z-score: fine buckets between the limits, coarse ones outside."""
    a, b, c1 = (fine_min + 3) / 6, (fine_max + 3) / 6, (1 - fine_range) / 2
    norm = (s + 3.0) / 6.0
    fine = F.lit(fine_range) * ((norm - a) / (b - a))
    x = F.when(s.between(fine_min, fine_max), fine).when(norm < 0.5, F.lit(fine_range) + c1 * norm).otherwise(F.lit(fine_range + c1) + c1 * norm)
    top = (1 << bits) - 1
    return (x * top).cast("int").bitwiseAND(F.lit(top))


def quantize_np(s: np.ndarray, fine_range: float = 0.4, fine_min: float = -2.0, fine_max: float = 2.0, bits: int = 4) -> np.ndarray:
    a, b, c1 = (fine_min + 3) / 6, (fine_max + 3) / 6, (1 - fine_range) / 2
    norm = (s + 3.0) / 6.0
    x = np.where((s >= fine_min) & (s <= fine_max), fine_range * ((norm - a) / (b - a)), np.where(norm < 0.5, fine_range + c1 * norm, fine_range + c1 + c1 * norm))
    return (x * ((1 << bits) - 1)).astype(np.int64) & ((1 << bits) - 1)


def pore_levels(k: int = 6) -> np.ndarray:
    """A synthetic pore model: z-scored levels by k-mer code."""
    x = hash64_np(np.arange(4**k)) % 10_000 / 100.0
    return (x - x.mean()) / x.std()
