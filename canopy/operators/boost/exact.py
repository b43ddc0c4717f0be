"""Order-free sums: the same result for any partitioning and any order of tasks.

``split_sums`` turns doubles into integer sums per binary exponent, which Spark adds as longs;
``total`` puts them together and rounds once.  Histograms, whose values share a known bound, use one
scale per tree instead (``scale_bits``): gradients become integers of at most 2**bits.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

#: Bits of the mantissa's low half; its sum over up to 2**26 rows is exact in a double.
LOW = 27
#: The exponent under which infinite and missing values are counted.
NOT_FINITE = 5000
#: Bits of a gradient's integer at most, so that 2**14 of them add up exactly in a double.
MAX_BITS = 38
BLOCK_ROWS = 1 << 14


def split_sums(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(exponent, sum of high halves, sum of low halves) of the values' 53-bit integers."""
    values = np.asarray(values, np.float64)
    bits = np.ascontiguousarray(values).view(np.int64)
    biased = (bits >> 52) & 0x7FF
    if len(values) and biased.min() > 0 and biased.max() < 0x7FF:
        return _normal_sums(bits, biased)
    finite = np.isfinite(values)
    out = [] if finite.all() else [(NOT_FINITE, int((~finite).sum()), 0)]
    m, e = np.frexp(values[finite])
    q = np.ldexp(m, 53).astype(np.int64)
    exps, inv = np.unique(e, return_inverse=True)
    high = np.bincount(inv, (q >> LOW).astype(np.float64), len(exps))
    low = np.bincount(inv, (q & ((1 << LOW) - 1)).astype(np.float64), len(exps))
    return out + [(int(x), int(h), int(lo)) for x, h, lo in zip(exps, high, low)]


def _normal_sums(bits: np.ndarray, biased: np.ndarray) -> list[tuple[int, int, int]]:
    """``split_sums`` of normal numbers, from their bits."""
    q = (bits & ((1 << 52) - 1)) | (1 << 52)
    if (bits < 0).any():
        q = np.where(bits < 0, -q, q)
    first = int(biased.min())
    at = biased - first
    high = np.bincount(at, (q >> LOW).astype(np.float64))
    low = np.bincount(at, (q & ((1 << LOW) - 1)).astype(np.float64))
    return [(int(k) + first - 1022, int(high[k]), int(low[k])) for k in np.flatnonzero((high != 0) | (low != 0))]


def total(parts) -> float:
    """The sum of (exponent, high, low) parts, rounded once; infinite if any value was not finite."""
    parts = list(parts)
    if any(e == NOT_FINITE and h for e, h, _ in parts):
        return math.inf
    return float(sum((Fraction((h << LOW) + lo) * Fraction(2) ** (e - 53) for e, h, lo in parts), Fraction(0)))


def ceil_log2(x: float) -> int:
    m, e = math.frexp(x)
    return e - 1 if m == 0.5 else e


def scale_bits(bound: float, rows: int) -> int:
    """The power of two by which values of at most ``bound`` are scaled: they stay below 2**MAX_BITS, and
    the sum of ``rows`` of them below 2**61."""
    if not bound > 0 or not math.isfinite(bound):
        return 0
    return min(MAX_BITS, 61 - ceil_log2(max(rows, 1))) - ceil_log2(bound)


def as_integers(values: np.ndarray, bits: int) -> np.ndarray:
    """Scaled and rounded half to even; doubles that hold integers."""
    return np.rint(values * math.ldexp(1.0, bits) if abs(bits) < 1000 else np.ldexp(values, bits))
