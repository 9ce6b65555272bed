"""Seeded integer hashes modulo the Mersenne prime 2**31 - 1.

Every product of two residues stays below 2**62, so BIGINT arithmetic is exact and the same
numbers come out of a Catalyst expression, of NumPy int64 arrays and of any SQL engine. Ids beyond
the prime are two digits in base PRIME, and the higher one is mixed in with a factor of its own, so
that no two ids share their hashes by being PRIME apart. The functions below take either a
``Column`` or an integer array; only ``_residue`` and the final floating-point step differ.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647

# Coefficients of the hash polynomials (any residues below PRIME would do).
PAIRWISE = (48271, 11)
FOURWISE = (16807, 69621, 39373, 62089911)
MIX_ROW = 1103515245
MIX_COL = 742938285
HIGH = 630360016


def _residue(x):
    """(low digit + HIGH * high digit) modulo PRIME, never negative; the value itself below PRIME."""
    if isinstance(x, Column):
        x, prime = x.cast("bigint"), F.lit(PRIME).cast("bigint")
        low = F.pmod(x, prime)
        high = F.call_function("div", x - low, prime)
        return F.pmod(low + F.pmod(high, prime) * HIGH, prime)
    x = np.asarray(x, dtype=np.int64)
    low = np.mod(x, PRIME)
    return np.mod(low + np.mod((x - low) // PRIME, PRIME) * HIGH, PRIME)


def _quintic(t):
    """x -> x**5, a permutation of the residues because gcd(5, PRIME - 1) = 1."""
    square = t * t % PRIME
    return square * square % PRIME * t % PRIME


def mixed(i, j, seed: int):
    """Residue that depends non-linearly on the pair (i, j)."""
    inner = _quintic((_residue(i) * MIX_ROW + seed % PRIME) % PRIME)
    return _quintic((inner + _residue(j) * MIX_COL % PRIME) % PRIME)


def pairwise_bucket(x, buckets: int, coef: tuple[int, int] = PAIRWISE):
    """((a x + b) mod p) mod buckets."""
    a, b = coef
    return (_residue(x) * a + b) % PRIME % buckets


def fourwise_sign(x, coef: tuple[int, int, int, int] = FOURWISE):
    """Sign +1/-1 from a cubic polynomial, reduced modulo p at every Horner step."""
    r = _residue(x)
    h = coef[0]
    for c in coef[1:]:
        h = (r * h + c) % PRIME
    return (h % 2) * 2 - 1


def uniform_hash(i, j, seed: int = 0):
    """Number in (0, 1) determined by (seed, i, j), independent of partitioning."""
    return (mixed(i, j, seed) + 0.5) / float(PRIME)


def random_sign(x, seed: int = 0):
    return (mixed(x, _zero_like(x), seed) % 2) * 2 - 1


def random_bucket(x, buckets: int, seed: int = 0):
    return mixed(x, _zero_like(x), seed + 1) % buckets


def gaussian_hash(i, r, seed: int = 0):
    """N(0, 1) draw for (seed, i, r): Box-Muller on two hashed uniforms."""
    if isinstance(i, Column) or isinstance(r, Column):
        i, r = _column(i), _column(r).cast("bigint")
        u1, u2 = uniform_hash(i, r * 2, seed), uniform_hash(i, r * 2 + 1, seed)
        return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * np.pi) * u2)
    r = np.asarray(r, dtype=np.int64)
    u1, u2 = uniform_hash(i, r * 2, seed), uniform_hash(i, r * 2 + 1, seed)
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * np.pi * u2)


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _zero_like(x):
    return F.lit(0) if isinstance(x, Column) else 0
