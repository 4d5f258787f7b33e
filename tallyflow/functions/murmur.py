"""MurmurHash3_x86_32 of four little-endian bytes with any seed, on Spark's own generated code.

Spark's ``hash(a, b)`` hashes b with hash(a) as its seed, and for a fixed seed
the function is a bijection on four-byte inputs.  So for every seed there is
an integer whose hash is that seed, and ``hash(lit(it), key)`` is the hash of
the key under the wanted seed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M = 0xFFFFFFFF
#: constants of MurmurHash3 (fixed values)
C1, C2, ADD, F1, F2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
SPARK_SEED = 42


def _rotl(x: int, r: int) -> int:
    return (x << r | x >> (32 - r)) & M


def murmur3(key: int, seed: int) -> int:
    k = _rotl(key * C1 & M, 15) * C2 & M
    h = (_rotl(seed ^ k, 13) * 5 + ADD & M) ^ 4
    h = (h ^ h >> 16) * F1 & M
    h = (h ^ h >> 13) * F2 & M
    return h ^ h >> 16


def preimage(seed: int) -> int:
    """The 32-bit value whose hash under Spark's seed is ``seed``, as a signed integer."""
    inv = lambda c: pow(c, -1, 1 << 32)
    h = seed & M
    h ^= h >> 16
    h = h * inv(F2) & M
    h ^= h >> 13 ^ h >> 26
    h = h * inv(F1) & M
    h ^= h >> 16
    h = _rotl(((h ^ 4) - ADD) * inv(5) & M, 19) ^ SPARK_SEED
    k = _rotl(h * inv(C2) & M, 17) * inv(C1) & M
    if murmur3(k, SPARK_SEED) != seed & M:
        raise AssertionError("the inverse is wrong")
    return k - (1 << 32) if k >> 31 else k


def murmur_column(key: Column, seed: int) -> Column:
    """The unsigned hash as BIGINT; ``key`` is an unsigned 32-bit value in a BIGINT."""
    signed = F.when(key >= 1 << 31, key - (1 << 32)).otherwise(key).cast("int")
    return F.hash(F.lit(preimage(seed)).cast("int"), signed).cast("long").bitwiseAND(F.lit(M))
