"""Key hashes and shard choice as columns. 64-bit products wrap, so they are built from 32-bit limbs and stay valid with
ANSI arithmetic on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the finalizer: shifts 33, 29, 32 and two odd multipliers.
SHIFTS = (33, 29, 32)
MULTIPLIERS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
MASK = (1 << 64) - 1


def avalanche_int(h: int) -> int:
    """The finalizer on a Python integer."""
    h &= MASK
    for shift, factor in zip(SHIFTS, (*MULTIPLIERS, 1), strict=True):
        h ^= h >> shift
        h = h * factor & MASK
    return h


def _let(x: Column, body) -> Column:
    """body(x) with x evaluated once: written out, each use would repeat all of x's own expression."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2**64 by limbs: 32 bits of x with 16 of the factor give 48 at most."""
    low = F.lit(0xFFFFFFFF).cast("long")
    f = [(factor >> (16 * k)) & 0xFFFF for k in range(4)]

    def product(part: Column, k: int) -> Column:
        return part * F.lit(f[k]).cast("long")

    def body(v: Column) -> Column:
        x0, x1 = v.bitwiseAND(low), F.shiftrightunsigned(v, 32)
        lo = product(x0, 0) + F.shiftleft(product(x0, 1).bitwiseAND(low), 16)
        high = (
            F.shiftrightunsigned(product(x0, 1), 32) * F.lit(1 << 16).cast("long")
            + product(x0, 2)
            + F.shiftleft(product(x0, 3).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
            + product(x1, 0)
            + F.shiftleft(product(x1, 1).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
        )
        return _let(lo, lambda y: F.shiftleft((high + F.shiftrightunsigned(y, 32)).bitwiseAND(low), 32).bitwiseOR(y.bitwiseAND(low)))

    return _let(x, body)


def _folded(shift: int):
    return lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, shift))


def avalanche(h: Column) -> Column:
    """The finalizer; its result is the hash of an integer key (as a signed long)."""
    h = h.cast("long")
    for shift, factor in zip(SHIFTS, MULTIPLIERS, strict=False):
        h = _times(_let(h, _folded(shift)), factor)
    return _let(h, _folded(SHIFTS[2]))


def key_hash(key: Column, kind: str = "bigint") -> Column:
    """Integer keys hash reproducibly; other keys take a fixed 64-bit hash."""
    return avalanche(key) if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)


def shard(h: Column, shards: int | Column) -> Column:
    shards = F.lit(shards) if isinstance(shards, int) else shards
    return h.bitwiseAND((shards - 1).cast("long")).cast("int")
