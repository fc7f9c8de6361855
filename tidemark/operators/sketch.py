"""Approximate frequency kept by the admission policy: aging counters in blocks, a two-probe first-touch filter, and
sets of recently evicted fingerprints. Plain numpy and dict state for use inside one shard's replay; the first-touch filter
also as a table of the bits' first settings, without any order of processing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LEAST_COUNTERS, BLOCK, MOST, AGING = 1024, 128, 15, 10
PROBES = (21, 28, 35, 42)


def power_of_two(n: int) -> int:
    return 1 if n <= 1 else 1 << (n - 1).bit_length()


class Sketch:
    """Four saturating counters a key, all in the key's block of 128; the minimum estimates."""

    def __init__(self, counters: int):
        n = power_of_two(max(counters, LEAST_COUNTERS))
        self.cells = np.zeros(n, np.uint8)
        self.blocks = n // BLOCK - 1
        self.samples, self.reset_at = 0, n * AGING

    def places(self, av: int) -> list[int]:
        base = (av & self.blocks) * BLOCK
        return [base + (av >> s & BLOCK - 1) for s in PROBES]

    def add(self, av: int) -> None:
        """Probes may meet in one counter, which then counts each of them; full minima don't count at all."""
        at = self.places(av)
        if min(self.cells[i] for i in at) < MOST:
            for i in at:
                if self.cells[i] < MOST:
                    self.cells[i] += 1

    def estimate(self, av: int) -> int:
        return int(min(self.cells[i] for i in self.places(av)))

    def age(self) -> None:
        self.cells >>= 1
        self.samples = 0

    def clear(self) -> None:
        self.cells[:] = 0
        self.samples = 0


class Doorkeeper:
    """Whether a key was seen since the last aging."""

    def __init__(self, bits: int):
        self.size = power_of_two(max(bits, 64))
        self.bits: set[int] = set()

    def _two(self, av: int) -> tuple[int, int]:
        return av & self.size - 1, av >> 32 & self.size - 1

    def add(self, av: int) -> bool:
        i, j = self._two(av)
        known = i in self.bits and j in self.bits
        self.bits.update((i, j))
        return known

    def __contains__(self, av: int) -> bool:
        i, j = self._two(av)
        return i in self.bits and j in self.bits

    def clear(self) -> None:
        self.bits.clear()


class Ghosts:
    """The last n fingerprints that were added, first in first out; a removed one leaves its slot empty until the ring
    comes round, and one that is in is not added again."""

    def __init__(self, n: int):
        self.n, self.at = n, 0
        self.slot: dict[int, int] = {}
        self.ring: list[int | None] = [None] * n

    def __contains__(self, h: int) -> bool:
        return h in self.slot

    def __len__(self) -> int:
        return len(self.slot)

    def add(self, h: int) -> None:
        if not self.n or h in self.slot:
            return
        old = self.ring[self.at]
        if old is not None and self.slot.get(old) == self.at:
            del self.slot[old]
        self.ring[self.at], self.slot[h] = h, self.at
        self.at = (self.at + 1) % self.n

    def remove(self, h: int) -> bool:
        i = self.slot.pop(h, None)
        if i is not None:
            self.ring[i] = None
        return i is not None

    def clear(self) -> None:
        self.slot.clear()
        self.ring, self.at = [None] * self.n, 0


def first_touches(trace: DataFrame, av: Column, bits: int) -> DataFrame:
    """trace (shard, seq, key, ...) plus ``known``: whether the filter of its shard had both bits of the key when the row
    came. av: the avalanched hash, the same for all rows of a key. A bit is set from the first row of any of its keys on,
    so a row knows its key if both of its bits were set before; that is found out once for each key."""
    size = F.lit(power_of_two(max(bits, 64)) - 1).cast("long")
    keys = trace.groupBy("shard", "key").agg(F.min("seq").alias("_first"), F.first("hash").alias("hash"))
    keys = keys.withColumn("_av", av).withColumns({"_i": F.col("_av").bitwiseAND(size), "_j": F.shiftrightunsigned("_av", 32).bitwiseAND(size)})
    since = keys.select("shard", "_first", F.explode(F.array("_i", "_j")).alias("_bit")).groupBy("shard", "_bit").agg(F.min("_first").alias("_since"))
    for name in ("_i", "_j"):
        own = since.select("shard", F.col("_bit").alias(name), F.col("_since").alias(f"{name}_since"))
        keys = keys.join(own, ["shard", name])
    keys = keys.select("shard", "key", F.greatest("_i_since", "_j_since").alias("_from"))
    return trace.join(keys, ["shard", "key"]).withColumn("known", F.col("_from") < F.col("seq")).drop("_from")
