"""Stack distance of read-through LRU: an access hits exactly if fewer than ``capacity`` distinct keys were touched
since the last access to its key. One pass gives the hit ratio at every capacity.

Let an access have position t among its shard's, and its key's last access position p. The distinct keys between are the
accesses before t whose own last access is at p or earlier, without the p accesses up to p. These pairs (position, last
position) are counted in squares: whole squares by sums over a matrix of blocks, and the two strips that an access's own
blocks leave, of SPAN positions each, by merging counts inside them. So no task holds a shard's trace, however long; where
no shard has more than SPAN accesses, its one block is all there is to count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 18  # positions of a block


def smaller_before(place, value, queries):
    """For each i the number of j with place[j] < place[i] and value[j] <= queries[i], by a merge over powers of two."""
    import numpy as np

    order = np.argsort(place, kind="stable")
    group = np.cumsum(np.r_[0, place[order][1:] != place[order][:-1]])  # equal places don't come before each other
    value, ask = value[order], queries[order]
    out = np.zeros(len(order), np.int64)
    most = max(int(value.max(initial=0)), int(ask.max(initial=0))) + 2
    for level in range(int(group.max(initial=0)).bit_length()):
        half = group >> level
        left, right = half % 2 == 0, half % 2 == 1  # of pairs of neighbours, the first and the second
        key = np.sort((half[left] >> 1) * most + value[left])
        pair = half[right] >> 1
        out[right] += np.searchsorted(key, pair * most + ask[right], "right") - np.searchsorted(key, pair * most)
    back = np.empty_like(out)
    back[order] = out
    return back


def positions(trace: DataFrame, span: int) -> DataFrame:
    """trace (cache, shard, seq, key) plus t, the position from 1 on, and p, that of the key's last access (0: none)."""
    rows = trace.select("cache", "shard", "seq", "key").withColumn("b", F.floor(F.col("seq") / span))
    counts = rows.groupBy("cache", "shard", "b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("cache", "shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    base = counts.select("cache", "shard", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("cache", "shard", "b").orderBy("seq")
    rows = rows.withColumn("t", F.row_number().over(own)).join(base, ["cache", "shard", "b"]).withColumn("t", F.col("t") + F.col("base"))
    # The last access in the same block, or the last one in the last block that has any.
    inside = F.lag("t").over(Window.partitionBy("cache", "shard", "b", "key").orderBy("t"))
    rows = rows.withColumn("p", inside)
    ends = rows.groupBy("cache", "shard", "key", "b").agg(F.max("t").alias("end"))
    ends = ends.withColumn("end", F.lag("end").over(Window.partitionBy("cache", "shard", "key").orderBy("b")))
    rows = rows.join(ends, ["cache", "shard", "key", "b"])
    return rows.select("cache", "shard", "seq", "key", "t", F.coalesce("p", "end", F.lit(0)).cast("long").alias("p"))


def strip(rows: DataFrame, by: str, place: str, name: str) -> DataFrame:
    """Of each block ``by`` for each of its rows with a last access: the rows of the block at a smaller ``place`` whose last
    access is not after its own."""

    def run(pdf):
        import numpy as np

        n = smaller_before(pdf[place].to_numpy(), pdf["p"].to_numpy(), pdf["p"].to_numpy())
        out = pdf.assign(**{name: np.where(pdf["p"] > 0, n, 0)})
        return out[out["p"] > 0][["cache", "shard", "t", name]]

    return rows.select("cache", "shard", by, "t", "p", *({place} - {"t"})).groupBy("cache", "shard", by).applyInPandas(run, f"cache string, shard int, t long, {name} long")


def in_one_block(trace: DataFrame) -> DataFrame:
    """Distances where every shard is one block."""

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("seq", ignore_index=True)
        t = np.arange(1, len(pdf) + 1)
        p = pdf.assign(t=t).groupby("key")["t"].shift(fill_value=0).to_numpy()
        return pdf.assign(distance=np.where(p > 0, smaller_before(t, p, p) - p, -1))

    return trace.select("cache", "shard", "seq", "key").groupBy("cache", "shard").applyInPandas(run, "cache string, shard int, seq long, key long, distance long")


def stack_distance(trace: DataFrame, span: int = SPAN) -> DataFrame:
    """trace: cache, shard, seq, key -> cache, shard, seq, key, distance (-1 on a first access)."""
    longest = trace.groupBy("cache", "shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (longest or 0) <= span:
        return in_one_block(trace)
    block = lambda c: F.when(F.col(c) > 0, F.floor((F.col(c) - 1) / span)).otherwise(F.lit(-1)).cast("long")
    rows = positions(trace, span).withColumns({"tb": block("t"), "pb": block("p")}).persist()  # read by five branches
    # All first accesses lie below every block of last positions, so they are in the matrix and in the blocks of t alone.
    by_t = strip(rows, "tb", "t", "same_t")
    by_p = strip(rows.where("pb >= 0"), "pb", "tb", "same_p")
    cells = rows.groupBy("cache", "shard", "tb", "pb").agg(F.count(F.lit(1)).alias("n"))
    tall = cells.select("cache", "shard", "tb").distinct()
    wide = cells.select("cache", "shard", "pb").distinct()
    grid = tall.join(wide, ["cache", "shard"]).join(cells, ["cache", "shard", "tb", "pb"], "left").fillna(0, ["n"])
    below = Window.partitionBy("cache", "shard", "tb").orderBy("pb").rowsBetween(Window.unboundedPreceding, -1)
    left = Window.partitionBy("cache", "shard", "pb").orderBy("tb").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("n", F.coalesce(F.sum("n").over(below), F.lit(0))).withColumn("whole", F.coalesce(F.sum("n").over(left), F.lit(0)))
    out = rows.join(grid.select("cache", "shard", "tb", "pb", "whole"), ["cache", "shard", "tb", "pb"])
    out = out.join(by_t, ["cache", "shard", "t"], "left").join(by_p, ["cache", "shard", "t"], "left")
    n = F.col("whole") + F.col("same_t") + F.col("same_p") - F.col("p")
    return out.select("cache", "shard", "seq", "key", F.when(F.col("p") > 0, n).otherwise(F.lit(-1)).cast("long").alias("distance"))


def hit_curve(trace: DataFrame, capacities: list[int], span: int = SPAN) -> DataFrame:
    """capacity, hits, lookups, hit_ratio from one pass over the trace."""
    d = stack_distance(trace, span)
    counts = d.agg(F.count(F.lit(1)).alias("lookups"), *[F.count_if((F.col("distance") >= 0) & (F.col("distance") < c)).alias(f"h{c}") for c in capacities])
    rows = F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("capacity"), F.col(f"h{c}").alias("hits")) for c in capacities]))
    out = counts.select("lookups", rows.alias("x")).select("x.capacity", "x.hits", "lookups")
    return out.withColumn("hit_ratio", F.when(F.col("lookups") > 0, F.col("hits") / F.col("lookups")).otherwise(F.lit(0.0)))
