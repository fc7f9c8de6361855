"""Connected components of an edge table by repeated star contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs, a <> b). Result: node, root (the smallest node that it reaches), for nodes with an edge.

    Alternates two steps until nothing changes: every node links its larger neighbours to its smallest neighbour (large
    star), then its smaller neighbours and itself to the smallest (small star). Each step is a grouped minimum and one
    join on the node, so a hub's neighbours are never gathered in one place. The pairs of each round replace the last.

    Defined cases: repeated edges and both directions of one count once; an edge from a node to itself or to null is no
    edge; no edges give an empty result.
    """
    pairs = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:  # a step that changes anything lowers a link, so this ends
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        done, pairs = pairs, saved(small.where("u <> v").distinct(), "edges")
        discard(done)
        now = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
