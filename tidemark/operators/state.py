"""Keyed state with TTL over an ordered trace, without an eviction limit: Catalyst only.

An entry lives in an *epoch*: the span between clears of its cache. Within (cache, key, epoch) one pass in seq order
finds, for each operation, the entry that the last set left behind, unless a delete came after it or an earlier read
saw it expired (reads remove what they see expired; nothing else does, and an expired entry that nobody read is still
resident). Epochs are counted in two steps, so that no cache's trace passes through one task and nothing is gathered or
broadcast: the clears before a block of the trace from sums of the blocks, and those inside it by a running sum. What is
resident at the end needs no epochs, only the last clear of each cache.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deadline(ts: Column, ttl_ns: Column, default_ns: int) -> Column:
    """0: no expiry. A TTL of 0 takes the default; negative ones mean none."""
    ttl = F.when(ttl_ns == 0, F.lit(default_ns)).otherwise(ttl_ns)
    return F.when(ttl > 0, ts + ttl).otherwise(F.lit(0)).cast("long")


def expired(at: Column, now: Column) -> Column:
    """Strict: an entry is alive at its deadline."""
    return (at > 0) & (now > at)


SPAN = 1 << 16  # values of seq in a block


def epochs(rows: DataFrame, at: str, block: Column) -> DataFrame:
    """rows plus ``epoch``: how many of their cache's clears come before, or are at, their ``at``. block grows with ``at``."""
    rows = rows.withColumn("_block", block)
    sums = rows.groupBy("cache", "_block").agg(F.count_if(F.col("op") == "clear").alias("_n"))  # one row a block
    before = Window.partitionBy("cache").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("cache", "_block", F.sum("_n").over(before).alias("_upto"))
    own = Window.partitionBy("cache", "_block").orderBy(at, F.col("op") != "clear").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.sum(F.when(F.col("op") == "clear", 1).otherwise(0)).over(own)
    out = rows.withColumn("_inside", inside).join(base, ["cache", "_block"])
    return out.withColumn("epoch", (F.col("_inside") + F.coalesce("_upto", F.lit(0))).cast("int")).drop("_block", "_inside", "_upto")


def with_epoch(ops: DataFrame) -> DataFrame:
    return epochs(ops, "seq", F.floor(F.col("seq") / SPAN))


def resolved(ops: DataFrame, default_ns: int) -> DataFrame:
    """Each get, set and delete with the resident entry before it: cur_seq (null: none), cur_value, cur_deadline,
    cur_cost."""
    rows = with_epoch(ops).where("op <> 'clear'")
    own = Window.partitionBy("cache", "key", "epoch").orderBy("seq")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    entry = F.struct(
        F.when(F.col("op") == "set", F.col("seq")).alias("seq"),
        F.col("value").alias("value"),
        deadline(F.col("ts"), F.col("ttl_ns"), default_ns).alias("deadline"),
        F.col("cost").alias("cost"),
    )
    rows = rows.withColumn("_last", F.last(F.when(F.col("op").isin("set", "delete"), entry), ignorenulls=True).over(before))
    # Reads that see the entry expired; all but the first find nothing.
    seen = (F.col("op") == "get") & expired(F.col("_last.deadline"), F.col("ts")) & F.col("_last.seq").isNotNull()
    first = Window.partitionBy("cache", "key", "epoch", "_last.seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_gone", F.coalesce(F.max(seen).over(first), F.lit(False)))
    there = F.col("_last.seq").isNotNull() & ~F.col("_gone")
    for c in ("seq", "value", "deadline", "cost"):
        rows = rows.withColumn(f"cur_{c}", F.when(there, F.col(f"_last.{c}")))
    return rows.drop("_last", "_gone")


def gets(ops: DataFrame, default_ns: int) -> DataFrame:
    """Each read: hit, value, ttl_ns that is left (-1: none), and whether it removed an expired entry."""
    r = resolved(ops, default_ns).where("op = 'get'")
    dead = F.col("cur_seq").isNotNull() & expired(F.col("cur_deadline"), F.col("ts"))
    hit = F.col("cur_seq").isNotNull() & ~dead
    left = F.when(F.col("cur_deadline") == 0, F.lit(-1).cast("long")).otherwise(F.col("cur_deadline") - F.col("ts"))
    return r.select("seq", "cache", "key", hit.alias("hit"), F.when(hit, F.col("cur_value")).alias("value"), F.when(hit, left).alias("ttl_ns"), dead.alias("expired"))


def physical(ops: DataFrame, default_ns: int) -> DataFrame:
    """The entries resident at the end of the trace: cache, key, set_seq, value, deadline, cost. One aggregation a key:
    sums and maxima combine before the shuffle."""
    cleared = ops.where("op = 'clear'").groupBy("cache").agg(F.max("seq").alias("_cleared"))
    rows = ops.where("op <> 'clear'").join(cleared, "cache", "left").where("_cleared IS NULL OR seq > _cleared")
    entry = F.struct("seq", "op", "value", deadline(F.col("ts"), F.col("ttl_ns"), default_ns).alias("deadline"), "cost")
    reads = F.struct(F.when(F.col("op") == "get", F.col("seq")).alias("seq"), "ts")
    out = rows.groupBy("cache", "key").agg(
        F.max_by(entry, F.when(F.col("op").isin("set", "delete"), F.col("seq"))).alias("e"),
        F.max(F.when(F.col("op") == "get", reads)).alias("read"),
    )
    # Time grows along the trace, so the last read after the set decides whether any read saw it expired.
    seen = F.coalesce((F.col("read.seq") > F.col("e.seq")) & expired(F.col("e.deadline"), F.col("read.ts")), F.lit(False))
    return out.where((F.col("e.op") == "set") & ~seen).select("cache", "key", F.col("e.seq").alias("set_seq"), "e.value", "e.deadline", "e.cost")


def end_of(ops: DataFrame) -> DataFrame:
    """The trace's last time, one row."""
    return ops.agg(F.max("ts").alias("now"))


def live(ops: DataFrame, default_ns: int) -> DataFrame:
    """Resident and not expired at the end of the trace."""
    now = F.broadcast(end_of(ops))
    return physical(ops, default_ns).crossJoin(now).where(~expired(F.col("deadline"), F.col("now")))


def sweep(ops: DataFrame, default_ns: int) -> DataFrame:
    """What a cleanup at the end of the trace removes."""
    now = F.broadcast(end_of(ops))
    out = physical(ops, default_ns).crossJoin(now).where(expired(F.col("deadline"), F.col("now")))
    return out.select("cache", "key", F.lit("expired").alias("reason"))


def callbacks(ops: DataFrame, default_ns: int) -> DataFrame:
    """Callbacks that fire: for each set with an expiry, at its deadline the entry then resident must be expired; the
    value passed is the original one. One more timeline a key: the deadlines are probes among the operations."""
    sets = ops.where("op = 'set'").withColumn("at", deadline(F.col("ts"), F.col("ttl_ns"), default_ns)).where("at > 0")
    probe = sets.select(
        (F.col("seq") + F.lit(1 << 60)).alias("seq"), (F.col("at") + 1).alias("ts"), "cache", "key", F.lit("probe").alias("op"), "value",
        F.col("seq").alias("ttl_ns"), "cost",
    )
    ends = end_of(ops)
    rows = with_epoch_by_time(ops, probe)
    own = Window.partitionBy("cache", "key", "epoch").orderBy("ts", "seq")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    entry = F.struct(F.when(F.col("op") == "set", F.col("seq")).alias("seq"), deadline(F.col("ts"), F.col("ttl_ns"), default_ns).alias("deadline"))
    rows = rows.withColumn("_last", F.last(F.when(F.col("op").isin("set", "delete"), entry), ignorenulls=True).over(before))
    seen = (F.col("op") == "get") & expired(F.col("_last.deadline"), F.col("ts")) & F.col("_last.seq").isNotNull()
    first = Window.partitionBy("cache", "key", "epoch", "_last.seq").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_gone", F.coalesce(F.max(seen).over(first), F.lit(False)))
    fires = (F.col("op") == "probe") & F.col("_last.seq").isNotNull() & ~F.col("_gone") & expired(F.col("_last.deadline"), F.col("ts"))
    out = rows.where(fires).crossJoin(F.broadcast(ends)).where("ts <= now")
    return out.select("cache", "key", F.col("ttl_ns").alias("set_seq"), "value", (F.col("ts") - 1).alias("fired_at"))


def with_epoch_by_time(ops: DataFrame, probes: DataFrame) -> DataFrame:
    """Operations and timed probes with the epoch that their time falls in: how many clears have an earlier time. Blocks
    are equal spans of time, as many as SPAN operations fill on average."""
    whole = ops.agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.count(F.lit(1)).alias("n")).first()
    low, width = whole["low"] or 0, max(1, ((whole["high"] or 0) - (whole["low"] or 0) + 1) * SPAN // max(1, whole["n"]))
    both = ops.unionByName(probes).withColumn("_at", F.col("ts") + F.when(F.col("op") == "clear", 1).otherwise(0))
    block = F.floor((F.col("_at") - F.lit(low)) / F.lit(width))
    return epochs(both, "_at", block).where("op <> 'clear'").drop("_at")


def stats(ops: DataFrame, default_ns: int) -> DataFrame:
    """hits, misses, expirations and the hit ratio of each cache (0 without lookups), with its size and cost."""
    g = gets(ops, default_ns)
    counts = g.groupBy("cache").agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_if("expired").alias("expirations")
    )
    held = physical(ops, default_ns).groupBy("cache").agg(F.count(F.lit(1)).alias("size"), F.sum("cost").alias("cost"))
    out = counts.join(held, "cache", "full")
    n = F.coalesce("hits", F.lit(0)) + F.coalesce("misses", F.lit(0))
    names = ("hits", "misses", "expirations", "size", "cost")
    return out.select(
        "cache", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names],
        F.when(n > 0, F.col("hits") / n).otherwise(F.lit(0.0)).alias("hit_ratio"),
    )


def insert_or_update(ops: DataFrame, default_ns: int) -> DataFrame:
    """Each set: whether it updates a resident entry (an expired one that nobody read counts)."""
    return resolved(ops, default_ns).where("op = 'set'").select("seq", "cache", "key", F.col("cur_seq").isNotNull().alias("is_update"))


def deletes(ops: DataFrame, default_ns: int) -> DataFrame:
    """Each delete: whether it removed something resident, expired or not."""
    return resolved(ops, default_ns).where("op = 'delete'").select("seq", "cache", "key", F.col("cur_seq").isNotNull().alias("removed"))
