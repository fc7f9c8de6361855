"""Replay of a trace under a capacity policy: one shuffle by (cache, shard), then each shard's operations in order.

Only time, key, operation, TTL and cost travel; values are joined back by seq where they are wanted. The shard count
belongs to the query: results depend on it, as in the cache itself. A partition's rows come sorted by cache, shard and
seq and are read batch by batch, so a task holds a shard's entries and never its trace. Without ``detail`` hits, misses
and sets are counted where they happen and only the counts come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import CacheConfig, CacheError, InvalidCost, ItemTooLarge, split
from tidemark.functions.hashing import key_hash, shard

from .kernels import Shard, kinds
from .sieve import Cycle

LOG = "cache string, shard int, seq long, event string, key long, n long"
REMOVED = ("capacity", "rejected", "expired", "deleted")
POLICY = ("admits", "rejects", "ghost_hits", "promotions", "probation_evictions", "main_evictions")
FIELDS = ["seq", "ts", "key", "hash", "op", "ttl_ns", "cost"]


Configs = CacheConfig | dict[str, CacheConfig]


def of_cache(config: Configs, cache: str) -> CacheConfig:
    return config[cache] if isinstance(config, dict) else config


def resolved(config: Configs) -> Configs:
    return {name: c.resolved() for name, c in config.items()} if isinstance(config, dict) else config.resolved()


def shards_of(config: Configs) -> Column:
    """Each row's shard count."""
    if not isinstance(config, dict):
        return F.lit(config.shard_count)
    return F.create_map(*[F.lit(x) for name, c in config.items() for x in (name, c.shard_count)])[F.col("cache")]


def sharded(ops: DataFrame, shards: int | Column) -> DataFrame:
    return ops.withColumn("hash", key_hash(F.col("key"), dict(ops.dtypes)["key"])).withColumn("shard", shard(F.col("hash"), shards))


def control_to_all(ops: DataFrame, shards: int | Column) -> DataFrame:
    """Clears and cleanups reach every shard of their cache."""
    shards = F.lit(shards) if isinstance(shards, int) else shards
    own = sharded(ops.where("op NOT IN ('clear', 'cleanup')"), shards)
    wide = ops.where("op IN ('clear', 'cleanup')").withColumn("hash", F.lit(0).cast("long"))
    return own.unionByName(wide.withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1))))


def weighed(ops: DataFrame, weigher: Column, config: CacheConfig, strict: bool = False) -> DataFrame:
    """ops with the weigher's cost on sets (null: 1) and ``refused``: invalid_cost where it is negative, too_large where no
    shard can hold it. With ``strict`` the first such set is an error."""
    config = config.resolved()
    most = max(split(config.max_cost, config.shard_count))
    cost = F.coalesce(weigher.cast("long"), F.lit(1).cast("long"))
    why = F.when(cost < 0, "invalid_cost").when(F.lit(most > 0) & (cost > most), "too_large")
    out = ops.withColumns({"cost": cost, "refused": F.when(F.col("op").isin("set", "access"), why)})
    if strict and (bad := out.where("refused IS NOT NULL").select("key", "cost", "refused").first()):
        cause = InvalidCost(bad["cost"]) if bad["refused"] == "invalid_cost" else ItemTooLarge(bad["cost"])
        raise CacheError("set", bad["key"], cause)
    return out


def apply(s: Shard, row) -> None:
    """One operation on a shard, after the sweep that is due: time is cut into intervals of the configured length, and the
    first operation of a later one that reaches a shard finds it swept as of that interval's start."""
    seq, ts, key, h, op, ttl, cost = row
    s.seq = seq
    every = s.config.cleanup_interval_ns
    if every and ts // every > s.interval:
        s.interval = ts // every
        s.cleanup(s.interval * every)
    if op in ("get", "access"):
        if not s.get(key, ts) and op == "access":
            s.set(key, h, cost, deadline(s, ts, ttl))
    elif op == "set":
        s.set(key, h, cost, deadline(s, ts, ttl))
    elif op == "delete":
        s.delete(key)
    elif op == "exists":
        s.exists(key, ts)
    elif op == "clear":
        s.clear()
    elif op == "cleanup":
        s.cleanup(ts)


def deadline(s: Shard, ts: int, ttl) -> int:
    ttl = s.config.default_ttl_ns if ttl == 0 else ttl
    return ts + ttl if ttl > 0 else 0


def new_shard(config: CacheConfig, number: int, detail: bool = True) -> Shard:
    sizes, costs = split(config.max_size, config.shard_count), split(config.max_cost, config.shard_count)
    return kinds()[config.policy](config, sizes[number], costs[number], detail)


def trace_of(ops: DataFrame, config: Configs) -> DataFrame:
    """What the shards read; a null TTL means none, a null cost is 1. With a configuration for each cache, operations on
    other caches are left out."""
    if isinstance(config, dict):
        ops = ops.where(F.col("cache").isin(*config))
    ops = control_to_all(ops, shards_of(config))
    own = {"ttl_ns": F.coalesce("ttl_ns", F.lit(-1).cast("long")), "cost": F.coalesce("cost", F.lit(1).cast("long"))}
    return ops.select("cache", "shard", *[own.get(c, F.col(c)).alias(c) for c in FIELDS])


def in_order(rows: DataFrame, schema: str, start: Callable, step: Callable, drain: Callable, end: Callable) -> DataFrame:
    """rows (cache, shard, seq, ...) -> what a state of each shard says, in one pass over its rows by seq.

    start(cache, shard) makes a state; step(state, row) takes one row without its cache and shard; drain(state) hands
    over, after each batch, the tuples that the state has gathered; end(state) gives the last ones. cache and shard are
    put in front of every tuple.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    kinds_of = rows.sparkSession.createDataFrame([], schema).schema
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds_of)

        def made(tuples):
            cols = zip(*tuples, strict=True) if tuples else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        now = state = None
        for batch in batches:
            out = []
            for cache, number, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cache, number) != now:
                    if now is not None:
                        out += [(*now, *x) for x in (*drain(state), *end(state))]
                    now, state = (cache, number), start(cache, number)
                step(state, row)
            if now is not None:
                out += [(*now, *x) for x in drain(state)]
            yield made(out)
        if now is not None:
            yield made([(*now, *x) for x in end(state)])

    return rows.repartition(parts, "cache", "shard").sortWithinPartitions("cache", "shard", "seq").mapInArrow(run, schema)


def drained(s: Shard) -> list[tuple]:
    log, s.log = s.log, []
    return log


def replay(ops: DataFrame, config: Configs, detail: bool = True) -> DataFrame:
    """The log of all shards: cache, shard, seq, event, key, n, under one configuration or one for each cache. At a shard's end it has its size, its cost and its policy's
    counters, and without ``detail`` the counts of all events in place of the events."""
    config = resolved(config)
    rows = trace_of(ops, config)

    def end(s: Shard) -> list[tuple]:
        return [(s.seq, name, 0, n) for name, n in s.totals_now().items()]

    return in_order(rows, LOG, lambda cache, number: new_shard(of_cache(config, cache), number, detail), apply, drained, end)


def cycles(ops: DataFrame, config: Configs) -> DataFrame:
    """Signals of each adaptive cycle of the sieve policy."""
    config = config.resolved()
    names = ["seq", *Cycle.FIELDS, "probation_cap", "by_frequency"]
    schema = "cache string, shard int, cycle long, " + ", ".join(f"{n} long" for n in names)
    rows = trace_of(ops, config)

    def end(s: Shard) -> list[tuple]:
        return [(k, *c) for k, c in enumerate(s.cycles)]

    out = in_order(rows, schema, lambda cache, number: new_shard(of_cache(config, cache), number, False), apply, lambda s: [], end)
    rate = F.when(F.col("main_evictions") > 0, F.col("returns") / F.col("main_evictions")).otherwise(F.lit(0.0))
    return out.withColumn("churn", F.col("evictions") + F.col("rejects")).withColumn("resurrection", rate)


def summary(log: DataFrame) -> DataFrame:
    """hits, misses, evictions, expirations, size, cost and hit ratio of each cache."""
    def total(event: str, name: str):
        return F.coalesce(F.sum(F.when(F.col("event") == event, F.col("n"))), F.lit(0)).alias(name)

    names = {"hit": "hits", "miss": "misses", "capacity": "evictions", "expired": "expirations", "size": "size", "cost": "cost"}
    out = log.groupBy("cache").agg(*[total(event, name) for event, name in names.items()])
    looked = F.col("hits") + F.col("misses")
    return out.withColumn("hit_ratio", F.when(looked > 0, F.col("hits") / looked).otherwise(F.lit(0.0)))


def stats(log: DataFrame, config: Configs) -> DataFrame:
    """The summary as a cache reports it: events are counted only where its configuration asks for statistics; size and
    cost always are."""
    out = summary(log)
    if not isinstance(config, dict):
        on = F.lit(config.stats_enabled)
    else:
        on = F.col("cache").isin(*[name for name, c in config.items() if c.stats_enabled])
    events = ("hits", "misses", "evictions", "expirations", "hit_ratio")
    return out.withColumns({c: F.when(on, F.col(c)).otherwise(F.lit(0).cast(out.schema[c].dataType)) for c in events})


def removals(log: DataFrame) -> DataFrame:
    return log.where(F.col("event").isin(*REMOVED)).select("seq", "cache", "key", F.col("event").alias("reason"))


def policy_stats(log: DataFrame) -> DataFrame:
    return log.where(F.col("event").isin(*POLICY)).groupBy("cache").agg(*[F.sum(F.when(F.col("event") == c, F.col("n"))).alias(c) for c in POLICY])
