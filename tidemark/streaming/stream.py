"""Streaming forms of state and replay on Structured Streaming.

``latest`` keeps each key's entry with its deadline in the state store, in step with the operations by seq: sets, deletes,
clears and reads (a read removes what it sees expired), and a timer that sweeps what nobody read, at the end of the
cleanup interval that the deadline falls in. ``replay_stream`` keeps a shard's kernel as state and logs what each
micro-batch does to it; the concatenated log is the batch replay's, as long as seq grows from batch to batch. ``sink``
hands removals to a callback once a batch. ``StreamCache`` starts, syncs and closes such a query.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.config import CacheClosed, CacheConfig
from tidemark.operators import replay
from tidemark.operators.state import deadline

ENTRY = "seq long, value double, deadline long, cost long"
CHANGE = "cache string, key long, seq long, event string, value double, deadline long"
NS = 1_000_000  # nanoseconds of a millisecond


class Latest(StatefulProcessor):
    """Last writer wins by seq; timers are in event time, in whole milliseconds after the deadline."""

    def __init__(self, every_ns: int):
        self.every_ns = every_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", ENTRY)

    def due(self, at: int) -> int:
        """When a sweep removes an entry of that deadline: after the end of its cleanup interval."""
        step = max(self.every_ns, 1)
        return -(-(at + 1) // step) * step // NS + 1

    def one(self, key, r) -> tuple | None:
        """An operation, and the change that it makes."""
        held = self.entry.get() if self.entry.exists() else None
        if r.op == "set":
            if held and held[0] > r.seq:
                return None
            self.entry.update((int(r.seq), float(r.value), int(r.deadline), int(r.cost)))
            if r.deadline > 0:
                self.handle.registerTimer(self.due(int(r.deadline)))
            return (*key, r.seq, "set", r.value, r.deadline)
        if not held or held[0] > r.seq:
            return None
        if r.op == "get":
            if not 0 < held[2] < r.ts:
                return None
            self.entry.clear()
            return (*key, held[0], "expired", held[1], held[2])
        self.entry.clear()
        return (*key, r.seq, "deleted", None, 0) if r.op == "delete" else None  # a clear tells nobody

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        pdf = pd.concat(list(rows)).sort_values("seq")
        found = [self.one(key, r) for r in pdf.itertuples(index=False)]
        yield pd.DataFrame([x for x in found if x], columns=["cache", "key", "seq", "event", "value", "deadline"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        out = []
        if self.entry.exists():
            seq, value, at, _ = self.entry.get()
            if 0 < at and self.due(at) <= expiredTimerInfo.getExpiryTimeInMs():
                self.entry.clear()
                out.append((*key, seq, "expired", value, at))
        yield pd.DataFrame(out, columns=["cache", "key", "seq", "event", "value", "deadline"])


def latest(ops: DataFrame, default_ns: int, delay: str = "0 seconds", every_ns: int = NS, keys: DataFrame | None = None) -> DataFrame:
    """A stream of operations -> a stream of changes. A clear has no key of its own: with ``keys``, a static table (cache,
    key) of the keys that a stream may hold, it reaches each of its cache's; without, a trace must not hold any."""
    rows = ops.where("op IN ('set', 'delete', 'get')")
    if keys is None:
        rows = rows.unionByName(ops.where("op = 'clear'").where(F.raise_error(F.lit("a clear needs the keys it reaches")).isNotNull()))
    else:
        wide = ops.where("op = 'clear'").drop("key").join(keys.select("cache", "key").distinct(), "cache")
        rows = rows.unionByName(wide.select(*rows.columns))
    rows = rows.select(
        "cache", "key", "seq", "ts", "op", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("cost", F.lit(1)).alias("cost"),
        deadline(F.col("ts"), F.col("ttl_ns"), default_ns).alias("deadline"), F.timestamp_micros(F.floor(F.col("ts") / 1000)).alias("at"),
    )
    rows = rows.withColumn("deadline", F.coalesce("deadline", F.lit(0)))
    return rows.withWatermark("at", delay).groupBy("cache", "key").transformWithStateInPandas(Latest(every_ns), CHANGE, "append", "eventTime")


def shard_updates(config: CacheConfig) -> Callable:
    config = config.resolved()

    def run(key, frames, state):
        import pandas as pd

        s = pickle.loads(state.get[0]) if state.exists else replay.new_shard(config, int(key[1]))
        pdf = pd.concat(list(frames)).sort_values("seq", ignore_index=True)
        for row in pdf[replay.FIELDS].itertuples(index=False, name=None):
            replay.apply(s, row)
        log, s.log = s.log, []
        state.update((pickle.dumps(s),))
        yield pd.DataFrame(log, columns=["seq", "event", "key", "n"]).astype({"seq": "int64", "key": "int64", "n": "int64"}).assign(cache=key[0], shard=key[1])[["cache", "shard", "seq", "event", "key", "n"]]

    return run


def replay_stream(ops: DataFrame, config: CacheConfig) -> DataFrame:
    """A stream of operations -> the stream of the replay's log; one state a shard."""
    rows = replay.trace_of(ops, config.resolved())
    return rows.groupBy("cache", "shard").applyInPandasWithState(shard_updates(config), replay.LOG, "kernel binary", "append", "NoTimeout")


def sink(log: DataFrame, on_remove: Callable[[DataFrame, int], None], on_evict: Callable[[DataFrame, int], None] | None = None):
    """Start a query that hands each micro-batch's removals (and capacity removals) to callbacks."""

    def batch(df: DataFrame, epoch: int) -> None:
        gone = replay.removals(df)
        on_remove(gone, epoch)
        if on_evict:
            on_evict(gone.where("reason = 'capacity'"), epoch)

    return log.writeStream.foreachBatch(batch).outputMode("append")


class StreamCache:
    """A running replay with the life of a cache: writes are appended to its source, ``sync`` waits until all of them have
    taken effect, ``close`` flushes and stops; closing again does nothing, and a write or sync after it is an error."""

    def __init__(self, ops: DataFrame, config: CacheConfig, write: Callable[[DataFrame], None], on_remove: Callable, on_evict: Callable | None = None, checkpoint: str | None = None):
        """ops: the stream of what ``write`` appends."""
        self.append = write
        writer = sink(replay_stream(ops, config), on_remove, on_evict)
        self.query: StreamingQuery | None = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()

    def _open(self) -> StreamingQuery:
        if self.query is None:
            raise CacheClosed("closed")
        return self.query

    def write(self, ops: DataFrame) -> None:
        self._open()
        self.append(ops)

    def sync(self) -> None:
        self._open().processAllAvailable()

    def close(self) -> None:
        if self.query is not None:
            self.query.processAllAvailable()
            self.query.stop()
            self.query = None
