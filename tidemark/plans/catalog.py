"""All registered cache-trace queries and, where SQL can express them, the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import CacheConfig, shard_count, split
from tidemark.functions import hashing, http
from tidemark.operators import lru, replay, sketch, state
from tidemark.plans import http_cache
from tidemark.sources import traces

Query = Callable[[SparkSession, str], DataFrame]
TTL = traces.DEFAULT_TTL_NS
CAPACITIES = [5, 10, 25, 50, 75, 100, 150, 500]
SHARDS = 4
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# The event trace in SQL: operations, the epoch of each, the entry before each, and the entries at the end.
OPS = f"""
WITH ops AS (
  SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts, 'c' || (user_id % 3) AS cache, user_id AS key,
         CASE WHEN event_id % {traces.CLEAR_EVERY} = 0 THEN 'clear' WHEN event_type IN ('view', 'click') THEN 'get'
              WHEN event_type IN ('purchase', 'signup') THEN 'set' ELSE 'delete' END AS op,
         value, CASE event_type WHEN 'purchase' THEN 24 * 3600 * 1000000000::BIGINT WHEN 'signup' THEN 0::BIGINT END AS ttl_ns,
         1 + event_id % 7 AS cost
  FROM events
), staged AS (
  SELECT *, sum(CASE WHEN op = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY cache ORDER BY seq) AS epoch,
         ts + CASE WHEN ttl_ns = 0 THEN {TTL} ELSE ttl_ns END AS deadline FROM ops
), muts AS (
  SELECT *, coalesce((SELECT min(m.seq) FROM staged m WHERE m.cache = s.cache AND m.key = s.key AND m.epoch = s.epoch
                      AND m.op IN ('set', 'delete') AND m.seq > s.seq), 9223372036854775807) AS until
  FROM staged s WHERE op = 'set'
), spans AS (
  SELECT m.*, coalesce((SELECT min(g.seq) FROM staged g WHERE g.op = 'get' AND g.cache = m.cache AND g.key = m.key
                        AND g.epoch = m.epoch AND g.seq > m.seq AND g.seq < m.until AND g.ts > m.deadline),
                       9223372036854775807) AS seen
  FROM muts m
), res AS (
  SELECT o.*, s.seq AS cur_seq, s.value AS cur_value, s.deadline AS cur_deadline, s.cost AS cur_cost
  FROM staged o LEFT JOIN spans s ON s.cache = o.cache AND s.key = o.key AND s.epoch = o.epoch AND s.seq < o.seq
       AND o.seq <= s.until AND o.seq <= s.seen
  WHERE o.op <> 'clear'
), phys AS (
  SELECT s.cache, s.key, s.seq AS set_seq, s.value, s.deadline, s.cost FROM spans s
  WHERE s.until = 9223372036854775807 AND s.seen = 9223372036854775807
    AND s.epoch = (SELECT max(epoch) FROM staged t WHERE t.cache = s.cache)
), fin AS (SELECT max(ts) AS now FROM ops)
"""


@query(OPS + "SELECT * FROM phys")
def state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set/SetAsync/Get: the last writer's entry of every key that is resident at the end."""
    return state.physical(traces.events(spark, sf_dir), TTL)


@query(OPS + """SELECT seq, cache, key, (cur_seq IS NOT NULL AND ts <= cur_deadline) AS hit,
CASE WHEN cur_seq IS NOT NULL AND ts <= cur_deadline THEN cur_value END AS value FROM res WHERE op = 'get'""")
def get_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Get as of each read."""
    return state.gets(traces.events(spark, sf_dir), TTL).select("seq", "cache", "key", "hit", "value")


@query(OPS + """SELECT seq, cache, key, cur_deadline - ts AS ttl_ns
FROM res WHERE op = 'get' AND cur_seq IS NOT NULL AND ts <= cur_deadline""")
def get_with_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Get with the time that is left; misses give no row."""
    return state.gets(traces.events(spark, sf_dir), TTL).where("hit").select("seq", "cache", "key", "ttl_ns")


@query(OPS + "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT key FROM phys, fin WHERE now <= deadline)")
def exists_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exists for many keys: the customers whose id is live."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    keys = state.live(traces.events(spark, sf_dir), TTL)
    return c.join(keys, c["c_custkey"] == keys["key"], "left_semi")


@query(OPS + "SELECT cache, key FROM phys, fin WHERE now <= deadline")
def keys_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.live(traces.events(spark, sf_dir), TTL).select("cache", "key")


@query(OPS + "SELECT cache, count(*) AS size FROM phys GROUP BY cache")
def size_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size includes what is expired and not swept."""
    return state.physical(traces.events(spark, sf_dir), TTL).groupBy("cache").agg(F.count(F.lit(1)).alias("size"))


@query(OPS + "SELECT cache, sum(cost)::BIGINT AS cost FROM phys GROUP BY cache")
def cost_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.physical(traces.events(spark, sf_dir), TTL).groupBy("cache").agg(F.sum("cost").alias("cost"))


@query(OPS + "SELECT seq, cache, key, cur_seq IS NOT NULL AS removed FROM res WHERE op = 'delete'")
def delete_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.deletes(traces.events(spark, sf_dir), TTL)


@query(OPS + "SELECT seq, cache, key, epoch::INTEGER AS epoch FROM staged WHERE op <> 'clear'")
def clear_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear: how many clears of its cache precede each operation."""
    return state.with_epoch(traces.events(spark, sf_dir)).where("op <> 'clear'").select("seq", "cache", "key", "epoch")


@query(OPS + "SELECT seq, cache, key, cur_seq IS NOT NULL AS is_update FROM res WHERE op = 'set'")
def insert_vs_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.insert_or_update(traces.events(spark, sf_dir), TTL)


@query(OPS + "SELECT cache, key, 'expired' AS reason FROM phys, fin WHERE now > deadline")
def expired_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleanup at the end of the trace."""
    return state.sweep(traces.events(spark, sf_dir), TTL)


@query(OPS + """, fire AS (
  SELECT s.cache, s.key, s.seq AS set_seq, s.value, s.deadline AS fired_at FROM spans s, fin WHERE s.deadline + 1 <= now
)
SELECT f.* FROM fire f WHERE EXISTS (
  SELECT 1 FROM spans r WHERE r.cache = f.cache AND r.key = f.key AND r.ts < f.fired_at + 1 AND r.deadline < f.fired_at + 1
    AND NOT EXISTS (SELECT 1 FROM staged x WHERE x.cache = r.cache AND x.seq > r.seq AND x.ts <= f.fired_at + 1
                    AND ((x.op = 'clear' AND x.ts < f.fired_at + 1) OR (x.key = r.key AND x.op IN ('set', 'delete'))
                         OR (x.key = r.key AND x.op = 'get' AND x.ts > r.deadline))))""")
def ttl_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SetWithCallback: what fires, and with which value."""
    return state.callbacks(traces.events(spark, sf_dir), TTL)


@query("""SELECT count(*) AS lookups, count(*) - count(DISTINCT user_id) AS hits,
(count(*) - count(DISTINCT user_id)) / count(*)::DOUBLE AS hit_ratio FROM events""")
def hit_ratio_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read-through replay without a limit: all but the first access to a key hit."""
    per_key = traces.event_accesses(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    out = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lookups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("hits"))
    return out.withColumn("hit_ratio", F.when(F.col("lookups") > 0, F.col("hits") / F.col("lookups")).otherwise(F.lit(0.0)))


@query(OPS + """, g AS (SELECT cache, count(*) FILTER (WHERE cur_seq IS NOT NULL AND ts <= cur_deadline) AS hits,
  count(*) FILTER (WHERE cur_seq IS NULL OR ts > cur_deadline) AS misses,
  count(*) FILTER (WHERE cur_seq IS NOT NULL AND ts > cur_deadline) AS expirations FROM res WHERE op = 'get' GROUP BY cache),
p AS (SELECT cache, count(*) AS size, sum(cost)::BIGINT AS cost FROM phys GROUP BY cache)
SELECT coalesce(g.cache, p.cache) AS cache, coalesce(hits, 0) AS hits, coalesce(misses, 0) AS misses,
  coalesce(expirations, 0) AS expirations, coalesce(size, 0) AS size, coalesce(cost, 0) AS cost,
  CASE WHEN hits + misses > 0 THEN hits / (hits + misses)::DOUBLE ELSE 0 END AS hit_ratio
FROM g FULL JOIN p ON g.cache = p.cache""")
def stats_by_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stats of each cache; all of them are the manager's view."""
    return state.stats(traces.events(spark, sf_dir), TTL)


def avalanche_sql(key: str) -> str:
    """The finalizer over unsigned 128-bit products."""
    x, parts = f"({key})::UBIGINT", []
    for k, (shift, factor) in enumerate(zip(hashing.SHIFTS, (*hashing.MULTIPLIERS, 1), strict=True)):
        parts.append(f"a{k} AS (SELECT key, ((xor(h, h >> {shift}))::UHUGEINT * {factor}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM {'base' if not k else f'a{k - 1}'})")
    return f"base AS (SELECT DISTINCT {key} AS key, {x} AS h FROM events), " + ", ".join(parts)


SIGNED = "CASE WHEN h >= 9223372036854775808 THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END"


@query(f"WITH {avalanche_sql('user_id')} SELECT key, {SIGNED} AS hash, (h % {SHARDS})::INTEGER AS shard FROM a2")
def avalanche_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = traces.event_accesses(spark, sf_dir).select("key").distinct().withColumn("hash", hashing.avalanche(F.col("key")))
    return keys.withColumn("shard", hashing.shard(F.col("hash"), SHARDS))


@query(f"WITH {avalanche_sql('user_id')} SELECT (h % {SHARDS})::INTEGER AS shard, count(DISTINCT key) AS keys, count(*) AS accesses FROM events JOIN a2 ON key = user_id GROUP BY 1")
def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and accesses of each shard: keys are summed up before they are dealt to shards."""
    n = traces.event_accesses(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(hashing.shard(hashing.avalanche(F.col("key")), SHARDS).alias("shard")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("accesses"))


@query("""SELECT n AS shards, i AS shard, (1000 // n + CASE WHEN i < 1000 % n THEN 1 ELSE 0 END)::BIGINT AS capacity
FROM (SELECT unnest([1, 2, 4, 8, 16, 32]) AS n) t, LATERAL (SELECT unnest(range(n)) AS i)""")
def capacity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = [shard_count(k, 1000, 0, 8) for k in (1, 2, 4, 8, 16, 32)]
    return spark.createDataFrame([(s, i, c) for s in n for i, c in enumerate(split(1000, s))], "shards int, shard long, capacity long")


@query(f"""WITH a AS (SELECT event_id AS seq, user_id AS key, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT a.seq, count(b.seq) AS distance FROM a LEFT JOIN a b ON b.seq > a.before AND b.seq < a.seq
  AND (b.after IS NULL OR b.after > a.seq) WHERE a.before IS NOT NULL GROUP BY a.seq)
SELECT c AS capacity, (SELECT count(*) FROM d WHERE distance < c) AS hits, (SELECT count(*) FROM events) AS lookups,
  (SELECT count(*) FROM d WHERE distance < c) / (SELECT count(*) FROM events)::DOUBLE AS hit_ratio
FROM (SELECT unnest({CAPACITIES})::BIGINT AS c)""")
def lru_hit_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit ratio of LRU at many capacities from one pass, a single shard."""
    trace = traces.event_accesses(spark, sf_dir).withColumn("shard", F.lit(0))
    return lru.hit_curve(trace, CAPACITIES)


def chained(expression: str, names: str, table: str, extra: str = "") -> str:
    """CTEs of the finalizer over an unsigned column: ``names``0 to ``names``2, each with the columns of table and h."""
    parts, before = [f"{names} AS (SELECT *, {expression} AS h FROM {table})"], names
    for k, (shift, factor) in enumerate(zip(hashing.SHIFTS, (*hashing.MULTIPLIERS, 1), strict=True)):
        parts.append(f"{names}{k} AS (SELECT * EXCLUDE h, ((xor(h, h >> {shift}))::UHUGEINT * {factor}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM {before})")
        before = f"{names}{k}"
    return ", ".join(parts)


LIMIT, BUDGET = 64, 200
ENTRY = "STRUCT(u BIGINT, b BIGINT, k BIGINT, c BIGINT, d BIGINT)[]"  # uses, birth or 0, key, cost, deadline
FOUND_ENTRY = "list_filter(held, lambda x: x.k = o.k)"
OTHERS = "list_filter(held, lambda x: x.k <> o.k)"


def evicted(limit: int, budget: int, of: str = "held") -> str:
    """How many entries go from the front before one of cost o.c fits."""
    fits = [f"len({of}) - j + 1 <= {limit}"] if limit else []
    fits += [f"coalesce(list_sum(list_transform({of}[j + 1:], lambda x: x.c)), 0) + o.c <= {budget}"] if budget else []
    return f"list_min(list_filter(range(0, len({of}) + 1), lambda j: {' AND '.join(fits)}))"


def read_through_sql(on_hit: str, new: str, limit: int, budget: int = 0) -> str:
    """A read-through replay, operation by operation: the entries of each shard as a list in the order in which they go."""
    out = evicted(limit, budget)
    return f"""WITH RECURSIVE keys AS (SELECT DISTINCT user_id AS k FROM events), {chained("k::UBIGINT", "a", "keys")}, o AS (
  SELECT (h % {SHARDS})::INTEGER AS shard, k, 1 + event_id % 7 AS c, row_number() OVER (PARTITION BY h % {SHARDS} ORDER BY event_id) AS n
  FROM events JOIN a2 ON user_id = k
), sim AS (
  SELECT DISTINCT shard, 0::BIGINT AS n, []::{ENTRY} AS held, 0::BIGINT AS hits, 0::BIGINT AS misses, 0::BIGINT AS evictions FROM o
  UNION ALL
  SELECT shard, n, CASE WHEN hit THEN {on_hit} ELSE {new} END, hits + hit::BIGINT, misses + (NOT hit)::BIGINT, evictions + CASE WHEN hit THEN 0 ELSE j END
  FROM (SELECT s.shard, o.n, held, hits, misses, evictions, len({FOUND_ENTRY}) > 0 AS hit, {out} AS j, o FROM sim s JOIN o ON o.shard = s.shard AND o.n = s.n + 1)
), fin AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY shard ORDER BY n DESC) = 1)
SELECT 'all' AS cache, sum(hits)::BIGINT AS hits, sum(misses)::BIGINT AS misses, sum(evictions)::BIGINT AS evictions, 0::BIGINT AS expirations,
  sum(len(held))::BIGINT AS size, sum(list_sum(list_transform(held, lambda x: x.c)))::BIGINT AS cost, sum(hits) / sum(hits + misses)::DOUBLE AS hit_ratio FROM fin"""


FRESH = "[struct_pack(u := 1::BIGINT, b := o.n, k := o.k, c := o.c, d := 0::BIGINT)]"
LRU_HIT, LAST = f"list_concat({OTHERS}, {FOUND_ENTRY})", f"list_concat(held[j + 1:], {FRESH})"
LFU_HIT = "list_sort(list_transform(held, lambda x: struct_pack(u := x.u + (x.k = o.k)::BIGINT, b := x.b, k := x.k, c := x.c, d := x.d)))"


def _replay(spark: SparkSession, sf_dir: str, policy: str, detail: bool = False, **more) -> DataFrame:
    config = CacheConfig(policy=policy, shard_count=SHARDS, max_size=more.pop("max_size", LIMIT), **more)
    return replay.replay(traces.event_accesses(spark, sf_dir), config, detail)


@query(read_through_sql(LRU_HIT, LAST, LIMIT // SHARDS))
def lru_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.summary(_replay(spark, sf_dir, "lru"))


@query(read_through_sql("held", LAST, LIMIT // SHARDS))
def fifo_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.summary(_replay(spark, sf_dir, "fifo"))


@query(read_through_sql(LFU_HIT, f"list_sort({LAST})", LIMIT // SHARDS))
def lfu_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.summary(_replay(spark, sf_dir, "lfu"))


@query()
def sieve_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.summary(_replay(spark, sf_dir, "sieve"))


@query()
def sieve_cost_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sieve with a cost budget and density admission."""
    return replay.summary(_replay(spark, sf_dir, "sieve", max_cost=BUDGET, cost_admission="density"))


@query(read_through_sql(LRU_HIT, LAST, 0, BUDGET // SHARDS))
def weighted_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.summary(_replay(spark, sf_dir, "lru", max_size=0, max_cost=BUDGET))


OPS_SHARDS, OPS_LIMIT, SWEEP_NS = 2, 20, 6 * 3600 * 10**9
# Every operation of the event trace under LRU with TTL: a shard is swept as of the interval's start that an operation is in.
OPS_SIM = OPS.replace("WITH ops AS", "WITH RECURSIVE ops AS") + f""", keys AS (SELECT DISTINCT key AS k FROM ops), {chained("k::UBIGINT", "a", "keys")}, dealt AS (
  SELECT seq, ts, cache, op, key AS k, cost AS c, CASE WHEN ttl_ns = 0 THEN ts + {TTL} WHEN ttl_ns > 0 THEN ts + ttl_ns ELSE 0 END AS d, (h % {OPS_SHARDS})::INTEGER AS shard
  FROM ops JOIN a2 ON key = k WHERE op <> 'clear'
  UNION ALL SELECT seq, ts, cache, op, key, cost, 0, unnest(range({OPS_SHARDS}))::INTEGER FROM ops WHERE op = 'clear'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY cache, shard ORDER BY seq) AS n, coalesce(lag(ts) OVER (PARTITION BY cache, shard ORDER BY seq), 0) // {SWEEP_NS} < ts // {SWEEP_NS} AS sweep,
    ts // {SWEEP_NS} * {SWEEP_NS} AS tick FROM dealt
), sim AS (
  SELECT DISTINCT cache, shard, 0::BIGINT AS n, []::{ENTRY} AS held, 0::BIGINT AS hits, 0::BIGINT AS misses, 0::BIGINT AS capacity, 0::BIGINT AS expired, 0::BIGINT AS deleted FROM o
  UNION ALL
  SELECT cache, shard, n,
    CASE WHEN o.op = 'clear' THEN []::{ENTRY} WHEN o.op = 'delete' OR (o.op = 'get' AND dead) THEN {OTHERS} WHEN o.op = 'get' THEN {LRU_HIT}
      WHEN here THEN list_concat({OTHERS}, {FRESH.replace("0::BIGINT", "o.d")}) ELSE list_concat(held[j + 1:], {FRESH.replace("0::BIGINT", "o.d")}) END,
    hits + (o.op = 'get' AND here AND NOT dead)::BIGINT, misses + (o.op = 'get' AND (NOT here OR dead))::BIGINT, capacity + CASE WHEN o.op = 'set' AND NOT here THEN j ELSE 0 END,
    expired + swept + (o.op = 'get' AND dead)::BIGINT, deleted + (o.op = 'delete' AND here)::BIGINT
  FROM (
    SELECT *, len({FOUND_ENTRY}) > 0 AS here, len(list_filter(held, lambda x: x.k = o.k AND x.d > 0 AND x.d < o.ts)) > 0 AS dead, {evicted(OPS_LIMIT // OPS_SHARDS, 0)} AS j
    FROM (SELECT s.cache, s.shard, o.n, CASE WHEN o.sweep THEN list_filter(s.held, lambda x: NOT (x.d > 0 AND x.d < o.tick)) ELSE s.held END AS held,
            CASE WHEN o.sweep THEN len(list_filter(s.held, lambda x: x.d > 0 AND x.d < o.tick)) ELSE 0 END AS swept, hits, misses, capacity, expired, deleted, o
          FROM sim s JOIN o ON o.cache = s.cache AND o.shard = s.shard AND o.n = s.n + 1))
), fin_ops AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY cache, shard ORDER BY n DESC) = 1)
"""


def _ops_replay(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    config = CacheConfig(policy=policy, shard_count=OPS_SHARDS, max_size=OPS_LIMIT, default_ttl_ns=TTL, cleanup_interval_ns=SWEEP_NS)
    return replay.replay(traces.events(spark, sf_dir), config)


@query(OPS_SIM + """SELECT cache, sum(hits)::BIGINT AS hits, sum(misses)::BIGINT AS misses, sum(capacity)::BIGINT AS evictions, sum(expired)::BIGINT AS expirations,
  sum(len(held))::BIGINT AS size, coalesce(sum(list_sum(list_transform(held, lambda x: x.c))), 0)::BIGINT AS cost,
  CASE WHEN sum(hits + misses) > 0 THEN sum(hits) / sum(hits + misses)::DOUBLE ELSE 0 END AS hit_ratio FROM fin_ops GROUP BY cache""")
def ops_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operations (get, set, delete, clear) with TTL and periodic sweeps under LRU, by cache."""
    return replay.summary(_ops_replay(spark, sf_dir, "lru"))


@query(OPS_SIM + """SELECT cache, reason, sum(n)::BIGINT AS n FROM (SELECT cache, unnest(['capacity', 'expired', 'deleted']) AS reason,
  unnest([capacity, expired, deleted]) AS n FROM fin_ops) GROUP BY cache, reason HAVING sum(n) > 0""")
def lru_removals_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OnRemove / OnEvict under LRU: removals counted by reason."""
    out = replay.removals(_ops_replay(spark, sf_dir, "lru"))
    return out.groupBy("cache", "reason").agg(F.count(F.lit(1)).alias("n"))


@query()
def removals_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OnRemove / OnEvict under the sieve: removals counted by reason."""
    out = replay.removals(_ops_replay(spark, sf_dir, "sieve"))
    return out.groupBy("cache", "reason").agg(F.count(F.lit(1)).alias("n"))


@query()
def policy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.policy_stats(_replay(spark, sf_dir, "sieve"))


@query()
def cycle_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.cycles(traces.event_accesses(spark, sf_dir), CacheConfig(policy="sieve", shard_count=SHARDS, max_size=LIMIT))


@query("""SELECT event_id, least((event_id % 16)::HUGEINT * (1 + user_id % 100), 18446744073709551615::HUGEINT)::VARCHAR AS density,
((event_id % 16)::HUGEINT * floor(sqrt(1 + user_id % 100))::BIGINT)::VARCHAR AS balanced FROM events""")
def cost_admission_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar form of the cost-aware score: frequency event_id % 16 against a rival of cost 1 + user_id % 100."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    frequency, cost = F.col("event_id") % 16, F.lit(1) + F.col("user_id") % 100
    root = F.floor(F.sqrt(cost)).cast("long")
    root = F.when(root * root > cost, root - 1).when((root + 1) * (root + 1) <= cost, root + 1).otherwise(root)
    most = F.lit(str((1 << 64) - 1)).cast("decimal(38,0)")

    def product(a, b):
        return F.least((a.cast("decimal(18,0)") * b.cast("decimal(19,0)")).cast("decimal(38,0)"), most).cast("string")

    return e.select("event_id", product(frequency, cost).alias("density"), product(frequency, root).alias("balanced"))


COUNTERS = 4096
# Keys, their hashes, the hashes avalanched once more, and of each access whether the first-touch filter knew its key.
TOUCHED = f"""WITH RECURSIVE keys AS (SELECT DISTINCT user_id AS k FROM events), {chained("k::UBIGINT", "a", "keys")}, named AS (SELECT k, (h % {SHARDS})::INTEGER AS shard, h AS av FROM a2),
{chained("av", "b", "named")}, t AS (
  SELECT event_id AS seq, k, shard, h, (h % {COUNTERS})::INTEGER AS i, ((h >> 32) % {COUNTERS})::INTEGER AS j FROM events JOIN b2 ON user_id = k
), since AS (SELECT shard, p, min(seq) AS s FROM (SELECT shard, seq, unnest([i, j]) AS p FROM t) GROUP BY shard, p),
touched AS (
  SELECT t.*, x.s < t.seq AND y.s < t.seq AS known FROM t JOIN since x ON x.shard = t.shard AND x.p = i JOIN since y ON y.shard = t.shard AND y.p = j
)
"""
PLACES = "[" + ", ".join(f"((h % {COUNTERS // sketch.BLOCK}) * {sketch.BLOCK} + (h >> {p}) % {sketch.BLOCK})::INTEGER" for p in sketch.PROBES) + "]"


@query(TOUCHED + f""", adds AS (
  SELECT shard, {PLACES} AS spots, row_number() OVER (PARTITION BY shard ORDER BY seq) AS n FROM touched WHERE known
), sim AS (
  SELECT DISTINCT shard, 0::BIGINT AS n, list_transform(range({COUNTERS}), lambda x: 0::UTINYINT) AS cells FROM touched
  UNION ALL
  SELECT s.shard, a.n, CASE WHEN list_min([cells[p + 1] FOR p IN spots]) < {sketch.MOST}
    THEN list_transform(cells, lambda x, i: least({sketch.MOST}, x + len(list_filter(spots, lambda p: p = i - 1)))::UTINYINT) ELSE cells END
  FROM sim s JOIN adds a ON a.shard = s.shard AND a.n = s.n + 1
), fin AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY shard ORDER BY n DESC) = 1)
SELECT DISTINCT shard, k AS key, least({sketch.MOST}, list_min([cells[p + 1] FOR p IN {PLACES}]) + 1)::INTEGER AS estimate FROM touched JOIN fin USING (shard)""")
def sketch_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aging count-min estimates (with the first-touch bit) of every key after the whole trace, by shard."""
    class Shard:
        def __init__(self):
            self.sketch, self.door, self.keys = sketch.Sketch(COUNTERS), sketch.Doorkeeper(COUNTERS), {}

        def see(self, row) -> None:
            _, key, h = row
            self.keys[key] = av = hashing.avalanche_int(h)
            if self.door.add(av):
                self.sketch.add(av)
            self.sketch.samples += 1
            if self.sketch.samples >= self.sketch.reset_at:
                self.sketch.age()
                self.door.clear()

        def estimates(self) -> list[tuple]:
            return [(key, min(sketch.MOST, self.sketch.estimate(av) + (av in self.door))) for key, av in self.keys.items()]

    rows = replay.sharded(traces.event_accesses(spark, sf_dir), SHARDS).select("cache", "shard", "seq", "key", "hash")
    out = replay.in_order(rows, "cache string, shard int, key long, estimate int", lambda *_: Shard(), Shard.see, lambda _: [], Shard.estimates)
    return out.select("shard", "key", "estimate")


@query(TOUCHED + "SELECT seq, k AS key, shard, known FROM touched")
def doorkeeper_first_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first-touch filter of an access's shard knew its key."""
    t = replay.sharded(traces.event_accesses(spark, sf_dir), SHARDS).select("shard", "seq", "key", "hash")
    return sketch.first_touches(t, hashing.avalanche(F.col("hash")), COUNTERS).select("seq", "key", "shard", "known")


GHOSTS = 8


@query(f"""WITH RECURSIVE o AS (
  SELECT event_id AS seq, user_id AS k, CASE WHEN event_type IN ('purchase', 'signup') THEN 'add' WHEN event_type = 'error' THEN 'remove' ELSE 'ask' END AS op,
    'c' || (user_id % 3) AS cache, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS n FROM events
), sim AS (
  SELECT DISTINCT cache, 0::BIGINT AS n, 0::BIGINT AS seq, 0::BIGINT AS key, false AS found, list_transform(range({GHOSTS}), lambda x: NULL::BIGINT) AS ring, 0 AS spot FROM o
  UNION ALL
  SELECT s.cache, o.n, o.seq, o.k, list_contains(ring, o.k),
    CASE WHEN o.op = 'remove' THEN list_transform(ring, lambda x: CASE WHEN x = o.k THEN NULL ELSE x END)
      WHEN o.op = 'add' AND NOT list_contains(ring, o.k) THEN list_transform(ring, lambda x, i: CASE WHEN i = spot + 1 THEN o.k ELSE x END) ELSE ring END,
    CASE WHEN o.op = 'add' AND NOT list_contains(ring, o.k) THEN (spot + 1) % {GHOSTS} ELSE spot END
  FROM sim s JOIN o ON o.cache = s.cache AND o.n = s.n + 1
)
SELECT cache, seq, key, found, len(list_filter(ring, lambda x: x IS NOT NULL))::BIGINT AS held FROM sim WHERE n > 0""")
def ghost_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ghost queue of each cache: stores add their key, deletions remove it; whether it was in before, and how many are
    after."""
    class Queue:
        def __init__(self):
            self.ghosts, self.out = sketch.Ghosts(GHOSTS), []

        def take(self, row) -> None:
            seq, key, kind = row
            found = key in self.ghosts
            if kind in ("purchase", "signup"):
                self.ghosts.add(key)
            elif kind == "error":
                self.ghosts.remove(key)
            self.out.append((seq, key, found, len(self.ghosts)))

        def drain(self) -> list[tuple]:
            out, self.out = self.out, []
            return out

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.concat(F.lit("c"), F.col("user_id") % 3).alias("cache"), F.lit(0).alias("shard"), F.col("event_id").alias("seq"), F.col("user_id").alias("key"), "event_type")
    out = replay.in_order(rows, "cache string, shard int, seq long, key long, found boolean, held long", lambda *_: Queue(), Queue.take, Queue.drain, lambda _: [])
    return out.drop("shard")


# HTTP: pages are requests; method, headers and statuses are derived from the page id.
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = traces.pages(spark, sf_dir)
    k = F.col("page_id")
    controls = F.array(*[F.lit(c) for c in CONTROLS])
    headers = F.create_map(F.lit("Accept"), F.when(k % 2 == 0, "text/html").otherwise(""), F.lit("authorization"), F.concat(F.lit("u"), (k % 5).cast("string")), F.lit("X-User"), (k % 7).cast("string"))
    return p.select(
        "page_id", "url", "path", "body_len",
        F.when(k % 10 == 0, "POST").when(k % 3 == 0, "HEAD").otherwise("GET").alias("method"),
        F.get(F.array(*[F.lit(s) for s in STATUSES]), (k % len(STATUSES)).cast("int")).alias("status"),
        F.get(controls, (k % len(CONTROLS)).cast("int")).alias("cache_control"),
        F.when(k % 2 == 0, "application/json; charset=utf-8").when(k % 3 == 0, "text/html").otherwise("text/plain").alias("content_type"),
        headers.alias("headers"),
    )


CONTROLS, STATUSES = traces.CONTROLS, traces.STATUSES
EXPIRES = ["", "Mon, 01 Jan 2024 00:02:00 GMT", "Sun, 31 Dec 2023 23:00:00 GMT", "soon"]  # against 2024-01-01 00:00:00 UTC
REQ = f"""
WITH req AS (
  SELECT page_id, url, coalesce(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '') AS path, length(html) AS body_len,
    CASE WHEN page_id % 10 = 0 THEN 'POST' WHEN page_id % 3 = 0 THEN 'HEAD' ELSE 'GET' END AS method,
    ({STATUSES})[1 + page_id % {len(STATUSES)}] AS status, ({CONTROLS})[1 + page_id % {len(CONTROLS)}] AS cache_control,
    CASE WHEN page_id % 2 = 0 THEN 'application/json; charset=utf-8' WHEN page_id % 3 = 0 THEN 'text/html' ELSE 'text/plain' END AS content_type
  FROM pages
)
"""
def decision(ttl) -> list:
    """Whether a response is cached, and its TTL (0 if not)."""
    return [ttl.isNotNull().alias("cached"), F.coalesce(ttl, F.lit(0)).cast("long").alias("ttl_ns")]


def decision_sql(ttl: str) -> str:
    return f"({ttl}) IS NOT NULL AS cached, coalesce({ttl}, 0)::BIGINT AS ttl_ns"


TTLS = "CASE cache_control WHEN 'max-age=300' THEN 300 WHEN 'public, max-age=600' THEN 600 WHEN 'no-cache, max-age=300' THEN 300 WHEN 'Max-Age = 60' THEN 60 ELSE 0 END"


@query(REQ + """SELECT page_id,
  md5(method || url || CASE WHEN page_id % 2 = 0 THEN 'Accept:text/html' ELSE '' END || 'Authorization:u' || (page_id % 5)) AS default_key,
  md5(method || url || 'X-User:' || (page_id % 7)) AS vary_key,
  md5(method || path || CASE WHEN page_id % 2 = 0 THEN 'Accept:text/html' ELSE '' END || 'Authorization:u' || (page_id % 5)) AS path_hashed_key,
  md5(method || url || 'user:' || (page_id % 7)) AS user_key FROM req""")
def http_key_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir)
    m, u, h = F.col("method"), F.col("url"), F.col("headers")
    return r.select(
        "page_id", http.default_key(m, u, h).alias("default_key"), http.vary_key(m, u, h, ["X-User", "X-None"]).alias("vary_key"),
        http.path_hashed_key(m, F.col("path"), h).alias("path_hashed_key"), http.user_key(m, u, h, "x-user").alias("user_key"),
    )


@query(REQ + "SELECT page_id, method || ':' || path AS path_key, path AS back FROM req")
def http_key_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).withColumn("path_key", http.path_key(F.col("method"), F.col("path")))
    return r.select("page_id", "path_key", http.path_of_key(F.col("path_key")).alias("back"))


BY_HEADERS = f"""CASE WHEN method IN ('GET', 'HEAD') AND status IN (200, 201, 300, 301, 302, 304, 404, 410)
  AND cache_control NOT IN ('no-cache, max-age=300', 'No-Store', 'private') THEN CASE WHEN {TTLS} > 0 THEN {TTLS} * 1000000000::BIGINT
  WHEN page_id % {len(EXPIRES)} = 1 THEN 120000000000 ELSE 300000000000 END END"""
BY_TYPE = """CASE WHEN status BETWEEN 200 AND 299 THEN CASE WHEN starts_with(content_type, 'application/json') THEN 600
  WHEN starts_with(content_type, 'text/html') THEN 300 ELSE 60 END END * 1000000000::BIGINT"""
BY_SIZE = "CASE WHEN status BETWEEN 200 AND 299 AND body_len BETWEEN 500 AND 3000 THEN 60000000000::BIGINT END"


@query(REQ + f"SELECT page_id, {decision_sql(BY_HEADERS)} FROM req")
def http_cache_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir)
    expires = F.get(F.array(*[F.lit(e) for e in EXPIRES]), (F.col("page_id") % len(EXPIRES)).cast("int"))
    ttl = http.default_policy(F.col("method"), F.col("status"), F.col("cache_control"), expires, F.col("body_len"), F.lit("2024-01-01 00:00:00+00:00").cast("timestamp"))
    return r.select("page_id", *decision(ttl))


@query(REQ + f"SELECT page_id, {TTLS}::BIGINT AS seconds FROM req")
def http_max_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("page_id", http.max_age_seconds(F.col("cache_control")).alias("seconds"))


@query(REQ + f"SELECT page_id, {decision_sql(BY_TYPE)} FROM req")
def http_by_content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"application/json": 600 * 10**9, "text/html": 300 * 10**9}
    r = requests(spark, sf_dir)
    return r.select("page_id", *decision(http.by_content_type(F.col("status"), F.col("content_type"), rules, 60 * 10**9)))


@query(REQ + f"SELECT page_id, {decision_sql(BY_SIZE)} FROM req")
def http_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir)
    return r.select("page_id", *decision(http.by_size(F.col("status"), F.col("body_len"), 500, 3000, 60 * 10**9)))


@query(REQ + """SELECT page_id, array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') AS norm,
  len(list_filter(string_split(path, '/'), lambda x: x <> ''))::INTEGER AS depth FROM req""")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = traces.pages(spark, sf_dir)
    return p.select("page_id", http.normalized(F.col("path")).alias("norm"), F.size(http.segments(F.col("path"))).alias("depth"))


@query(REQ + "SELECT page_id FROM req WHERE array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') = 'en/25'")
def invalidate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = traces.pages(spark, sf_dir)
    return p.where(http.invalidates("//en/25/", http.normalized(F.col("path")))).select("page_id")


@query(REQ + """SELECT page_id FROM req WHERE array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') = 'fr'
  OR starts_with(array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/'), 'fr/')""")
def invalidate_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = traces.pages(spark, sf_dir)
    return p.where(http.invalidates("/fr/*", http.normalized(F.col("path")))).select("page_id")


@query(REQ + "SELECT page_id FROM req WHERE body_len > 2000")
def invalidate_by_func(spark: SparkSession, sf_dir: str) -> DataFrame:
    """InvalidateByFunc: any predicate column."""
    return traces.pages(spark, sf_dir).where("body_len > 2000").select("page_id")


ROUNDS = 4
# The request log in SQL, with what the default policy makes of each answer. Times are nanoseconds from the epoch on.
HTTP_LOG = f"""WITH RECURSIVE log AS (
  SELECT r * 1000000000 + page_id AS seq, r * {traces.ROUND_NS} + page_id * {traces.STEP_NS} AS ts, page_id, length(html) AS body_len,
    coalesce(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '') AS path, page_id % 11 = 0 AS streamed,
    CASE WHEN page_id % 10 = 0 THEN 'POST' WHEN page_id % 3 = 0 THEN 'HEAD' ELSE 'GET' END AS method,
    ({traces.STATUSES})[1 + page_id % {len(traces.STATUSES)}] AS status, ({traces.CONTROLS})[1 + page_id % {len(traces.CONTROLS)}] AS cache_control,
    ({traces.EXPIRES})[1 + page_id % {len(traces.EXPIRES)}] AS expires
  FROM pages, (SELECT unnest(range({ROUNDS})) AS r) t
), o AS (
  SELECT seq, ts, method || ':' || path AS key, row_number() OVER (PARTITION BY method, path ORDER BY seq) AS n,
    CASE WHEN NOT streamed AND status IN (200, 201, 300, 301, 302, 304, 404, 410) AND cache_control NOT IN ('no-cache, max-age=300', 'No-Store', 'private')
      THEN CASE WHEN {TTLS} > 0 THEN {TTLS} * 1000000000::BIGINT WHEN expires LIKE '%GMT' AND ts // 1000 < 600000000 THEN (600000000 - ts // 1000) * 1000
      ELSE 300000000000 END END AS ttl_ns
  FROM log WHERE method <> 'POST'
), sim AS (
  SELECT DISTINCT key, 0::BIGINT AS n, 0::BIGINT AS seq, false AS hit, false AS stored, -1::BIGINT AS until, NULL::BIGINT AS version, NULL::BIGINT AS since, 0::BIGINT AS ts FROM o
  UNION ALL
  SELECT key, n, seq, hit, NOT hit AND ttl_ns IS NOT NULL, CASE WHEN hit THEN until WHEN ttl_ns IS NOT NULL THEN ts + ttl_ns ELSE -1 END,
    CASE WHEN hit THEN version ELSE seq END, CASE WHEN hit THEN since ELSE ts END, ts
  FROM (SELECT s.key, o.n, o.seq, o.ts <= s.until AS hit, s.until, s.version, s.since, o.ts, o.ttl_ns FROM sim s JOIN o ON o.key = s.key AND o.n = s.n + 1)
)
"""


def _http(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, http_cache.HttpConfig]:
    config = http_cache.HttpConfig()
    log = http_cache.decided(traces.requests(spark, sf_dir, ROUNDS), config, http_cache.path_key)
    return log, http_cache.log_of(log, config), config


@query(HTTP_LOG + """SELECT seq, key, hit, stored, CASE WHEN hit THEN version END AS version, CASE WHEN hit THEN (ts - since) // 1000000000 END AS age FROM sim WHERE n > 0""")
def http_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrap: every request of a cacheable method is looked up by method and path; a miss runs the handler, and its answer is
    stored as the policy decides."""
    return http_cache.served(*_http(spark, sf_dir)).select("seq", "key", "hit", "stored", "version", "age")


@query(HTTP_LOG + """SELECT event, count(*) AS n FROM (SELECT unnest(['hit', 'miss', 'set']) AS event, unnest([hit, NOT hit, stored]) AS seen FROM sim WHERE n > 0) WHERE seen GROUP BY event""")
def http_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OnHit, OnMiss and OnSet: how often each is called."""
    out = http_cache.served(*_http(spark, sf_dir))
    calls = {"hit": http_cache.on_hit, "miss": http_cache.on_miss, "set": http_cache.on_set}
    rows = [hook(out).select(F.lit(name).alias("event")) for name, hook in calls.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
