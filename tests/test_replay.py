"""Replay kernels: exact values, invariants, seeded traces, and streaming against batch."""

import random
from collections import OrderedDict

import pytest

from tidemark.config import CacheConfig
from tidemark.functions.hashing import avalanche_int
from tests.sieve_model import PlainSieve
from tidemark.operators import lru, replay
from tidemark.operators.kernels import kinds
from tidemark.operators.sieve import admission_score
from tidemark.operators.sketch import Doorkeeper, Ghosts, Sketch
from tidemark.sources import traces


def shard(policy, cap, cost=0, **more):
    return kinds()[policy](CacheConfig(policy=policy, max_size=cap, max_cost=cost, **more), cap, cost)


def access(s, keys):
    """Read-through; the number of hits."""
    hits = 0
    for n, k in enumerate(keys):
        s.seq = n
        if s.get(k, 0):
            hits += 1
        else:
            s.set(k, avalanche_int(k), 1, 0)
    return hits


def zipf(rng, n, keys, s):
    weights = [1 / (k + 1) ** s for k in range(keys)]
    return rng.choices(range(keys), weights, k=n)


def test_sketch_values():
    s, av = Sketch(1024), avalanche_int(avalanche_int(7))
    for _ in range(20):
        s.add(av)
    assert s.estimate(av) == 15
    s.age()
    assert s.estimate(av) == 7
    s.clear()
    assert s.estimate(av) == 0


def test_doorkeeper_takes_the_first_touch():
    s = shard("sieve", 100)
    h = avalanche_int(5)
    seen = []
    for _ in range(2):
        s.seen(h)
        s.seen(h)
        seen.append((s.sketch.estimate(avalanche_int(h)), s.frequency(h)))
    s.sketch.age()
    s.door.clear()
    assert seen == [(1, 2), (3, 4)] and s.frequency(h) == 1
    assert not Doorkeeper(64).add(3)


def test_segment_sizes():
    s = shard("sieve", 100)
    assert (s.probation_cap, s.main_cap, s.ghost_cap) == (1, 99, 74)
    s.set_probation(1000)
    assert (s.probation_cap, s.main_cap) == (60, 40)
    s.set_probation(-1)
    assert (s.probation_cap, s.main_cap) == (1, 99)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 16, 64])
def test_ghosts_against_plain_ring(n):
    for seed in range(10):
        rng, g, ring, at = random.Random(seed), Ghosts(n), [None] * n, 0
        for _ in range(600):
            h = rng.randrange(1, 3 * n + 2)
            if rng.random() < 0.7:
                g.add(h)
                if h not in ring:
                    ring[at], at = h, (at + 1) % n
            else:
                assert g.remove(h) == (h in ring)
                ring = [None if x == h else x for x in ring]
            assert all((x in g) == (x in ring) for x in range(1, 3 * n + 2))


@pytest.mark.parametrize("policy", ["lru", "fifo", "lfu", "sieve"])
def test_conservation(policy):
    s = shard(policy, 50)
    for k in range(5000):
        s.seq = k
        s.set(k, avalanche_int(k), 1, 0)
    gone = [(key, event) for _, event, key, _ in s.log if event in ("capacity", "rejected")]
    assert len(gone) + len(s.table) == 5000 and len({k for k, _ in gone}) == len(gone)
    assert policy == "sieve" or all(e == "capacity" for _, e in gone)
    assert policy != "sieve" or s.probation.size + s.main.size == len(s.table)


@pytest.mark.parametrize("policy", ["lru", "fifo", "lfu", "sieve"])
def test_random_operations_stay_within_limits(policy):
    rng = random.Random(3)
    for cap, cost in ((20, 0), (20, 60)):
        s = shard(policy, cap, cost)
        for n in range(6000):
            s.seq, key, op = n, rng.randrange(60), rng.random()
            if op < 0.5:
                s.get(key, n)
            elif op < 0.9:
                s.set(key, avalanche_int(key), rng.randrange(0, 9), rng.choice([0, n + rng.randrange(1, 50)]))
            elif op < 0.97:
                s.delete(key)
            elif op < 0.99:
                s.cleanup(n)
            elif rng.random() < 0.05:
                s.clear()
            assert len(s.table) <= cap and (not cost or s.cost <= cost) and s.cost == sum(e.cost for e in s.table.values())


def test_lru_and_fifo_against_ordered_dict():
    rng = random.Random(8)
    keys = zipf(rng, 4000, 200, 1.0)
    for policy in ("lru", "fifo"):
        held, hits = OrderedDict(), 0
        for k in keys:
            if k in held:
                hits += 1
                if policy == "lru":
                    held.move_to_end(k)
            else:
                if len(held) == 40:
                    held.popitem(last=False)
                held[k] = 1
        assert access(shard(policy, 40), keys) == hits


def test_lfu_update_resets():
    s = shard("lfu", 3)
    for k in "abc":
        s.set(k, 0, 1, 0)
    for k in "a" * 10 + "bc":
        s.get(k, 0)
    s.set("a", 0, 1, 0)
    s.set("d", 0, 1, 0)
    assert set(s.table) == {"b", "c", "d"}


def test_weighted_lru_and_too_large():
    s = shard("lru", 0, 10)
    for k in (1, 2, 3):
        s.set(k, 0, 4, 0)
    assert s.cost <= 10 and 1 not in s.table and not s.set(9, 0, 11, 0) and not s.set(9, 0, -1, 0)


def test_expiry_is_strict_and_seen_late():
    s = shard("lru", 5)
    s.set(1, 0, 1, 10)
    assert s.get(1, 10) and len(s.table) == 1 and not s.get(1, 11) and not s.table
    s.set(2, 0, 1, 10)
    s.seq = 9
    assert len(s.table) == 1 and s.delete(2)


def test_admission_scores():
    assert admission_score(2, 64, "frequency") - admission_score(3, 1, "frequency") < 0
    for mode in ("density", "balanced"):
        assert admission_score(2, 64, mode) > admission_score(3, 1, mode)
    assert admission_score(15, 1 << 63, "density") == (1 << 64) - 1


def test_seeded_traces():
    rng = random.Random(1)
    z = zipf(rng, 30000, 2000, 1.12)
    assert access(shard("sieve", 128), z) >= access(shard("fifo", 128), z)
    loop = list(range(80)) * 80
    assert access(shard("sieve", 64), loop) >= access(shard("lru", 64), loop) == 0
    scan = list(range(64)) * 12 + list(range(10**6, 10**6 + 2000))
    left = {}
    for p in ("sieve", "lru"):
        s = shard(p, 64)
        access(s, scan)
        left[p] = sum(k in s.table for k in range(64))
    assert left["sieve"] > left["lru"]
    shifting = []
    for phase in range(8):
        hot = range(phase * 1000, phase * 1000 + 96)
        shifting += [rng.choice(hot) if rng.random() < 0.85 else 10**6 + rng.randrange(8000) for _ in range(4000)]
    assert access(shard("sieve", 128), shifting) >= 0.45 * len(shifting)
    burst = [k for b in range(40) for k in [b * 100 + x for x in range(48)] * 6 + [10**6 + b * 1000 + x for x in range(120)]]
    assert access(shard("sieve", 96), burst) >= 0.35 * len(burst)


def test_replay_in_spark_equals_kernels(spark, sf):
    ops = traces.event_accesses(spark, sf)
    config = CacheConfig(policy="sieve", shard_count=1, max_size=8).resolved()
    log = replay.replay(ops, config).toPandas()
    keys = [r["key"] for r in ops.orderBy("seq").collect()]
    assert (log.event == "hit").sum() == access(shard("sieve", 8), keys)


def test_streaming_replay_equals_batch(spark, sf, tmp_path):
    from tidemark.streaming import stream

    ops = traces.events(spark, sf)
    config = CacheConfig(policy="sieve", shard_count=2, max_size=8, default_ttl_ns=traces.DEFAULT_TTL_NS)
    for k in range(3):
        ops.where(f"seq >= {334 * k} AND seq < {334 * (k + 1)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.replay_stream(source, config).writeStream.format("memory").queryName("log").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("log").collect())
    want = replay.replay(ops, config).where("event IN ('hit','miss','set','update','too_large','capacity','rejected','expired','deleted')")
    assert got == sorted(tuple(r) for r in want.collect()) and got


def random_trace(rng, n, keys, cost):
    """Operations (op, key, cost, deadline) with loops, skew and time out of date."""
    kind = rng.choice(["zipf", "loop", "mix", "uniform"])
    for i in range(n):
        loop = kind == "loop" or (kind == "mix" and i // 600 % 2)
        key = i % keys if loop else int(keys * rng.random() ** 3) if kind == "zipf" else rng.randrange(keys)
        op = rng.choices(["access", "set", "delete", "clear"], [80, 17, 2.9, 0.04])[0]
        yield op, key, rng.randrange(6) if cost else 1, rng.choice([0] * 9 + [i + 30])


@pytest.mark.parametrize("seed", range(24))
def test_sieve_against_plain_model(seed):
    """Every removal, counter and cycle of the sieve, operation by operation."""
    rng = random.Random(seed)
    cap, admission = rng.choice([1, 2, 3, 5, 10, 20, 64]), rng.choice(["frequency", "frequency", "balanced", "density"])
    cost, probation, ghosts = rng.choice([0, 0, 2 * cap, 3 * cap]), rng.choice([1, 10, 50, 100]), rng.choice([1, 50, 75, 100])
    s = shard("sieve", cap, cost, cost_admission=admission, probation_ratio=probation, ghost_ratio=ghosts)
    m = PlainSieve(cap, cost, probation, ghosts, admission)
    for i, (op, key, c, deadline) in enumerate(random_trace(rng, 2500, max(2, int(cap * rng.choice([1.1, 1.3, 2, 5]))), cost)):
        s.seq = m.n = i
        if op == "clear":
            s.clear(), m.clear()
        elif op == "delete":
            if key in m.e:
                m.remove(key, "deleted")
            s.delete(key)
        else:
            if op == "access" and (hit := s.get(key, i)) | (m.get(key, i) ^ hit):
                assert hit
                continue
            s.set(key, avalanche_int(key), c, deadline)
            m.set(key, avalanche_int(key), c, deadline)
    assert [(n, e, k) for n, e, k, _ in s.log if e in replay.REMOVED] == m.log
    assert (s.totals, s.cycles, set(s.table)) == (m.totals, m.cycles, set(m.e))


def test_sieve_queries_against_plain_model(spark, sf):
    """The registered sieve queries, shard by shard."""
    from tidemark.plans import catalog

    rows = replay.sharded(traces.event_accesses(spark, sf), catalog.SHARDS).orderBy("seq").collect()
    for name, cost, admission in (("sieve_replay", 0, "frequency"), ("sieve_cost_replay", catalog.BUDGET // catalog.SHARDS, "density")):
        models, hits = {}, 0
        for r in rows:
            m = models.setdefault(r["shard"], PlainSieve(catalog.LIMIT // catalog.SHARDS, cost, admission=admission))
            m.n = r["seq"]
            if m.get(r["key"], 0):
                hits += 1
            else:
                m.set(r["key"], r["hash"] % 2**64, r["cost"], 0)
        evicted = sum(e == "capacity" for m in models.values() for _, e, _ in m.log)
        got = catalog.queries()[name](spark, sf).first()
        assert (got["hits"], got["misses"], got["evictions"]) == (hits, len(rows) - hits, evicted)
        assert (got["size"], got["cost"]) == (sum(len(m.e) for m in models.values()), sum(m.cost() for m in models.values()))
        if name == "sieve_replay":
            stats = catalog.queries()["policy_stats"](spark, sf).first().asDict()
            assert stats == {"cache": "all"} | {k: sum(m.totals[k] for m in models.values()) for k in stats if k != "cache"}
            cycles = sorted(tuple(r)[1:-2] for r in catalog.queries()["cycle_signals"](spark, sf).collect())
            assert cycles == sorted((k, i, *c) for k, m in models.items() for i, c in enumerate(m.cycles))


def test_sieve_removals_against_plain_model(spark, sf):
    from collections import Counter

    from tidemark.config import split
    from tidemark.plans import catalog

    ops = replay.control_to_all(traces.events(spark, sf), catalog.OPS_SHARDS).orderBy("seq").collect()
    models, last, want = {}, {}, Counter()
    for r in ops:
        at = r["cache"], r["shard"]
        m = models.setdefault(at, PlainSieve(split(catalog.OPS_LIMIT, catalog.OPS_SHARDS)[r["shard"]]))
        m.n = r["seq"]
        if r["ts"] // catalog.SWEEP_NS > last.get(at, 0):
            last[at] = r["ts"] // catalog.SWEEP_NS
            for k in [k for k, x in m.e.items() if 0 < x["deadline"] < last[at] * catalog.SWEEP_NS]:
                m.remove(k, "expired")
        if r["op"] == "get":
            m.get(r["key"], r["ts"])
        elif r["op"] == "set":
            ttl = catalog.TTL if r["ttl_ns"] == 0 else r["ttl_ns"]
            m.set(r["key"], r["hash"] % 2**64, r["cost"], r["ts"] + ttl)
        elif r["op"] == "delete" and r["key"] in m.e:
            m.remove(r["key"], "deleted")
        elif r["op"] == "clear":
            m.clear()
    for (cache, _), m in models.items():
        want.update((cache, why) for _, why, _ in m.log)
    assert {(r["cache"], r["reason"]): r["n"] for r in catalog.queries()["removals_by_reason"](spark, sf).collect()} == want


@pytest.mark.parametrize("policy", ["lru", "fifo", "lfu"])
def test_simple_policies_against_plain_lists(policy):
    rng = random.Random(12)
    for cap, cost in ((12, 0), (12, 30)):
        s, held, gone = shard(policy, cap, cost), [], []  # (uses, birth, key, cost)
        for n in range(4000):
            s.seq, key, op, c = n, rng.randrange(30), rng.random(), rng.randrange(6)
            own = [x for x in held if x[2] == key]
            rest = [x for x in held if x[2] != key]

            def evict(rest, more):
                while rest and (len(rest) + (more is not None) > cap or (cost and sum(x[3] for x in rest) + (more or 0) > cost)):
                    first = min(rest) if policy == "lfu" else rest[0]
                    rest.remove(first)
                    gone.append((n, first[2]))
                return rest

            if op < 0.5:
                assert s.get(key, 0) == bool(own)
                if own and policy == "lru":
                    held = rest + own
                if own and policy == "lfu":
                    held = [*rest, (own[0][0] + 1, *own[0][1:])]
            elif op < 0.9:
                s.set(key, 0, c, 0)
                if not own:
                    held = [*evict(rest, c), (1, n, key, c)]
                else:
                    new = (1, own[0][1], key, c)
                    held = evict([new if x[2] == key else x for x in held] if policy == "fifo" else [*rest, new], None)
            else:
                s.delete(key)
                held = rest
            assert [(a, k) for a, e, k, _ in s.log if e == "capacity"] == gone and set(s.table) == {x[2] for x in held}
            if n % 100 == 0:
                s.log.clear(), gone.clear()


def test_refused_costs_and_weighers(spark):
    from tidemark.config import CacheError, InvalidCost, ItemTooLarge

    s = shard("lru", 5, 10)
    s.set(1, 0, -1, 0), s.set(2, 0, 11, 0), s.set(3, 0, 10, 0)
    assert s.tally == {"invalid_cost": 1, "too_large": 1, "set": 1}
    rows = [(k, k, "c", k, "set", float(v), None, None) for k, v in enumerate((3, -1, 6, 5))] + [(9, 9, "c", 1, "get", None, None, None)]
    ops = spark.createDataFrame(rows, traces.OPS)
    config = CacheConfig(policy="lru", shard_count=2, max_size=10, max_cost=10)
    from pyspark.sql import functions as F

    got = replay.weighed(ops, F.col("value"), config).orderBy("seq").select("cost", "refused").collect()
    assert [tuple(r) for r in got] == [(3, None), (-1, "invalid_cost"), (6, "too_large"), (5, None), (1, None)]
    for first, cause in ((0, InvalidCost), (2, ItemTooLarge)):
        with pytest.raises(CacheError) as e:
            replay.weighed(ops.where(f"seq >= {first}"), F.col("value"), config, strict=True)
        assert isinstance(e.value.__cause__, cause) and e.value.op == "set"


def test_periodic_sweeps():
    """A shard is swept when the first operation of a later interval reaches it."""
    s = replay.new_shard(CacheConfig(policy="lru", shard_count=1, max_size=9, cleanup_interval_ns=100).resolved(), 0)
    rows = [(0, 10, 1, 0, "set", 30, 1), (1, 60, 2, 0, "get", -1, 1), (2, 150, 2, 0, "get", -1, 1), (3, 160, 3, 0, "set", 20, 1), (4, 199, 2, 0, "get", -1, 1), (5, 301, 2, 0, "get", -1, 1)]
    for r in rows:
        replay.apply(s, r)
    assert [(n, e, k) for n, e, k, _ in s.log if e == "expired"] == [(2, "expired", 1), (5, "expired", 3)]


def test_one_replay_for_caches_of_their_own(spark, sf):
    ops = traces.events(spark, sf)
    configs = {"c0": CacheConfig(policy="lru", shard_count=2, max_size=6), "c1": CacheConfig(policy="fifo", shard_count=4, max_size=9)}
    got = {r["cache"]: r for r in replay.summary(replay.replay(ops, configs, detail=False)).collect()}
    assert set(got) == set(configs)
    for name, c in configs.items():
        assert got[name] == replay.summary(replay.replay(ops.where(ops["cache"] == name), c)).first()


@pytest.mark.parametrize("span", [3, 16, 1 << 18])
def test_stack_distance_in_blocks(spark, span):
    rng = random.Random(span)
    rows = [("c", k % 2, 3 * k, int(30 * rng.random() ** 2)) for k in range(500)]
    got = {(r["shard"], r["seq"]): r["distance"] for r in lru.stack_distance(spark.createDataFrame(rows, "cache string, shard int, seq long, key long"), span).collect()}
    for s in (0, 1):
        order = []
        for _, _, seq, key in (r for r in rows if r[1] == s):
            assert got[s, seq] == (order[::-1].index(key) if key in order else -1)
            order = [k for k in order if k != key] + [key]


def test_stream_cache_lifecycle(spark, tmp_path):
    """Writes, a barrier, removals handed to the callbacks, and errors after close."""
    from tidemark.config import CacheClosed
    from tidemark.streaming import stream

    path, removed, evicted = str(tmp_path / "in"), [], []

    def write(rows):
        spark.createDataFrame([(n, n, "c", k, op, 1.0, ttl, 1) for n, op, k, ttl in rows], traces.OPS).coalesce(1).write.mode("append").parquet(path)

    spark.createDataFrame([], traces.OPS).write.parquet(path)
    source = spark.readStream.schema(traces.OPS).parquet(path)
    config = CacheConfig(policy="lru", shard_count=1, max_size=2, cleanup_interval_ns=0)
    cache = stream.StreamCache(source, config, write, lambda df, _: removed.extend((r["key"], r["reason"]) for r in df.collect()), lambda df, _: evicted.extend(r["key"] for r in df.collect()), str(tmp_path / "cp"))
    cache.write([(1, "set", 1, -1), (2, "set", 2, -1), (3, "set", 3, -1)])
    cache.sync()
    assert removed == [(1, "capacity")] and evicted == [1]
    cache.write([(4, "delete", 2, -1), (5, "set", 4, 3), (20, "get", 4, -1)])
    cache.close()
    assert removed == [(1, "capacity"), (2, "deleted"), (4, "expired")] and evicted == [1]
    cache.close()
    for late in (cache.sync, lambda: cache.write([])):
        with pytest.raises(CacheClosed):
            late()


def test_streaming_latest(spark, tmp_path):
    from tidemark.streaming import stream

    rows = [(1, 10**9, "c", 1, "set", 5.0, 10**9, 1), (2, 2 * 10**9, "c", 2, "set", 6.0, -1, 1), (3, 10 * 10**9, "c", 3, "set", 7.0, -1, 1), (4, 11 * 10**9, "c", 2, "delete", None, None, 1)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], traces.OPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(traces.OPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = stream.latest(source, 0).writeStream.format("memory").queryName("latest").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["key"], r["event"]) for r in spark.table("latest").collect()}
    assert {(1, "set"), (2, "set"), (3, "set"), (1, "expired"), (2, "deleted")} == got


def test_streaming_latest_equals_batch_state(spark, tmp_path):
    """Sets, deletes, clears and reads of one trace, in batches whose rows are out of order: what is left is the batch
    state, and what a read saw expired is gone."""
    from tidemark.operators import state
    from tidemark.streaming import stream

    rng, rows, ts = random.Random(6), [], 10**12
    for seq in range(400):
        ts += rng.randrange(10**9)
        op = rng.choices(["get", "set", "delete", "clear"], [5, 4, 1, 0.1])[0]
        rows.append((seq, ts, rng.choice("ab"), rng.randrange(6), op, float(seq), rng.choice([-1, 4 * 10**9, 400 * 10**9]), 1))
    path = str(tmp_path / "in")
    for k in range(0, 400, 100):
        part = rows[k : k + 100]
        rng.shuffle(part)
        spark.createDataFrame(part, traces.OPS).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keys = spark.createDataFrame([(c, k) for c in "ab" for k in range(6)], "cache string, key long")
    source = spark.readStream.schema(traces.OPS).option("maxFilesPerTrigger", 1).parquet(path)
    year = 365 * 86400 * 10**9  # no sweep within the trace
    q = stream.latest(source, 0, every_ns=year, keys=keys).writeStream.format("memory").queryName("state").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    changes = spark.table("state").collect()
    want = {(r["cache"], r["key"]): r["set_seq"] for r in state.physical(spark.createDataFrame(rows, traces.OPS), 0).collect()}
    last = {}
    for r in changes:
        if r["event"] == "set":
            last[r["cache"], r["key"]] = max(last.get((r["cache"], r["key"]), -1), r["seq"])
    gone = {(r["cache"], r["key"]): max(x["seq"] for x in changes if (x["cache"], x["key"]) == (r["cache"], r["key"]) and x["event"] != "set") for r in changes if r["event"] != "set"}
    assert all(last[k] == n for k, n in want.items())
    cleared = {c: max([r[0] for r in rows if r[4] == "clear" and r[2] == c], default=-1) for c in "ab"}
    for k, n in last.items():
        if k not in want:
            assert gone.get(k, -1) >= n or cleared[k[0]] > n
