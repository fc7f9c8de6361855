"""Keyed state, TTL, hashing, HTTP rules and every registered query against plain models and DuckDB."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import CacheConfig, ConfigError, shard_count, split
from tidemark.functions import hashing, http
from tidemark.operators import state
from tidemark.plans import catalog, http_cache, registry
from tidemark.sources.traces import OPS

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    names = sorted(a.columns)

    def rows(x):
        def one(v):
            if v is None or v is pd.NA or (isinstance(v, float) and v != v):
                return None
            return round(v, 9) if isinstance(v, float) else v

        return sorted((tuple(map(one, r)) for r in x[names].astype(object).itertuples(index=False, name=None)), key=repr)

    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_duckdb(spark, sf, duck, name):
    same(catalog.queries()[name](spark, sf).toPandas(), duck.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, sf, name):
    least = 0 if name == "cycle_signals" else 1  # 15 keys never leave warm-up here
    assert catalog.queries()[name](spark, sf).count() >= least


class Plain:
    """One unlimited cache, operation by operation."""

    def __init__(self, default):
        self.default, self.held = default, {}

    def run(self, op, key, ts, seq, value, ttl, cost):
        e = self.held.get(key)
        dead = e is not None and 0 < e[2] < ts
        if op == "get":
            if dead:
                del self.held[key]
            return ("get", e is not None and not dead, dead)
        if op == "set":
            ttl = self.default if ttl == 0 else ttl
            self.held[key] = (seq, value, ts + ttl if ttl > 0 else 0, cost)
            return ("set", e is not None)
        if op == "delete":
            self.held.pop(key, None)
            return ("delete", e is not None)
        self.held.clear()


def test_state_against_plain_cache(spark):
    rng = random.Random(4)
    rows, want, caches, ts = [], {}, {}, 0
    for seq in range(1500):
        ts += rng.randrange(1, 5)
        op = rng.choices(["get", "set", "delete", "clear"], [6, 4, 1, 0.05])[0]
        r = (seq, ts, rng.choice("ab"), rng.randrange(12), op, float(seq), rng.choice([-1, 0, 20, 60]), rng.randrange(4))
        rows.append(r)
        want[seq] = caches.setdefault(r[2], Plain(40)).run(op, r[3], ts, seq, r[5], r[6], r[7])
    ops = spark.createDataFrame(rows, OPS)
    for r in state.gets(ops, 40).collect():
        assert want[r["seq"]] == ("get", r["hit"], r["expired"])
    for r in state.insert_or_update(ops, 40).collect():
        assert want[r["seq"]] == ("set", r["is_update"])
    for r in state.deletes(ops, 40).collect():
        assert want[r["seq"]] == ("delete", r["removed"])
    held = {(r["cache"], r["key"]): (r["set_seq"], r["value"], r["deadline"], r["cost"]) for r in state.physical(ops, 40).collect()}
    assert held == {(c, k): e for c, p in caches.items() for k, e in p.held.items()}
    live = {(r["cache"], r["key"]) for r in state.live(ops, 40).collect()}
    assert live == {k for k, e in held.items() if not 0 < e[2] < ts}


def test_avalanche_and_shards(spark):
    keys = [0, 1, 42, 1000, -1, -42, 2**62, -(2**63)] + [random.Random(1).getrandbits(63) for _ in range(200)]
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in keys], "k long").select("k", hashing.avalanche(F.col("k"))).collect()}
    assert {k: v % 2**64 for k, v in got.items()} == {k: hashing.avalanche_int(k) for k in keys} and len(set(got.values())) == len(set(keys))
    assert split(10, 4) == [3, 3, 2, 2] and shard_count(0, 3, 0, 8) == 2 and shard_count(5, 1000, 0, 8) == 8 and shard_count(0, 0, 0, 100) == 256


@pytest.mark.parametrize(
    ("field", "value"),
    [("max_size", -1), ("max_cost", -1), ("shard_count", -1), ("cleanup_interval_ns", -1), ("default_ttl_ns", -2), ("policy", "arc"),
     ("cost_admission", "x"), ("probation_ratio", 101), ("ghost_ratio", 101), ("write_buffer_size", -1), ("write_batch_size", -1)],
)
def test_invalid_configs(field, value):
    with pytest.raises(ConfigError) as e:
        CacheConfig(**{field: value}).validate()
    assert e.value.field == field and e.value.value == value


def test_sieve_with_cost_needs_size():
    with pytest.raises(ConfigError):
        CacheConfig(max_size=0, max_cost=5).validate()


def test_registry():
    r = registry.Registry()
    r.register("a", CacheConfig(max_size=10))
    with pytest.raises(registry.CacheExists):
        r.register("a")
    with pytest.raises(registry.CacheNotRegistered):
        r.get("b")
    assert r.get("a") is r.get_with("a", CacheConfig(max_size=99)) and r.get("a").max_size == 10
    with pytest.raises(registry.CacheTypeMismatch):
        r.get("a", "string")
    r.close_all()
    assert not r.live and "a" in r.configs
    r.remove("a")
    assert not r.configs


HEADERS = [("", 0, True), ("max-age=300", 300, True), ("public, max-age=600", 600, True), ("no-cache, max-age=300", 300, False), ("max-age=invalid", 0, True),
           ("no-cache", 0, False), ("no-store", 0, False), ("private", 0, False), ("No-Cache=\"X\"", 0, False), ("max-age=0, max-age=7", 7, True)]


def test_http_rules(spark):
    d = spark.createDataFrame([(c, a, k) for c, a, k in HEADERS], "c string, age int, kept boolean")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ttl = http.default_policy(F.lit("GET"), F.lit(200), F.col("c"), F.lit(""), F.lit(5), now)
    for r in d.select("age", "kept", http.max_age_seconds(F.col("c")).alias("got"), ttl.alias("ttl")).collect():
        assert r["got"] == r["age"] and (r["ttl"] is not None) == r["kept"]
    expires = [("Mon, 01 Jan 2024 00:01:00 GMT", 60), ("Sun, 31 Dec 2023 00:00:00 GMT", 300), ("soon", 300), ("", 300), (None, 300)]
    e = spark.createDataFrame(expires, "e string, s int")
    for r in e.select("s", http.default_policy(F.lit("GET"), F.lit(200), F.lit(""), F.col("e"), F.lit(5), now).alias("ttl")).collect():
        assert r["ttl"] == r["s"] * 10**9
    paths = [("", ""), ("/", ""), ("/api", "api"), ("/api/v1/users/", "api/v1/users"), ("//api//v1//users//", "api/v1/users")]
    for r in spark.createDataFrame(paths, "p string, n string").select("n", http.normalized(F.col("p")).alias("got")).collect():
        assert r["n"] == r["got"]
    keys = spark.createDataFrame([(p,) for p in ("", "/api/v1/users", "/api/v1/users", "/api/v1/posts", "/api/v2/x", "/web")], "p string")
    norm = keys.select(http.normalized(F.col("p")).alias("n"))
    want = {"/api/v1/users": 2, "/api/v1/*": 3, "/api/*": 4, "/*": 6, "/none": 0, "/": 1, "": 1, "/api/v1/us*": 0, "/web*": 1}
    assert {p: norm.where(http.invalidates(p, F.col("n"))).count() for p in want} == want
    kept = spark.range(1).select(http.kept_headers(F.create_map(F.lit("date"), F.lit("x"), F.lit("X-Cache-Age"), F.lit("1"), F.lit("Via"), F.lit("y"))).alias("h")).first()["h"]
    assert kept == {"Via": "y"}


def test_expires_is_read_in_gmt(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            d = spark.createDataFrame([("Mon, 01 Jan 2024 00:01:00 GMT",)], "e string")
            now = F.lit("2024-01-01 00:00:00+00:00").cast("timestamp")
            ttl = http.default_policy(F.lit("GET"), F.lit(200), F.lit(""), F.col("e"), F.lit(5), now)
            assert d.select(ttl.alias("t")).first()["t"] == 60 * 10**9
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize(
    ("field", "value"),
    [("max_size", -1), ("shard_count", -1), ("cleanup_interval_ns", -1), ("default_ttl_ns", -2), ("policy", "arc"), ("probation_ratio", 101), ("ghost_ratio", -1), ("max_body", -1)],
)
def test_invalid_http_configs(field, value):
    with pytest.raises(ConfigError) as e:
        http_cache.HttpConfig(**{field: value}).resolved()
    assert e.value.field == field


def test_http_config_defaults_and_switches():
    c = http_cache.HttpConfig().resolved()
    assert (c.max_size, c.shard_count, c.default_ttl_ns, c.methods, c.max_body) == (100_000, 16, 300 * 10**9, ("GET", "HEAD"), 10 << 20)
    off = http_cache.HttpConfig(no_cleanup=True, no_size_limit=True, no_body_limit=True, methods=(), statuses=(418,), policy="default").resolved()
    assert (off.cleanup_interval_ns, off.max_size, off.max_body, off.methods, off.statuses, off.policy) == (0, 0, 0, (), (418,), "sieve")
    assert http_cache.HttpConfig(no_stats=True).cache().stats_enabled is False


REQUEST = "seq long, ts long, method string, url string, path string, headers map<string,string>, status int, cache_control string, expires string, body_len long, streamed boolean"


def test_http_cache_end_to_end(spark):
    """Hits, misses, what is stored, ages, hooks, headers, the index after removals, and invalidation."""
    s = 10**9
    rows = [
        (1, 0, "GET", "/a/b?x", "/a/b", {}, 200, "max-age=10", "", 5, False), (2, 5 * s, "GET", "/a/b?x", "/a/b", {}, 200, "", "", 5, False),
        (3, 11 * s, "GET", "/a/b?x", "/a/b", {}, 200, "max-age=60", "", 5, False), (4, 12 * s, "POST", "/a/b?x", "/a/b", {}, 200, "", "", 5, False),
        (5, 13 * s, "GET", "/a/c", "/a/c", {}, 200, "", "", 50, False), (6, 14 * s, "GET", "/s", "/s", {}, 200, "", "", 5, True),
        (7, 15 * s, "GET", "/t", "/t", {}, 418, "", "", 5, False), (8, 16 * s, "GET", "/d", "/d", {}, 101, "", "", 0, False),
        (9, 17 * s, "GET", "/e", "/e", {}, 200, "no-store", "", 5, False), (10, 20 * s, "GET", "/a/b?x", "/a/b", {}, 200, "", "", 5, False),
    ]
    d = spark.createDataFrame(rows, REQUEST)
    config = http_cache.HttpConfig(max_body=20, statuses=(200, 418), hit_header="X-Hit", miss_header="X-Miss")
    requests = http_cache.decided(d, config, http_cache.path_key)
    log = http_cache.log_of(requests, config)
    out = http_cache.served(requests, log, config)
    got = {r["seq"]: r for r in out.collect()}
    assert {k: (r["hit"], r["stored"], r["version"], r["age"]) for k, r in got.items()} == {
        1: (False, True, None, None), 2: (True, False, 1, 5), 3: (False, True, None, None), 5: (False, False, None, None), 6: (False, False, None, None),
        7: (False, True, None, None), 8: (False, False, None, None), 9: (False, False, None, None), 10: (True, False, 3, 9),
    }
    assert got[10]["cache_headers"] == {"X-Hit": "HIT", "X-Cache-Date": "1970-01-01T00:00:11Z", "X-Cache-Age": "9s"} and got[1]["cache_headers"] == {"X-Miss": "MISS"}
    assert [r["seq"] for r in http_cache.on_hit(out).orderBy("seq").collect()] == [2, 10]
    assert {r["seq"]: r["ttl_ns"] for r in http_cache.on_set(out).collect()} == {1: 10 * s, 3: 60 * s, 7: 300 * s}
    assert http_cache.on_miss(out).count() == 7
    idx = http_cache.index(requests, log)
    assert {(r["key"], r["version"], r["norm"]) for r in idx.collect()} == {("GET:/a/b", 3, "a/b"), ("GET:/t", 7, "t")}
    assert [r["key"] for r in http_cache.invalidated(idx, "/a/*").collect()] == ["GET:/a/b"]
    small = http_cache.HttpConfig(max_size=1, shard_count=1, policy="fifo", max_body=20, statuses=(200, 418))
    assert [(r["key"], r["version"]) for r in http_cache.index(requests, http_cache.log_of(requests, small)).collect()] == [("GET:/a/b", 10)]


def test_epochs_in_small_blocks(spark, monkeypatch):
    """Many clears, and blocks of a few operations; nothing is gathered or broadcast by the plan itself."""
    monkeypatch.setattr(state, "SPAN", 8)
    rng = random.Random(9)
    rows = [(k, k // 2, rng.choice("ab"), 1, rng.choice(["get", "set", "clear"]), 0.0, -1, 1) for k in range(400)]
    ops = spark.createDataFrame(rows, OPS)
    clears = {c: [r[0] for r in rows if r[4] == "clear" and r[2] == c] for c in "ab"}
    out = state.with_epoch(ops)
    assert all(r["epoch"] == sum(x <= r["seq"] for x in clears[r["cache"]]) for r in out.collect())
    assert "collect_list" not in out._jdf.queryExecution().toString()
    times = {c: [r[1] for r in rows if r[4] == "clear" and r[2] == c] for c in "ab"}
    by_time = state.with_epoch_by_time(ops, ops.where("op = 'set'"))
    assert all(r["epoch"] == sum(x < r["ts"] for x in times[r["cache"]]) for r in by_time.collect())


def test_registry_stats_in_one_pass(spark, sf):
    """Every live cache under its own configuration; events are counted where statistics are on."""
    from tidemark.operators import replay
    from tidemark.sources import traces

    r = registry.Registry()
    with pytest.raises(registry.CacheNotRegistered):
        r.stats(traces.events(spark, sf))
    configs = {"c0": CacheConfig(policy="lru", shard_count=2, max_size=6, stats_enabled=True), "c1": CacheConfig(policy="lfu", shard_count=1, max_size=5)}
    for name, c in configs.items():
        r.get_with(name, c)
    r.register("c2", CacheConfig(max_size=9))  # never used, so not live
    got = {x["cache"]: x.asDict() for x in r.stats(traces.events(spark, sf)).collect()}
    assert set(got) == {"c0", "c1"}
    ops = traces.events(spark, sf)
    assert got["c0"] == replay.summary(replay.replay(ops.where("cache = 'c0'"), configs["c0"])).first().asDict()
    assert [got["c1"][k] for k in ("hits", "misses", "evictions", "expirations", "hit_ratio")] == [0, 0, 0, 0, 0.0]
    assert got["c1"]["size"] == replay.summary(replay.replay(ops.where("cache = 'c1'"), configs["c1"])).first()["size"]
