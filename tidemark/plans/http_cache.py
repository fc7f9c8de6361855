"""A response cache over a request log: configuration, replay, what each request was served, and the index of paths.

A request log has seq, ts (ns), method, url, path, headers (map), status, cache_control, expires, content_type, body_len and
streamed; it says what the handler would answer to each request. Keys and policies are functions that make columns of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import NO_EXPIRATION, POLICIES, SECOND, CacheConfig, ConfigError
from tidemark.functions import http
from tidemark.operators import replay

CACHE = "http"
STORED = ("set", "update")
RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"


@dataclass(frozen=True)
class HttpConfig:
    """Zero and empty values take the defaults; the switches turn off what is on by default."""

    max_size: int = http.MAX_SIZE
    shard_count: int = http.SHARDS
    cleanup_interval_ns: int = 300 * SECOND
    default_ttl_ns: int = http.DEFAULT_TTL_NS
    policy: str = "sieve"
    probation_ratio: int = 0
    ghost_ratio: int = 0
    methods: tuple[str, ...] | None = None
    statuses: tuple[int, ...] | None = None
    ignored_headers: tuple[str, ...] | None = None
    max_body: int = http.MAX_BODY
    hit_header: str = http.HIT_HEADER
    miss_header: str = http.HIT_HEADER
    no_stats: bool = False
    no_cleanup: bool = False
    no_size_limit: bool = False
    no_body_limit: bool = False

    def validate(self) -> HttpConfig:
        for field in ("max_size", "shard_count", "cleanup_interval_ns", "max_body"):
            if getattr(self, field) < 0:
                raise ConfigError(field, getattr(self, field), "must be >= 0")
        if self.default_ttl_ns < 0 and self.default_ttl_ns != NO_EXPIRATION:
            raise ConfigError("default_ttl_ns", self.default_ttl_ns, "must be >= 0 or NO_EXPIRATION")
        if self.policy not in POLICIES:
            raise ConfigError("policy", self.policy, f"must be one of {', '.join(POLICIES)}")
        for field in ("probation_ratio", "ghost_ratio"):
            if not 0 <= getattr(self, field) <= 100:
                raise ConfigError(field, getattr(self, field), "must be <= 100")
        return self

    def resolved(self) -> HttpConfig:
        """With every default filled in and every switch applied."""
        self.validate()
        own = {f: getattr(self, f) or getattr(HttpConfig, f) for f in ("max_size", "shard_count", "cleanup_interval_ns", "default_ttl_ns", "max_body", "hit_header", "miss_header")}
        given = {"methods": http.METHODS, "statuses": http.STATUSES, "ignored_headers": http.IGNORED}
        own |= {f: standard if getattr(self, f) is None else getattr(self, f) for f, standard in given.items()}
        for switch, field in (("no_cleanup", "cleanup_interval_ns"), ("no_size_limit", "max_size"), ("no_body_limit", "max_body")):
            own |= {field: 0} if getattr(self, switch) else {}
        own["policy"] = "sieve" if self.policy == "default" else self.policy
        return replace(self, **own)

    def cache(self) -> CacheConfig:
        """The backing cache."""
        c = self.resolved()
        return CacheConfig(
            max_size=c.max_size, shard_count=c.shard_count, cleanup_interval_ns=c.cleanup_interval_ns, default_ttl_ns=c.default_ttl_ns,
            policy=c.policy, probation_ratio=c.probation_ratio, ghost_ratio=c.ghost_ratio, stats_enabled=not c.no_stats,
        )


Rule = Callable[[HttpConfig], Column]


def default_key(config: HttpConfig) -> Column:
    return http.default_key(F.col("method"), F.col("url"), F.col("headers"))


def path_key(config: HttpConfig) -> Column:
    return http.path_key(F.col("method"), F.col("path"))


def default_policy(config: HttpConfig) -> Column:
    now = F.timestamp_micros(F.floor(F.col("ts") / 1000))
    return http.default_policy(
        F.col("method"), F.col("status"), F.col("cache_control"), F.col("expires"), F.col("body_len"), now,
        config.default_ttl_ns, config.methods, config.statuses, config.max_body,
    )


def decided(requests: DataFrame, config: HttpConfig, key: Rule = default_key, policy: Rule = default_policy) -> DataFrame:
    """Requests of cacheable methods with ``key`` and ``ttl_ns``, which is null where the response would not be stored."""
    config = config.resolved()
    whole = http.captured(F.col("status"), F.col("body_len"), F.col("streamed"), config.max_body)
    return requests.where(F.col("method").isin(*config.methods)).withColumns({"key": key(config), "ttl_ns": F.when(whole, policy(config))})


def operations(requests: DataFrame) -> DataFrame:
    """Decided requests as a trace: a lookup, and a store after a miss where the response is stored."""
    return requests.select(
        "seq", "ts", F.lit(CACHE).alias("cache"), F.xxhash64("key").alias("key"), F.when(F.col("ttl_ns").isNull(), "get").otherwise("access").alias("op"),
        F.lit(None).cast("double").alias("value"), "ttl_ns", F.lit(1).cast("long").alias("cost"),
    )


def log_of(requests: DataFrame, config: HttpConfig) -> DataFrame:
    """The replay's log of decided requests."""
    return replay.replay(operations(requests), config.cache())


def served(requests: DataFrame, log: DataFrame, config: HttpConfig) -> DataFrame:
    """Each decided request with what it was served: ``hit``, the seq ``version`` of the stored response and its age, whether
    it was ``stored`` itself, and the headers that the cache sets."""
    config = config.resolved()
    found = log.where(F.col("event").isin("hit", "miss", *STORED)).groupBy("seq").agg(
        F.bool_or(F.col("event") == "hit").alias("hit"), F.bool_or(F.col("event").isin(*STORED)).alias("stored"))
    out = requests.join(found, "seq").withColumn("_store", F.when(F.col("stored"), F.struct("seq", "ts")))
    # Nobody overwrites between a store and the hits on it, so the last store before a hit is the one that serves it.
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_from", F.when(F.col("hit"), F.last("_store", ignorenulls=True).over(before)))
    age = http.age_seconds(F.timestamp_micros(F.floor(F.col("ts") / 1000)), F.timestamp_micros(F.floor(F.col("_from.ts") / 1000)))
    date = F.date_format(F.to_utc_timestamp(F.timestamp_micros(F.floor(F.col("_from.ts") / 1000)), F.current_timezone()), RFC3339)
    mark = F.when(F.col("hit"), F.create_map(F.lit(config.hit_header), F.lit("HIT"), F.lit("X-Cache-Date"), date, F.lit("X-Cache-Age"), F.concat(age.cast("string"), F.lit("s"))))
    mark = mark.otherwise(F.create_map(F.lit(config.miss_header), F.lit("MISS")))
    return out.withColumns({"version": F.col("_from.seq"), "age": age, "cache_headers": mark}).drop("_store", "_from")


def on_hit(requests: DataFrame) -> DataFrame:
    """The hooks see keys, in the order of seq: hits, misses, and what is stored with its TTL."""
    return requests.where("hit").select("seq", "key")


def on_miss(requests: DataFrame) -> DataFrame:
    return requests.where("NOT hit").select("seq", "key")


def on_set(requests: DataFrame) -> DataFrame:
    return requests.where("stored").select("seq", "key", "ttl_ns")


def index(requests: DataFrame, log: DataFrame) -> DataFrame:
    """The index of paths at the end: (key, version, norm) of every stored response that no removal took away. A removal
    takes the version that was stored last before it, so a late one leaves a newer response in place."""
    events = log.where(F.col("event").isin(*STORED, *replay.REMOVED))
    # In one operation a lookup may drop what has expired, then comes the store, and then a removal that it causes.
    step = F.when(F.col("event") == "expired", 0).when(F.col("event").isin(*STORED), 1).otherwise(2)
    order = Window.partitionBy("key").orderBy("seq", step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = F.when(F.col("event").isin(*STORED), F.col("seq"))
    events = events.withColumn("version", F.last(kind, ignorenulls=True).over(order))
    last = events.groupBy("key").agg(F.max_by(F.struct("event", "version"), F.struct("seq", step)).alias("e"))
    live = last.where(F.col("e.event").isin(*STORED)).select(F.col("e.version").alias("seq"))
    return requests.join(live, "seq").select("key", F.col("seq").alias("version"), http.normalized(http.path_of_key(F.col("key"))).alias("norm"))


def invalidated(indexed: DataFrame, pattern: str) -> DataFrame:
    return indexed.where(http.invalidates(pattern, F.col("norm")))
