"""Cache configuration, its validation, and the errors of the library."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values.
NO_EXPIRATION, DEFAULT_EXPIRATION = -1, 0
SECOND = 1_000_000_000
POLICIES = ("default", "lru", "lfu", "fifo", "sieve")
ADMISSIONS = ("frequency", "balanced", "density")
REASONS = ("capacity", "rejected", "expired", "deleted")
MAX_SHARDS, SHARDS_PER_CPU = 256, 4


class CacheError(Exception):
    """An operation on a cache failed."""

    def __init__(self, op: str, key, cause: Exception):
        super().__init__(f"{op} {key!r}: {cause}")
        self.op, self.key, self.__cause__ = op, key, cause


class ConfigError(ValueError):
    def __init__(self, field: str, value, reason: str):
        super().__init__(f"{field}={value!r}: {reason}")
        self.field, self.value, self.reason = field, value, reason


class CacheExists(Exception):
    """A name is registered already."""


class CacheNotRegistered(Exception):
    """A name is not registered."""


class CacheTypeMismatch(Exception):
    """A name is bound to another key or value type."""


class CacheClosed(Exception):
    """Writes after close."""


class InvalidCost(ValueError):
    """A weigher gave a negative cost."""


class ItemTooLarge(ValueError):
    """An item's cost is over its shard's budget."""


class InvalidSize(ValueError):
    """A limit that no shard can hold."""


@dataclass(frozen=True)
class CacheConfig:
    """Limits and policy of one cache; times in nanoseconds, 0 means unlimited (sizes) or default (ratios)."""

    max_size: int = 10_000
    max_cost: int = 0
    shard_count: int = 0
    cleanup_interval_ns: int = 300 * SECOND
    default_ttl_ns: int = 1800 * SECOND
    policy: str = "sieve"
    stats_enabled: bool = False
    probation_ratio: int = 1
    ghost_ratio: int = 75
    cost_admission: str = "frequency"
    write_buffer_size: int = 256
    write_batch_size: int = 64

    def validate(self) -> CacheConfig:
        for field in ("max_size", "max_cost", "shard_count", "cleanup_interval_ns"):
            if getattr(self, field) < 0:
                raise ConfigError(field, getattr(self, field), "must be >= 0")
        if self.default_ttl_ns < 0 and self.default_ttl_ns != NO_EXPIRATION:
            raise ConfigError("default_ttl_ns", self.default_ttl_ns, "must be >= 0 or NO_EXPIRATION")
        if self.policy not in POLICIES:
            raise ConfigError("policy", self.policy, f"must be one of {', '.join(POLICIES)}")
        if self.policy in ("default", "sieve") and self.max_size <= 0 < self.max_cost:
            raise ConfigError("max_size", self.max_size, "must be > 0 for sieve when max_cost is set")
        if self.cost_admission not in ADMISSIONS:
            raise ConfigError("cost_admission", self.cost_admission, f"must be one of {', '.join(ADMISSIONS)}")
        for field in ("probation_ratio", "ghost_ratio"):
            if not 0 <= getattr(self, field) <= 100:
                raise ConfigError(field, getattr(self, field), "must be <= 100")
        for field in ("write_buffer_size", "write_batch_size"):
            if getattr(self, field) < 0:
                raise ConfigError(field, getattr(self, field), "must be >= 0")
        return self

    def resolved(self, cpus: int = 8) -> CacheConfig:
        """With every default filled in; the shard count is part of a replay's identity."""
        self.validate()
        return replace(
            self,
            policy="sieve" if self.policy == "default" else self.policy,
            shard_count=shard_count(self.shard_count, self.max_size, self.max_cost, cpus),
            probation_ratio=self.probation_ratio or 1,
            ghost_ratio=self.ghost_ratio or 75,
            write_buffer_size=self.write_buffer_size or 256,
            write_batch_size=self.write_batch_size or 64,
        )

    @property
    def tracks_cost(self) -> bool:
        return self.max_cost > 0 or self.cost_admission != "frequency"


def shard_count(asked: int, max_size: int, max_cost: int, cpus: int) -> int:
    """A power of two: as asked or by CPUs, and never more shards than the limits can fill."""
    n = asked if asked > 0 else min(cpus * SHARDS_PER_CPU, MAX_SHARDS)
    for limit in (max_size, max_cost):
        if limit > 0:
            n = min(n, 1 << (min(limit, MAX_SHARDS).bit_length() - 1))
    return 1 << max(0, n - 1).bit_length() if n > 1 else 1


def split(limit: int, shards: int) -> list[int]:
    """A limit dealt over shards: the first ones take the remainder."""
    return [limit // shards + (i < limit % shards) for i in range(shards)]
