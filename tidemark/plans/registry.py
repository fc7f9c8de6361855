"""Named caches: configurations bound to names, and traces replayed under them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.config import CacheConfig, CacheExists, CacheNotRegistered, CacheTypeMismatch
from tidemark.operators import replay


class Registry:
    """register, get (created on first use), get with a configuration, remove, close all, statistics of all."""

    def __init__(self):
        self.configs: dict[str, tuple[CacheConfig, str]] = {}
        self.live: dict[str, CacheConfig] = {}

    def register(self, name: str, config: CacheConfig | None = None, key_type: str = "bigint") -> None:
        if name in self.configs:
            raise CacheExists(name)
        self.configs[name] = ((config or CacheConfig()).validate(), key_type)

    def get(self, name: str, key_type: str = "bigint") -> CacheConfig:
        if name not in self.configs:
            raise CacheNotRegistered(name)
        config, kind = self.configs[name]
        if kind != key_type:
            raise CacheTypeMismatch(f"{name} has keys of type {kind}")
        return self.live.setdefault(name, config.resolved())

    def get_with(self, name: str, config: CacheConfig, key_type: str = "bigint") -> CacheConfig:
        """A live cache's own configuration wins over the one given."""
        if name not in self.configs:
            self.register(name, config, key_type)
        return self.get(name, key_type)

    def remove(self, name: str) -> None:
        self.configs.pop(name, None)
        self.live.pop(name, None)

    def close_all(self) -> None:
        """Registrations stay."""
        self.live.clear()

    def stats(self, ops: DataFrame) -> DataFrame:
        """Statistics of every live cache over its part of a trace, in one pass."""
        if not self.live:
            raise CacheNotRegistered("no live cache")
        return replay.stats(replay.replay(ops, dict(self.live), detail=False), self.live)


default = Registry()
register, get, get_with, remove, close_all, stats = default.register, default.get, default.get_with, default.remove, default.close_all, default.stats
