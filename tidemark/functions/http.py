"""Response-cache rules as columns: keys, cacheability and TTL, path normalization and invalidation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
VARY = ("Accept", "Accept-Encoding", "Authorization", "Accept-Language")
VARY_HASHED = ("Accept", "Accept-Encoding", "Authorization")
METHODS = ("GET", "HEAD")
STATUSES = (200, 201, 300, 301, 302, 304, 404, 410)
IGNORED = ("Date", "Server", "X-Request-Id", "X-Trace-Id")
FORBIDDING = ("no-cache", "no-store", "private")
MAX_BODY = 10 * 1024 * 1024
DEFAULT_TTL_NS = 300 * 1_000_000_000
MAX_SIZE, SHARDS, HIT_HEADER = 100_000, 16, "X-Cache"


def _header(headers: Column, name: str) -> Column:
    """First value of a header, names without regard to case; empty if it is missing."""
    hit = F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name.lower()))
    return F.coalesce(F.get(hit, F.lit(0)), F.lit(""))


def _hashed(first: list[Column], parts: list[Column]) -> Column:
    return F.md5(F.concat(*[F.coalesce(x, F.lit("")) for x in [*first, *parts]]))


def _vary(headers: Column, names) -> list[Column]:
    return [F.when(_header(headers, n) != "", F.concat(F.lit(f"{n}:"), _header(headers, n))).otherwise("") for n in names]


def default_key(method: Column, url: Column, headers: Column) -> Column:
    return _hashed([method, url], _vary(headers, VARY))


def vary_key(method: Column, url: Column, headers: Column, names) -> Column:
    return _hashed([method, url], _vary(headers, names))


def path_hashed_key(method: Column, path: Column, headers: Column) -> Column:
    return _hashed([method, path], _vary(headers, VARY_HASHED))


def user_key(method: Column, url: Column, headers: Column, header: str) -> Column:
    user = _header(headers, header)
    return _hashed([method, url], [F.when(user != "", F.concat(F.lit("user:"), user)).otherwise("")])


def path_key(method: Column, path: Column) -> Column:
    return F.concat(method, F.lit(":"), path)


def path_of_key(key: Column) -> Column:
    """What follows the first colon; all of a key without one."""
    return F.when(F.instr(key, ":") > 0, F.substring(key, F.instr(key, ":") + 1, F.length(key))).otherwise(key)


def _directives(cache_control: Column) -> Column:
    return F.transform(F.split(F.coalesce(cache_control, F.lit("")), ","), lambda p: F.trim(p))


def has_directive(cache_control: Column, names=FORBIDDING) -> Column:
    own = F.transform(_directives(cache_control), lambda p: F.lower(F.trim(F.substring_index(p, "=", 1))))
    return F.arrays_overlap(own, F.array(*[F.lit(n) for n in names]))


def max_age_seconds(cache_control: Column) -> Column:
    """The first positive integer max-age, else 0."""
    named = F.filter(_directives(cache_control), lambda p: (F.instr(p, "=") > 0) & (F.lower(F.trim(F.substring_index(p, "=", 1))) == "max-age"))
    values = F.transform(named, lambda p: F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))))
    numbers = F.transform(F.filter(values, lambda v: v.rlike(r"^[+-]?\d{1,18}$")), lambda v: v.cast("long"))
    return F.coalesce(F.get(F.filter(numbers, lambda n: n > 0), F.lit(0)), F.lit(0).cast("long"))


def expires_at(expires: Column) -> Column:
    """The time of an Expires header, which is in GMT whatever the session's zone; null if it is unreadable."""
    found = F.regexp_extract(F.coalesce(expires, F.lit("")), r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) (?:GMT|UTC)$", 1)
    return F.try_to_timestamp(F.concat(found, F.lit(" +00:00")), F.lit("dd MMM yyyy HH:mm:ss XXX"))


def default_policy(
    method: Column, status: Column, cache_control: Column, expires: Column, body_len: Column, now: Column,
    ttl_ns: int = DEFAULT_TTL_NS, methods=METHODS, statuses=STATUSES, max_body: int = MAX_BODY,
) -> Column:
    """TTL in nanoseconds, null where the response isn't cached. max-age=0, a past or an unreadable Expires all fall
    through to the default TTL; s-maxage is ignored; a body limit of 0 means none."""
    allowed = method.isin(*methods) & status.isin(*statuses) & ~has_directive(cache_control)
    if max_body > 0:
        allowed = allowed & (body_len <= max_body)
    age = max_age_seconds(cache_control)
    left = F.unix_micros(expires_at(expires)) - F.unix_micros(now)
    return F.when(allowed, F.when(age > 0, age * 1_000_000_000).when(left > 0, left * 1000).otherwise(F.lit(ttl_ns).cast("long")))


def captured(status: Column, body_len: Column, streamed: Column, max_body: int = MAX_BODY) -> Column:
    """Whether a response's body was captured whole: not flushed or hijacked while it was written, no switch of protocols,
    no interim response, and within the body limit (0: none)."""
    fits = (body_len <= max_body) if max_body > 0 else F.lit(True)
    return ~F.coalesce(streamed, F.lit(False)) & (status >= 200) & fits


def _success(status: Column) -> Column:
    return (status >= 200) & (status < 300)


def always(status: Column, ttl_ns: int) -> Column:
    return F.when(_success(status), F.lit(ttl_ns).cast("long"))


def never() -> Column:
    return F.lit(None).cast("long")


def by_content_type(status: Column, content_type: Column, rules: dict[str, int], default_ns: int) -> Column:
    """Prefix rules, the longest prefix first."""
    chain = F.when(~_success(status), None)
    for prefix in sorted(rules, key=lambda p: (-len(p), p)):
        chain = chain.when(content_type.startswith(prefix), F.lit(rules[prefix]).cast("long"))
    return chain.otherwise(F.lit(default_ns).cast("long"))


def by_size(status: Column, body_len: Column, low: int, high: int, ttl_ns: int) -> Column:
    return F.when(_success(status) & body_len.between(low, high), F.lit(ttl_ns).cast("long"))


def kept_headers(headers: Column, ignored=IGNORED, own=(HIT_HEADER,)) -> Column:
    """Without the ignored and the cache's own headers."""
    dropped = [h.lower() for h in (*ignored, *own, "X-Cache", "X-Cache-Date", "X-Cache-Age") if h]
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*dropped))


def segments(path: Column) -> Column:
    return F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != "")


def normalized(path: Column) -> Column:
    return F.array_join(segments(path), "/")


def invalidates(pattern: str, norm: Column) -> Column:
    """Whether a pattern drops a normalized path: exact, or with one trailing * the node and all below it. Segments are
    whole: /api/us* is /api/us and its children."""
    wild = pattern.endswith("*")
    node = "/".join(x for x in (pattern[:-1] if wild else pattern).split("/") if x)
    if not wild:
        return norm == node
    return F.lit(True) if not node else (norm == node) | norm.startswith(node + "/")


def age_seconds(now: Column, cached_at: Column) -> Column:
    return F.floor((F.unix_micros(now) - F.unix_micros(cached_at)) / 1_000_000)
