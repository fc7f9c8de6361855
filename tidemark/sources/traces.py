"""Adapters from tables to ordered operation traces: seq, ts (ns), cache, key, op, value, ttl_ns, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.LongType(), False),
        T.StructField("cache", T.StringType(), False),
        T.StructField("key", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("value", T.DoubleType()),
        T.StructField("ttl_ns", T.LongType()),
        T.StructField("cost", T.LongType()),
    ]
)
CLEAR_EVERY = 997
DEFAULT_TTL_NS = 12 * 3600 * 10**9  # of the event caches


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view, click: get; purchase, signup: set; error: delete; every 997th event clears its cache. Three caches."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    kind = F.col("event_type")
    op = (
        F.when(F.col("event_id") % CLEAR_EVERY == 0, "clear")
        .when(kind.isin("view", "click"), "get")
        .when(kind.isin("purchase", "signup"), "set")
        .otherwise("delete")
    )
    ttl = F.when(kind == "purchase", F.lit(24 * 3600 * 10**9)).when(kind == "signup", F.lit(0))
    return e.select(
        F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts"),
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("cache"),
        F.col("user_id").alias("key"),
        op.alias("op"),
        F.col("value"),
        ttl.cast("long").alias("ttl_ns"),
        (F.lit(1) + F.col("event_id") % 7).alias("cost"),
    )


def read_through(df: DataFrame, seq: Column, key: Column, cache: str = "all", cost: Column | None = None) -> DataFrame:
    """An access trace: every access is a get, followed by a set where it misses (the replay does that for op 'access')."""
    null = F.lit(None)
    return df.select(
        seq.cast("long").alias("seq"), F.lit(0).cast("long").alias("ts"), F.lit(cache).alias("cache"), key.cast("long").alias("key"),
        F.lit("access").alias("op"), null.cast("double").alias("value"), F.lit(-1).cast("long").alias("ttl_ns"),
        (F.lit(1) if cost is None else cost).cast("long").alias("cost"),
    )


def event_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return read_through(e, F.col("event_id"), F.col("user_id"), cost=F.lit(1) + F.col("event_id") % 7)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", "url", F.expr("parse_url(url, 'PATH')").alias("path"), F.length("html").cast("long").alias("body_len"))


ROUND_NS, STEP_NS = 200 * 10**9, 10**6


def requests(spark: SparkSession, sf_dir: str, rounds: int = 4) -> DataFrame:
    """A request log over the pages: every page is asked for in ``rounds`` rounds that begin 200 seconds apart, one page each
    millisecond in the order of their ids; method, headers and answers follow from the page id."""
    k = F.col("page_id")
    p = pages(spark, sf_dir).withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long"))))
    headers = F.create_map(F.lit("Accept"), F.when(k % 2 == 0, "text/html").otherwise(""), F.lit("X-User"), (k % 7).cast("string"))

    def pick(values) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))

    return p.select(
        (F.col("round") * 10**9 + k).alias("seq"), (F.col("round") * F.lit(ROUND_NS) + k * F.lit(STEP_NS)).alias("ts"),
        "page_id", "url", "path", "body_len", headers.alias("headers"), (k % 11 == 0).alias("streamed"),
        F.when(k % 10 == 0, "POST").when(k % 3 == 0, "HEAD").otherwise("GET").alias("method"),
        pick(STATUSES).alias("status"), pick(CONTROLS).alias("cache_control"), pick(EXPIRES).alias("expires"), pick(TYPES).alias("content_type"),
    )


STATUSES = [200, 301, 404, 500, 204]
CONTROLS = ["", "max-age=300", "public, max-age=600", "no-cache, max-age=300", "max-age=invalid", "No-Store", "private", "max-age=0", "s-maxage=9", "Max-Age = 60"]
EXPIRES = ["", "Thu, 01 Jan 1970 00:10:00 GMT", "soon"]
TYPES = ["application/json; charset=utf-8", "text/html", "text/plain"]
