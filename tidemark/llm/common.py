"""Shared helpers of the corpus operators: table access, tables in the shared folder, samples, raw-byte batches."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"  # the separators of words, as a Java regex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured a local master gets one of its own (tests,
    benchmarks); a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df once to the shared folder and read it back: later stages survive lost executors and never recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``saved`` has written, once nothing reads it any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "_saved_at", None)):
            remove(t.sparkSession, path)


def crc32_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def crc32_mod_py(doc_id: int | None, m: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def hashed(*cols) -> Column:
    """Uniform in 0..1 by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def label_counts(rows: DataFrame, label: str) -> dict:
    return {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def sample_texts(rows: DataFrame, label: str, counts: dict, most: int, longest: int) -> dict:
    """At most ``most`` texts a label (at most ``longest`` bytes of each), for learning only: {label: [(h, bytes)]} in
    the order of a hash of id and text. Rows of equal id and text count once, null texts not at all. counts: about how
    many rows each label has."""
    rows = rows.where(F.col("text").isNotNull())
    h = hashed("doc_id", "text")
    share = F.lit(None).cast("double")
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(2.0 * most / n)).otherwise(share)
    some = rows.withColumn("h", h).where(F.col("h") < share)
    some = some.select(label, "h", F.substring(F.col("text").cast("binary"), 1, longest).alias("x"))
    some = some.groupBy(label, "h").agg(F.min("x").alias("x"))  # about 2 * most rows a label, whatever repeats
    place = F.row_number().over(Window.partitionBy(label).orderBy("h"))
    out: dict = {value: [] for value in counts}
    for r in some.withColumn("place", place).where(F.col("place") <= most).select(label, "h", "x").collect():
        out[r[label]].append((r["h"], bytes(r["x"])))
    return {value: sorted(texts) for value, texts in out.items()}


def text_bytes(batch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column of an Arrow batch; null is empty."""
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [b"" if x is None else x for x in col.to_pylist()]
