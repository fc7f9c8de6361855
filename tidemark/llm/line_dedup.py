"""Line dedup over levelled sorted runs of line hashes (DataFrame operations only).

The key of a line is the line without ASCII white space at both ends, A-Z lower-cased, held as a 128-bit hash. Documents
arrive in batches. A batch counts, for each key, the documents that hold it; merge-anti-joins the keys that the runs
have already settled (counted often enough to be dropped, which no later batch can undo); and adds the rest as a
sorted run of level 0. When a level holds FANOUT runs they are compacted into one run of the next level. Runs are
bucketed and sorted by key in the shared folder, so joins and compactions between them merge without a shuffle.
A key counted in at least ``min_docs`` documents loses its lines in every document. The frequent keys are then written
as a plain table and the runs removed, so that the join of all lines with them shuffles both sides and a line that most
documents hold is split by adaptive execution.

Defined cases: a null or empty text is one empty line; keys of fewer than ``min_key`` code points are never dropped; a
line repeated in one document counts that document once; repeated rows (equal ids too) count as documents of their
own; a key in exactly ``min_docs`` documents is frequent; very long texts are split inside their row; an empty table
gives an empty result; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, remove, saved, shared_dir

MIN_DOCS = 10
BATCHES = 4  # batches that a whole table is dealt into
FANOUT = 2  # runs of a level that are compacted into one
EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), ASCII_UPPER, ASCII_LOWER)


def hashes(key: Column) -> list[Column]:
    """Two chained 64-bit hashes: 128 bits, so that distinct keys stay distinct at any corpus size."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key, F.lit(11)).alias("h2")]


class Runs:
    """The levelled runs: a list of (level, bucketed table of h1, h2, n), each in a folder of its own name."""

    def __init__(self, spark: SparkSession, min_docs: int, buckets: int):
        self.spark, self.min_docs, self.buckets = spark, min_docs, buckets
        self.levels: list[tuple[int, str]] = []

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"tidemark_run_{uuid.uuid4().hex}"
        path = self._folder(name)
        (
            run.repartition(self.buckets, "h1", "h2")
            .write.bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .option("path", path)
            .saveAsTable(name)
        )
        self.levels.append((level, name))

    def _folder(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/tidemark/{name}"

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, self._folder(name))

    def merged(self, names: list[str]) -> DataFrame:
        """One row a key over some runs; bucketed alike, so the sum needs no shuffle."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        return out.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def settled(self) -> list[DataFrame]:
        """The keys that one run alone has counted often enough."""
        return [self.spark.table(name).where(F.col("n") >= self.min_docs).select("h1", "h2") for _, name in self.levels]

    def add(self, batch: DataFrame) -> None:
        """batch: rows (h1, h2), one for each document and key."""
        own = batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        for keys in self.settled():
            own = own.join(keys.hint("merge"), ["h1", "h2"], "left_anti")
        self._write(own, 0)
        level = 0
        while len(same := [n for lv, n in self.levels if lv == level]) >= FANOUT:
            self.levels = [(lv, n) for lv, n in self.levels if lv != level]
            level += 1
            self._write(self.merged(same), level)
            self._drop(same)

    def frequent(self) -> DataFrame:
        """The frequent keys as a table of their own; ends the runs."""
        names = [n for _, n in self.levels]
        out = saved(self.merged(names).where(F.col("n") >= self.min_docs).select("h1", "h2"), "frequent")
        self.levels = []
        self._drop(names)
        return out


def decide(docs: DataFrame, min_docs: int = MIN_DOCS, min_key: int = 1) -> DataFrame:
    """``_l_row`` (a row of docs as a struct), ``_l_text``, ``_l_lines`` (array) and ``_l_kept`` (the kept lines)."""
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("_l_row"), F.col("doc_id").alias("_l_own"), F.coalesce("text", F.lit("")).alias("_l_text"))
    # Equal doc_ids stay apart by content; equal contents of an id lose the same lines.
    keyed = rows.select(
        F.col("_l_own").alias("doc_id"),
        F.xxhash64("_l_text").alias("sig"),
        F.transform(F.split("_l_text", "\n"), key_of).alias("keys"),
    )
    at_least = F.lit(max(1, min_key))
    log = saved(
        keyed.select(
            F.pmod(F.xxhash64("doc_id", "sig"), F.lit(BATCHES)).cast("int").alias("batch"),
            F.explode(F.array_distinct(F.filter("keys", lambda k: F.length(k) >= at_least))).alias("key"),
        ).select("batch", *hashes(F.col("key"))),
        "lines",
    )
    runs = Runs(spark, min_docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k in range(BATCHES):
        runs.add(log.where(F.col("batch") == k).select("h1", "h2"))
    frequent = runs.frequent()
    discard(log)
    places = keyed.select("doc_id", "sig", F.posexplode("keys").alias("pos", "key")).where(F.length("key") >= at_least)
    places = places.select("doc_id", "sig", "pos", *hashes(F.col("key")))
    drops = (
        places.join(frequent, ["h1", "h2"])
        .groupBy(F.col("doc_id").alias("_l_id"), F.col("sig").alias("_l_sig"))
        .agg(F.collect_set("pos").alias("_l_drop"))  # a set: repeated rows add nothing to it
    )
    same = F.col("_l_own").eqNullSafe(F.col("_l_id")) & (F.xxhash64("_l_text") == F.col("_l_sig"))
    out = rows.join(drops, same, "left").withColumn("_l_lines", F.split("_l_text", "\n"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("_l_lines") - 1), F.col("_l_drop"))
    kept = F.when(F.col("_l_drop").isNull(), F.col("_l_lines")).otherwise(
        F.transform(keep, lambda i: F.get(F.col("_l_lines"), i))
    )
    return out.withColumn("_l_kept", kept)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_key: int = 1) -> DataFrame:
    """docs with the lines of frequent keys gone from text; n_chars, if there is one, counts the new text."""
    out = decide(docs, min_docs, min_key)
    cut = F.size("_l_kept") < F.size("_l_lines")
    own = {c: F.col("_l_row").getField(c) for c in docs.columns}
    text = F.when(cut, F.array_join("_l_kept", "\n")).otherwise(own["text"])
    if "n_chars" in own:
        own["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return out.select(*[v.alias(k) for k, v in (own | {"text": text}).items()])


def report(docs: DataFrame) -> DataFrame:
    out = decide(docs.select("doc_id", "text"))
    n, kept = F.size("_l_lines"), F.size("_l_kept")
    text = F.when(kept < n, F.array_join("_l_kept", "\n")).otherwise(F.col("_l_text"))
    return out.select(
        F.col("_l_own").alias("doc_id"),
        n.cast("long").alias("n_lines"),
        (n - kept).cast("long").alias("n_dropped"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )
