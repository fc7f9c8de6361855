"""Quality rules as a short-circuit cascade (DataFrame expressions only).

A rule is a boolean column that says "reject". The cascade estimates on a bounded sample of raw texts what each rule
costs, together with the counts that it needs, and how often it rejects, and orders the rules, the base rule among them,
by rejection per cost. They are evaluated in one CASE expression: the first rule that rejects a document ends its
evaluation. ``keep_good`` needs no counts, so it looks for repeated windows, by far the dearest count, only in documents
that the rules before the base rule left. The verdict is the disjunction of all rules, so the order changes the work and
never the result.

Defined cases: a null or empty text has no words, fails the base rule and is rejected; an empty table gives an empty
result; repeated rows are judged one by one; ties (a count exactly at its limit) are kept; very long texts are counted
inside their row; further columns, whatever their names, are left out of the report and kept by ``keep_good``.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE

WINDOW = 5  # words in a repeated window
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 512  # expected rows in the sample that orders the rules; results don't depend on it
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def counts(docs: DataFrame, rejected: Column | None = None) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_upper (all long, prefixed
    ``_q_``); everything happens inside the row, nothing is shuffled. Where ``rejected``, a condition on the other
    counts, holds, no windows are looked at and n_repeat_words is 0."""
    out = docs.withColumn("_q_text", F.coalesce("text", F.lit("")))
    out = out.withColumn("_q_words", F.array_remove(F.split("_q_text", WHITE), ""))
    out = out.withColumn(
        "_q_lines", F.filter(F.split("_q_text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    )
    out = out.withColumn("_q_n_words", F.size("_q_words").cast("long"))
    text = F.col("_q_text")
    out = (
        out.withColumn("_q_word_chars", (F.length(text) - _without(text, " \t\n\x0b\x0c\r")).cast("long"))
        .withColumn("_q_n_symbols", _without(text, SYMBOLS).cast("long"))
        .withColumn("_q_n_lines", F.size("_q_lines").cast("long"))
        .withColumn("_q_n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"))
    )
    # Each window of five words is one 64-bit hash, chained over its words.
    words = F.col("_q_words") if rejected is None else F.when(~rejected, F.col("_q_words"))
    out = out.withColumn("_q_hash", F.transform(words, lambda w: F.xxhash64(w)))
    out = out.withColumn(
        "_q_grams",
        F.when(
            F.size("_q_hash") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("_q_hash") - WINDOW),
                lambda i: F.xxhash64(*[F.get(F.col("_q_hash"), i + k) for k in range(WINDOW)]),
            ),
        ),
    )
    # Most texts repeat no window: one hash-set pass finds that out, and only the rest are sorted.
    repeats = F.size(F.array_distinct("_q_grams")) < F.size("_q_grams")
    out = out.withColumn(
        "_q_sorted",
        F.when(repeats, F.sort_array(F.transform("_q_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))),
    )
    s = F.col("_q_sorted")

    def starts(x: Column, k: Column) -> Column:
        same = F.get(s, k - 1)["g"].eqNullSafe(x["g"]) | F.get(s, k + 1)["g"].eqNullSafe(x["g"])
        return F.when(same, x["i"])

    out = out.withColumn("_q_starts", F.sort_array(F.array_compact(F.transform("_q_sorted", starts))))
    covered = F.aggregate(
        "_q_starts",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    out = out.withColumn("_q_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.drop("_q_words", "_q_lines", "_q_hash", "_q_grams", "_q_sorted", "_q_starts")


def base_failed() -> Column:
    n = F.col("_q_n_words")
    return (n < 10) | (F.lit(100) * F.col("_q_n_repeat_words") > F.lit(20) * n)


def rules() -> dict[str, Column]:
    """Published heuristics of web-text filters over the counts: true rejects."""
    n = F.col("_q_n_words")
    return {
        "symbols": F.col("_q_n_symbols") * 10 > n,
        "dup_lines": F.col("_q_n_dup_lines") * 10 > F.col("_q_n_lines") * 3,
        "word_length": (F.col("_q_word_chars") < n * 2) | (F.col("_q_word_chars") > n * 15),
        "capitals": _without(F.col("_q_text"), UPPER) * 2 > F.col("_q_word_chars"),
        "exclaims": _without(F.col("_q_text"), "!") * 3 > n,
    }


BASE = "base"


def cost(probe: DataFrame) -> float:
    """Seconds of a job, the least of three after one that compiles it."""
    probe.first()
    took = []
    for _ in range(3):
        began = time.perf_counter()
        probe.first()
        took.append(time.perf_counter() - began)
    return min(took)


def ordered(docs: DataFrame, total: int, given: dict[str, Column] | None = None) -> list[tuple[str, Column]]:
    """The rules and the base rule by rejections per second of cost, both estimated on a sample of SAMPLE_ROWS rows on
    average, and twice that at most, chosen by a hash of id and text. A rule's cost is that of its own counts too (the
    others' are pruned), above that of reading the sample."""
    given = {BASE: base_failed()} | (given or rules())
    every = max(1, total // SAMPLE_ROWS)
    some = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)
    sample = some.limit(2 * SAMPLE_ROWS).checkpoint()
    idle = cost(sample.agg(F.sum(F.length("text"))))
    worth = {}
    for name, reject in given.items():
        probe = counts(sample).agg(F.count_if(reject).alias("n"), F.count(F.lit(1)).alias("of"))
        seconds = max(cost(probe) - idle, 1e-3)
        n, of = probe.first()
        worth[name] = n / max(1, of) / 4.0 ** round(math.log(seconds, 4))
    return sorted(given.items(), key=lambda x: (-worth[x[0]], x[0]))


def judge(docs: DataFrame, given: dict[str, Column] | None = None, short: bool = False) -> DataFrame:
    """``_q_row`` (a row of docs as a struct), its counts, ``_q_base_failed`` and ``_q_kept``; with ``short``, only
    ``_q_kept`` is to be used."""
    from .common import shared_dir

    shared_dir(docs.sparkSession)
    order = ordered(docs, docs.count(), given)
    rejected = F.lit(False)
    for name, reject in order:
        if name == BASE:
            break
        rejected = rejected | F.coalesce(reject, F.lit(False))
    rows = docs.select(F.struct("*").alias("_q_row"), F.col("text"))
    counted = counts(rows, rejected if short else None)
    verdict = F
    for name, reject in order:
        verdict = verdict.when(F.col("_q_base_failed") if name == BASE else reject, False)
    # A filter on the verdict would be pushed below the counts with all their expressions written out in one another,
    # each many times; the row number beside the verdict, which is not deterministic, keeps it above them.
    judged = counted.withColumn("_q_base_failed", base_failed())
    return judged.withColumns({"_q_kept": verdict.otherwise(True), "_q_number": F.monotonically_increasing_id()})


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the cascade keeps, with their own columns."""
    return judge(docs, short=True).where("_q_kept AND _q_number >= 0").select("_q_row.*")


def report(docs: DataFrame) -> DataFrame:
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    out = judge(docs.select("doc_id", "text"))
    return out.select("_q_row.doc_id", *[F.col(f"_q_{c}").alias(c) for c in own])
