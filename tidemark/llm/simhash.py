"""Document fingerprints by SimHash (DataFrame operations only).

Every word votes with its weight on BITS signed bits of its hash; a bit of the fingerprint is set where the weights of
set bits outweigh the others. Votes are summed in lanes of 21 bits, three to a long, over runs of RUN words (so that
no lane can overflow in a text of any length), and the runs' sums are added up unpacked. All words of a text lie in
one row, so the sums are complete before anything is shuffled.

``near_pairs`` finds all pairs of distinct fingerprints within a Hamming radius r: the bits are cut into r + 2 blocks,
of which a pair within the radius shares at least two; for each choice of two blocks there is one table keyed by them
(the fingerprint permuted to have them in front), and a pair is verified in the first table it meets in. A key that more
than CROWD distinct fingerprints share is crowded: its members are dealt anew by each of r + 1 combs of bits, one of which a
pair within the radius shares as well, so no key gathers what merely shares two blocks. Equal
fingerprints are one row with a count from the start. The report gives each document the number of documents within
the radius.

Defined cases: a null or empty text votes with one empty word; equal texts have equal fingerprints; a bit on which the
votes tie is 0; documents with equal ids (or null ones, which come last) follow each other by text hash, and equal rows
in any order; a single document is its own next; very long texts are summed up in runs; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, saved

BITS = 128
LANES = 3
RUN = 100_000  # words whose weights (19 at most) fit a lane of 21 bits
RADIUS = 3  # bits in which near fingerprints differ at most
CROWD = 256  # distinct fingerprints of a block key from which it is dealt anew
CELL = 4096  # documents in a range of ids on average
HINT_CELLS = 1_000_000  # cells up to which their first ids (16 bytes each) are broadcast


def weight(word: Column) -> Column:
    """1 to 19 by length: short words are mostly function words that all texts of a language share."""
    return (F.lit(1) + F.lit(3) * F.greatest(F.lit(0), F.least(F.length(word), F.lit(9)) - 3)).cast("long")


def _bit(j: int) -> Column:
    return F.shiftright(F.col(f"_h{j // 64}"), j % 64).bitwiseAND(F.lit(1).cast("long"))


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """texts: keys (unique together) and ``text`` -> keys, hi, lo (longs)."""
    words = texts.select(*keys, F.posexplode(F.split("text", WHITE)).alias("_pos", "_w"))
    words = words.select(
        *keys,
        F.floor(F.col("_pos") / RUN).cast("int").alias("_run"),
        F.xxhash64("_w").alias("_h0"),
        F.xxhash64("_w", F.lit(1)).alias("_h1"),
        weight(F.col("_w")).alias("_v"),
    )
    lanes = []
    for k in range(0, BITS, LANES):
        packed = _bit(k)
        for i in range(1, min(LANES, BITS - k)):
            packed = packed.bitwiseOR(F.shiftleft(_bit(k + i), 21 * i))
        lanes.append(F.sum(packed * F.col("_v")).alias(f"_s{k // LANES}"))
    sums = words.groupBy(*keys, "_run").agg(F.sum("_v").alias("_all"), *lanes)
    low = F.lit((1 << 21) - 1)
    votes = [F.sum(F.shiftright(F.col(f"_s{j // LANES}"), 21 * (j % LANES)).bitwiseAND(low)).alias(f"_b{j}") for j in range(BITS)]
    total = sums.groupBy(*keys).agg(F.sum("_all").alias("_all"), *votes)

    def half(first: int) -> Column:
        out = F.lit(0).cast("long")
        for j in range(64):
            value = (1 << j) - (1 << 64 if j == 63 else 0)
            out = out.bitwiseOR(F.when(F.col(f"_b{first + j}") * 2 > F.col("_all"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return total.select(*keys, half(0).alias("hi"), half(64).alias("lo"))


def text_of(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """1 for equal fingerprints, 0 from half of the bits (unrelated texts) on."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance(a, b) * 2.0 / BITS)


def block(hi: Column, lo: Column, k: int, radius: int) -> Column:
    """The k-th of radius + 2 blocks of the bits, from the highest on, as a number."""
    size = -(-BITS // (radius + 2))
    high, low = BITS - k * size, max(0, BITS - (k + 1) * size)  # bits from low up to high, counted from the lowest
    mask = F.lit((1 << (high - low)) - 1).cast("long")
    if low >= 64:
        return F.shiftrightunsigned(hi, low - 64).bitwiseAND(mask)
    own = F.shiftrightunsigned(lo, low)
    return (own if high <= 64 else own.bitwiseOR(F.shiftleft(hi, 64 - low))).bitwiseAND(mask)


def block_keys(radius: int) -> Column:
    """A key for each table: two of the blocks, and which."""
    own = [block(F.col("hi"), F.col("lo"), k, radius) for k in range(radius + 2)]
    return F.array(*[F.xxhash64(F.lit(t), own[i], own[j]) for t, (i, j) in enumerate(combinations(range(radius + 2), 2))])


def comb(u: int, radius: int) -> Column:
    """Every (radius + 1)-th bit of a long from the u-th on."""
    mask = sum(1 << j for j in range(u, 64, radius + 1))
    return F.lit(mask - (1 << 64 if mask >> 63 else 0)).cast("long")


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of distinct fingerprints (a_hi, a_lo) < (b_hi, b_lo) within the radius, and their distance."""
    hi, lo = F.col("hi"), F.col("lo")
    rows = prints.select("hi", "lo").distinct().select("hi", "lo", F.posexplode(block_keys(radius)).alias("t", "key"))
    crowded = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > CROWD)
    crowded = saved(crowded.select("t", "key", F.lit(True).alias("crowded")), "crowded")
    many = crowded.count()
    if many:
        rows = rows.join(F.broadcast(crowded) if many <= HINT_CELLS else crowded, ["t", "key"], "left")
        parts = [F.xxhash64(F.lit(u), hi.bitwiseAND(comb(u, radius)), lo.bitwiseAND(comb(u, radius))) for u in range(radius + 1)]
        again = F.when(F.col("crowded"), F.array(*parts)).otherwise(F.array(F.lit(0).cast("long")))
        rows = rows.select("hi", "lo", "t", "key", F.col("crowded").isNotNull().alias("crowded"), F.posexplode(again).alias("u", "sub"))
    else:
        rows = rows.select("hi", "lo", "t", "key", F.lit(False).alias("crowded"), F.lit(0).alias("u"), F.lit(0).cast("long").alias("sub"))
    a = rows.select("t", "key", "u", "sub", "crowded", hi.alias("a_hi"), lo.alias("a_lo"))
    b = rows.select("t", "key", "u", "sub", hi.alias("b_hi"), lo.alias("b_lo"))
    met = a.join(b, ["t", "key", "u", "sub"]).where(F.struct("a_hi", "a_lo") < F.struct("b_hi", "b_lo"))
    d = distance((F.col("a_hi"), F.col("a_lo")), (F.col("b_hi"), F.col("b_lo")))
    met = met.withColumn("distance", d).where(F.col("distance") <= radius)
    # A pair counts in the first table, and the first part of a crowded key, that it meets in.
    x, y = F.col("a_hi").bitwiseXOR(F.col("b_hi")), F.col("a_lo").bitwiseXOR(F.col("b_lo"))
    same = [block(x, y, k, radius) == 0 for k in range(radius + 2)]
    table, part = F, F
    for t, (i, j) in enumerate(combinations(range(radius + 2), 2)):
        table = table.when(same[i] & same[j], t)
    for u in range(radius + 1):
        part = part.when((x.bitwiseAND(comb(u, radius)) == 0) & (y.bitwiseAND(comb(u, radius)) == 0), u)
    first = (table == F.col("t")) & (~F.col("crowded") | (part == F.col("u")))
    return met.where(first).select("a_hi", "a_lo", "b_hi", "b_lo", "distance")


def near_counts(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: hi, lo, a row a document -> hi, lo, near (documents within the radius, one of its own not counted), for
    fingerprints that have any."""
    own = prints.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"))
    pairs = near_pairs(own, radius)
    sides = pairs.selectExpr("a_hi AS hi", "a_lo AS lo", "b_hi AS o_hi", "b_lo AS o_lo")
    sides = sides.unionByName(pairs.selectExpr("b_hi AS hi", "b_lo AS lo", "a_hi AS o_hi", "a_lo AS o_lo"))
    other = own.select(F.col("hi").alias("o_hi"), F.col("lo").alias("o_lo"), "n")
    found = sides.join(other, ["o_hi", "o_lo"]).select("hi", "lo", "n")
    found = found.unionByName(own.where("n > 1").select("hi", "lo", (F.col("n") - 1).alias("n")))
    return found.groupBy("hi", "lo").agg(F.sum("n").alias("near"))


def in_cells(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, h) plus ``cell``, an array of numbers that grows with the place in ascending order.

    Ids are dealt into equal ranges of CELL documents on average. Ranges of more than four times as many are divided by
    their own least and greatest id until there are none; what then is too full has one id (or none), and is divided by
    text hash, greatest first.
    """
    whole = F.col("doc_id").cast("decimal(20,0)")

    def place(lo: Column, hi: Column, n: Column) -> Column:
        parts = F.ceil(n / CELL).cast("decimal(20,0)")
        return F.try_divide((whole - lo) * parts, hi - lo + 1)

    def measured(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"), F.count(F.lit(1)).alias("n"))

    span = measured(rows.select("doc_id")).first()
    low, high, n = (F.lit(x) for x in (span["lo"] or 0, span["hi"] or 0, span["n"]))
    first = F.floor(place(low.cast("decimal(20,0)"), high.cast("decimal(20,0)"), n)).cast("long")
    rows = rows.withColumn("cell", F.array(F.coalesce(first, F.lit(-1).cast("long"))))
    while True:
        full = saved(measured(rows.select("cell", "doc_id"), "cell").where(F.col("n") > 4 * CELL), "full")
        many = full.count()
        if not many:
            return rows
        full = F.broadcast(full) if many <= HINT_CELLS else full
        ids_differ = full.where("lo < hi")
        rows = rows.join(full, "cell", "left")
        if ids_differ.isEmpty():
            turned = (F.lit(str(1 << 63)).cast("decimal(20,0)") - F.col("h").cast("decimal(20,0)")) * F.ceil(F.col("n") / CELL).cast("decimal(10,0)")
            more = F.floor(turned / F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("long")
            return rows.withColumn("cell", F.when(F.col("n").isNotNull(), F.concat("cell", F.array(more))).otherwise(F.col("cell"))).drop("lo", "hi", "n")
        more = F.floor(place(F.col("lo"), F.col("hi"), F.col("n"))).cast("long")
        rows = rows.withColumn("cell", F.when(F.col("lo") < F.col("hi"), F.concat("cell", F.array(more))).otherwise(F.col("cell"))).drop("lo", "hi", "n")


def in_order(docs: DataFrame) -> DataFrame:
    """cell, rn, last, doc_id, text, next (the text of the next document by descending id).

    Every cell ends with a copy of the first document of the next lower cell (``last`` is true), so one window a cell
    sees every follower and texts are shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = in_cells(rows.withColumn("h", F.xxhash64("text")))
    tops = saved(rows.groupBy("cell").agg(F.max("doc_id").alias("top")), "tops")  # about n / CELL rows
    order = Window.orderBy(F.desc("cell"))
    ring = tops.select(
        F.col("cell").alias("end_of"),
        F.coalesce(F.lead("cell").over(order), F.first("cell").over(order)).alias("cell"),
    )
    tops = tops.join(ring, "cell")
    if tops.count() <= HINT_CELLS:
        tops = F.broadcast(tops)
    firsts = rows.join(tops, (rows["cell"] == tops["cell"]) & rows["doc_id"].eqNullSafe(tops["top"]))
    firsts = firsts.groupBy("end_of").agg(F.min(F.struct("h", "text")).alias("x"))
    ends = firsts.select(F.col("end_of").alias("cell"), F.lit(None).cast("long").alias("doc_id"), F.col("x.text").alias("text"), F.col("x.h").alias("h"), F.lit(True).alias("last"))
    both = rows.select("cell", "doc_id", "text", "h", F.lit(False).alias("last")).unionByName(ends)
    w = Window.partitionBy("cell").orderBy("last", F.desc_nulls_last("doc_id"), "h")
    return both.select("cell", F.row_number().over(w).alias("rn"), "last", "doc_id", "text", F.lead("text").over(w).alias("next"))


def report(docs: DataFrame) -> DataFrame:
    rows = in_order(docs)
    n = F.length("text")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")),
        F.substring(F.col("next"), F.lit(1), F.floor(n / 3).cast("int")),
    )
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.when(~F.col("last"), edited))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    sides = F.array(
        F.struct(F.lit(False).alias("is_edit"), F.col("text").alias("text")),
        F.struct(F.lit(True).alias("is_edit"), F.col("edited").alias("text")),
    )
    keys = ["cell", "rn", "last", "doc_id", "n_chars", "sha"]
    both = rows.select(*keys, F.explode(sides).alias("x")).select(*keys, "x.is_edit", "x.text").where(F.col("text").isNotNull())
    prints = fingerprints(both, [*keys, "is_edit"])
    one = prints.groupBy(*keys).agg(
        *[F.max(F.when(F.col("is_edit") == e, F.col(c))).alias(f"{p}_{c}") for e, p in ((False, "own"), (True, "edit")) for c in ("hi", "lo")]
    )
    w = Window.partitionBy("cell").orderBy("rn")
    one = one.withColumn("next_hi", F.lead("own_hi").over(w)).withColumn("next_lo", F.lead("own_lo").over(w))
    one = saved(one.where(~F.col("last")).drop("cell", "rn", "last"), "prints")
    near = near_counts(one.select(F.col("own_hi").alias("hi"), F.col("own_lo").alias("lo")))
    one = one.join(near, (one["own_hi"] == near["hi"]) & (one["own_lo"] == near["lo"]), "left")
    own, edit, nxt = ((F.col(f"{p}_hi"), F.col(f"{p}_lo")) for p in ("own", "edit", "next"))
    return one.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        text_of(*own).alias("fingerprint"),
        text_of(*edit).alias("edited_fingerprint"),
        likeness(own, edit).alias("near_edited"),
        likeness(own, nxt).alias("near_next"),
        F.coalesce("near", F.lit(0)).cast("long").alias("near_docs"),
    )
