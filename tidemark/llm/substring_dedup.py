"""Suffix-array dedup: bytes covered by a string of SIZE bytes that also starts in a document with a smaller id.

1. Every window of SIZE bytes has an anchor, its least hashed substring of ANCHOR bytes (the leftmost of equals). Equal
   windows have equal anchors, so windows only need to meet where their anchor is dealt to. The windows of one anchor
   occurrence form a segment of at most 2 * SIZE - ANCHOR bytes.
2. Anchors are dealt by hash, as (anchor, segment content, document) hashes. Segments of an anchor whose contents agree
   in two independent hashes of 112 bits together are one string from then on, held by their smallest document;
   anchors that occur in one document alone end here.
3. The distinct strings of all other anchors are sent on, and the shards that they form get suffix arrays by induced
   sorting and permuted common prefixes. Neighbours in the array that agree in SIZE bytes are equal windows; the
   smallest document among them keeps its window, and the others lose theirs.
4. An anchor with more than CROWD distinct strings would be a shard of any size. Its strings are cut into windows, which
   are dealt by their own hash; a window comes once from a chunk of texts, its smallest document first.
5. Segments of a content that a smaller document holds lose all windows. The lost ranges are united for each
   document and cut from the text as it was read.

Texts are moved twice, compressed; what moves besides is a few bytes for each anchor. Batches are looked at in slices
of SLICE bytes of text, and a slice sends a content once, from its smallest document. Long texts are read in pieces that
overlap, and partitions are read in the order of their documents, marks before texts, so memory follows PIECE, SLICE and
the longest text.

Defined cases: a null or empty text has no bytes and stays as it is; texts shorter than SIZE lose nothing; rows of equal
id are one document to each other (nothing is cut between them), and equal rows lose the same bytes; a null id neither
loses bytes nor takes them from others; an empty table gives an empty result; other columns, whatever their names, stay
as they are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_bytes

SIZE = 50
ANCHOR = 22
PIECE = 1 << 20  # bytes of a text read at once
GROUP = 1 << 18  # bytes from which on shorter texts are not read together, so that their arrays stay near the processor
SLICE = 4 << 20  # bytes of text whose anchors are sent together (a text's always are)
SHARD = 1 << 20  # bytes of strings that share a suffix array (an anchor's strings always do)
CROWD = 4096  # distinct strings of an anchor that share a suffix array at most
SPREAD = 2  # buckets for each shuffle partition
ODD = 0xD1342543DE82EF95  # multiplier of the second content hash


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(texts: list[bytes]):
    """Groups of (row, offset, bytes) of about GROUP bytes, or one piece; consecutive pieces of a text overlap in SIZE - 1 bytes."""
    group, total = [], 0
    for row, t in enumerate(texts):
        for off in range(0, max(1, len(t) - SIZE + 1), PIECE):
            part = t[off : off + PIECE + SIZE - 1]
            if len(part) >= SIZE:
                group.append((row, off, part))
                total += len(part)
                if total >= min(PIECE, GROUP):
                    yield group
                    group, total = [], 0
    if group:
        yield group


_known: dict = {}  # the longest row of powers of each number so far, and hashes of bytes


def _powers(x: int, n: int):
    """1, x, x * x, ..., modulo 2**64."""
    import numpy as np

    if len(_known.get(x, ())) < n:
        out = np.full(n, x, np.uint64)
        out[:1] = 1
        _known[x] = np.multiply.accumulate(out)
    return _known[x][:n]


def _byte_hashes():
    """Two hashes of each byte."""
    import numpy as np

    if "bytes" not in _known:
        one = _mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED27))
        _known["bytes"] = one, _mix(one ^ np.uint64(0x2545F4914F6CDD1D))
    return _known["bytes"]


def segments(group):
    """Of a group of pieces: row, first byte in the text, number of windows, anchor hash, content hash and a second,
    independent content hash (uint64)."""
    import numpy as np

    raw = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    size = np.array([len(p) for _, _, p in group])
    start = np.cumsum(size) - size
    n = len(raw)
    one, two = (hashes[raw] for hashes in _byte_hashes())
    # Sums of the bytes' values times powers of an odd number: a difference, divided by the first one, is a hash of any
    # substring.
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(two * _powers(ODD, n), out=sums[1:])
    by, x = {}, one
    for k in (1, 2, 4, 8, 16):  # hashes of all substrings of 2, 4, ... 32 bytes; the two longest are kept
        y = np.zeros(n, np.uint64)
        y[: n - k] = x[: n - k] * np.uint64(0x9E3779B97F4A7C15)
        y[: n - k] = (y[: n - k] ^ (y[: n - k] >> np.uint64(29))) + x[k:]
        y *= np.uint64(0xD6E8FEB86659FD93)
        x = y
        if k >= 8:
            by[2 * k] = y
    del one, two, x, y

    def cover(at, length):
        """Hash of the substrings of a length of 17 to 64 bytes from two or three overlapping ones."""
        if length <= 32:
            return _mix(by[16][at] * np.uint64(3) + _mix(by[16][at + length - 16]))
        return _mix(by[32][at] * np.uint64(5) + _mix(by[32][at + length - 32]))

    span = SIZE - ANCHOR + 1
    last = n - ANCHOR + 1
    a = (by[16][:last] * np.uint64(3)) ^ (by[16][ANCHOR - 16 :][:last] * np.uint64(0xA24BAED4963EE407))
    a ^= a >> np.uint64(32)
    a *= np.uint64(0x9FB21C651E98DF25)
    place = np.uint64((1 << 26) - 1)
    a = (a & ~place) | np.arange(last, dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        a = np.minimum(a[:-width], a[width:])
        width *= 2
    if width < span:
        a = np.minimum(a[: len(a) - (span - width)], a[span - width :])
    anchor = (a & place).astype(np.int64)  # of the window at each position
    piece = np.repeat(np.arange(len(group)), size)[: len(anchor)]
    valid = np.arange(len(anchor)) + SIZE <= (start + size)[piece]
    new = valid & np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | ~valid[:-1]]
    first = np.flatnonzero(new)
    windows = np.add.reduceat(valid, first) if len(first) else np.zeros(0, np.int64)
    at = anchor[first]
    key = cover(at, ANCHOR)
    shape = (windows * 64 + (at - first)).astype(np.uint64)
    content = _mix(cover(first, SIZE) * np.uint64(7) + _mix(cover(first + windows - 1, SIZE) + _mix(shape)))
    whole = (sums[first + windows - 1 + SIZE] - sums[first]) * _powers(pow(ODD, -1, 1 << 64), n)[first]
    check = _mix(whole ^ _mix(shape ^ np.uint64(0x9E37)))
    rows = np.array([r for r, _, _ in group])[piece[first]]
    where = first - start[piece[first]] + np.array([o for _, o, _ in group])[piece[first]]
    return rows, where, windows, key, content, check


def all_segments(texts: list[bytes]):
    import numpy as np

    parts = [segments(g) for g in pieces(texts)]
    if not parts:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 3
    cols = list(zip(*parts, strict=True))
    del parts  # a column's parts go as soon as it is put together
    return [np.concatenate(cols.pop(0)) for _ in range(6)]


def firsts(key, content, check, doc):
    """Of rows in any order: an order by anchor, content and document, and which of it begin a content of an anchor."""
    import numpy as np

    order = np.argsort(key)
    k = key[order]
    new = np.r_[True, k[1:] != k[:-1], True] if len(k) else np.ones(1, bool)
    tied = np.flatnonzero(~(new[:-1] & new[1:]))  # rows of an anchor with more than one
    del k, new
    if 2 * len(tied) < len(key):
        some = order[tied]
        order[tied] = some[np.lexsort((doc[some], content[some], key[some]))]
    else:
        order = np.lexsort((doc, content, key))
    k, c, x = key[order], content[order], check[order]
    return order, np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (x[1:] != x[:-1])] if len(k) else np.zeros(0, bool)


def _bytes(x, size: int = 8) -> bytes:
    """The low bytes of each number."""
    import numpy as np

    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def slices(batch, column: int = 1):
    """Slices of a batch that hold SLICE bytes of text, or one longer text, at most."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0)).astype(np.int64)
    first, total = 0, 0
    for at, n in enumerate(size.tolist()):
        if at > first and total + n > SLICE:
            yield batch.slice(first, at - first)
            first, total = at, 0
        total += n
    if first < batch.num_rows:
        yield batch.slice(first)


def lost_pass(buckets: int):
    """Anchors of a slice, a row for each bucket: sorted anchor, content and document, and the documents whose segment
    another one of the slice already holds. Buckets are equal ranges of the anchors' hashes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        edges = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
        for batch in (part for whole in batches for part in slices(whole)):
            ids = batch.column(0)
            texts = [t if i is not None else b"" for t, i in zip(text_bytes(batch), ids.to_pylist(), strict=True)]
            rows, _, _, key, content, check = all_segments(texts)
            doc = np.asarray(ids.fill_null(0))[rows]
            order, first = firsts(key, content, check, doc)
            key, content, check, doc = key[order], content[order], check[order], doc[order]
            again = doc != (doc[first][np.cumsum(first) - 1] if len(doc) else doc)
            at = np.r_[np.searchsorted(key, edges), len(key)].tolist()
            some = [b for b in range(buckets) if at[b] < at[b + 1]]
            blobs = []
            for b in some:
                own = slice(at[b], at[b + 1])
                f, more = first[own], again[own]
                parts = [_bytes(key[own][f], 6), _bytes(content[own][f]), _bytes(check[own][f], 6), _bytes(doc[own][f])]
                blobs.append(b"".join([np.int64(f.sum()).tobytes(), *parts, _bytes(content[own][more]), _bytes(doc[own][more])]))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _numbers(raw, at: int, n: int, size: int = 8):
    """n numbers of a blob, of so many bytes each."""
    import numpy as np

    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(-1, size)
    return out.view(np.uint64).ravel()


WHOLE, STRING, WINDOWS = -1, -2, -3  # what is to be done with a segment: it is lost, compared, or compared by windows


def judge_bucket(blobs: list[bytes], crowd: int = CROWD):
    """(document, content, what)."""
    import numpy as np

    keys, contents, checks, docs, more_c, more_d = [], [], [], [], [], []
    for x in blobs:
        n = int(np.frombuffer(x, np.int64, 1)[0])
        keys.append(_numbers(x, 8, n, 6))
        contents.append(_numbers(x, 8 + 6 * n, n))
        checks.append(_numbers(x, 8 + 14 * n, n, 6))
        docs.append(np.frombuffer(x, np.int64, n, 8 + 20 * n))
        rest = np.frombuffer(x, np.int64, -1, 8 + 28 * n) if len(x) > 8 + 28 * n else np.zeros(0, np.int64)
        more_c.append(rest[: len(rest) // 2])
        more_d.append(rest[len(rest) // 2 :])
    key, content, check, doc = (np.concatenate(x) for x in (keys, contents, checks, docs))
    order, new = firsts(key, content, check, doc)
    key, content, doc = key[order], content[order], doc[order]
    new_key = np.r_[True, key[1:] != key[:-1]]
    holder = doc[new][np.cumsum(new) - 1]
    lost = doc != holder
    # Among an anchor's distinct strings: more than one, and not all of one document.
    d, c = doc[new], content[new]
    at = np.flatnonzero(new_key[new])
    low, high = np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)
    of = np.cumsum(new_key[new]) - 1
    ask = (low != high)[of]
    crowded = (np.diff(np.r_[at, len(d)]) > crowd)[of]
    out_d = np.concatenate([doc[lost], *more_d, d[ask]])
    out_c = np.concatenate([content[lost].view(np.int64), *more_c, c[ask].view(np.int64)])
    what = np.full(len(out_d), WHOLE, np.int32)
    what[len(out_d) - ask.sum() :] = np.where(crowded, WINDOWS, STRING)[ask]
    return out_d, out_c, what


def grouped(batches, width: int):
    """Lists of rows that are equal in their first columns; the rows come sorted."""
    from itertools import groupby

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    return groupby(rows(), key=lambda r: r[:width])


def judge_pass(crowd: int):
    def run(batches):
        import pyarrow as pa

        for _, own in grouped(batches, 1):
            cols = judge_bucket([blob for _, blob in own], crowd)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["doc_id", "content", "what"])

    return run


def packed(batches):
    """Texts compressed for the way."""
    import pyarrow as pa
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        small = [z.compress(t) for t in text_bytes(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary()), *batch.columns[2:]], ["doc_id", "z", *batch.schema.names[2:]])


def unpack(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z)


def mark_code(content, text):
    """One number for a content of a text of a chunk."""
    import numpy as np

    return _mix(content.view(np.uint64) ^ _mix(text.astype(np.uint64) + np.uint64(1)))


def partition(batches, piece: int = PIECE):
    """Chunks of about ``piece`` bytes of a partition's texts, each with the marks of its documents: ids, texts, and for each
    mark its text's number, a code of text and content, its first and its last window; sorted by code. A partition holds
    all rows of its documents, in their order, marks first."""
    import numpy as np

    ids, raws, size = [], [], 0
    marks = [np.zeros(0, np.int64)] * 4  # document, content, first, last

    def chunk():
        doc, content, first, last = marks
        some = np.array([-1 if x is None else x for x in ids], np.int64)
        null = np.array([x is None for x in ids])
        low, high = np.searchsorted(doc, some), np.searchsorted(doc, some, "right")
        n = np.where(null, 0, high - low)
        text = np.repeat(np.arange(len(n)), n)
        mark = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        code = mark_code(content[mark], text)
        order = np.argsort(code, kind="stable")
        return ids, raws, (text[order], code[order], first[mark][order], last[mark][order])

    for batch in batches:
        at_text = np.asarray(batch.column(1).is_valid())
        own = batch.filter(batch.column(1).is_null())
        marks = [np.r_[a, np.asarray(c)] for a, c in zip(marks, own.select([0, 2, 3, 4]).columns, strict=True)]
        own = batch.filter(batch.column(1).is_valid()) if at_text.any() else batch.slice(0, 0)
        for i, z in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
            ids.append(i)
            raws.append(unpack(z))
            size += len(raws[-1])
            if size >= piece:
                yield chunk()
                keep = slice(0 if i is None else int(np.searchsorted(marks[0], i)), None)  # more texts of this document may follow
                marks = [x[keep] for x in marks]
                ids, raws, size = [], [], 0
    if ids:
        yield chunk()


def matches(codes, code):
    """Which of some codes are in a sorted list, and where they begin and end there."""
    import numpy as np

    low = np.searchsorted(codes, code)
    hit = np.flatnonzero(codes[np.minimum(low, len(codes) - 1)] == code) if len(codes) else np.zeros(0, np.int64)
    return hit, low[hit], np.searchsorted(codes, code[hit], "right")


def coded(raws: list[bytes], marks):
    """Segments of the texts that have marks, with the codes of ``partition``."""
    import numpy as np

    texts = np.unique(marks[0])
    rows, where, windows, key, content, _ = all_segments([raws[x] for x in texts.tolist()])
    text = texts[rows] if len(texts) else rows
    return text, where, windows, key, content.view(np.int64), mark_code(content, text)


STRINGS = "crowded boolean, key long, doc_id long, content long, window int, string binary"


def string_pass(batches):
    """The strings that are asked for: with their anchor and window -1, or of crowded anchors each window with its own hash
    and number. A window that a smaller document of the chunk holds too is lost, and comes without its bytes."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    for ids, raws, marks in partition(batches):
        text, where, windows, key, content, code = coded(raws, marks)
        hit, low, _ = matches(marks[1], code)
        _, once = np.unique(code[hit], return_index=True)
        once = np.sort(once)  # in the order of documents
        hit, by_windows = hit[once], marks[2][low[once]] == WINDOWS
        rows, holder = [], {}
        cols = (x[hit].tolist() for x in (text, where, windows, key.view(np.int64), content))
        for crowded, t, a, n, k, c in zip(by_windows.tolist(), *cols, strict=True):
            i = ids[t]
            if not crowded:
                rows.append((False, k, i, c, -1, raws[t][a : a + n + SIZE - 1]))
                continue
            for w in range(n):
                own = raws[t][a + w : a + w + SIZE]
                if holder.setdefault(own, i) == i:
                    rows.append((True, xxhash.xxh3_64_intdigest(own) - (1 << 63), i, c, w, own))
                else:
                    rows.append((True, c, i, c, w, None))
        if rows:
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            cols = [pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in STRINGS.split(", ")])


def cuts(raws: list[bytes], marks) -> list:
    """For each text the ranges (from, to) of the bytes that go, united and in order."""
    import numpy as np

    text, where, windows, _, _, code = coded(raws, marks)
    hit, low, high = matches(marks[1], code)
    n = high - low
    seg = np.repeat(hit, n)
    mark = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    first, last = marks[2][mark], marks[3][mark]
    size = np.array([len(r) + 1 for r in raws])  # a byte between texts keeps their ranges apart
    start = np.cumsum(size) - size
    begin = start[text[seg]] + where[seg]
    change = np.bincount(begin + np.maximum(first, 0), minlength=size.sum() + 1)
    change = change - np.bincount(begin + np.where(first < 0, windows[seg] - 1, last) + SIZE, minlength=size.sum() + 1)
    gone = np.cumsum(change)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)
    own = np.searchsorted(start, edge[:, 0], "right") - 1
    edge = edge - start[own][:, None]
    return np.split(edge, np.searchsorted(own, np.arange(1, len(raws))))


def shard_pass(batches):
    """Lost windows of the strings of one partition, which come sorted by anchor, and of single windows, which come sorted
    by hash and document: (doc_id, content, first, last)."""
    from itertools import chain

    import pyarrow as pa

    def out(found):
        d, c, a, b = found
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(c, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["doc_id", "content", "first", "last"])

    shard, size, lost = [], 0, []
    for (crowded, _), rows in grouped(batches, 2):
        if crowded:
            holder: dict[bytes, int] = {}
            for _, _, doc, content, window, string in rows:
                if string is None or holder.setdefault(string, doc) < doc:
                    lost.append((doc, content, window, window))
                if len(lost) >= 10_000:
                    yield out(zip(*lost, strict=True))
                    lost = []
            continue
        head = next(rows)
        own = [(k, d, c, s) for _, k, d, c, _, s in chain([head], rows)]
        if size and size + sum(len(r[3]) for r in own) > SHARD:
            yield out(shard_lost(shard))
            shard, size = [], 0
        shard += own
        size += sum(len(r[3]) for r in own)
    if shard:
        yield out(shard_lost(shard))
    if lost:
        yield out(zip(*lost, strict=True))


def shard_lost(rows):
    """Windows of the rows' strings that a smaller document's string holds too, as ranges of first to last window."""
    import numpy as np

    from .suffix_array import reaches, suffix_array

    text = np.frombuffer(b"".join(r[3] + b"\xff" for r in rows), np.uint8)  # no UTF-8 text holds that byte
    size = np.array([len(r[3]) + 1 for r in rows])
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(rows)), size)
    doc = np.array([r[1] for r in rows], np.int64)
    valid = np.arange(len(text)) - start[row] + SIZE < size[row]
    sa = suffix_array(text)
    same = reaches(text, sa, valid, SIZE)[sa]
    at = np.flatnonzero(~same)
    owner = doc[row[sa]]
    low = np.minimum.reduceat(owner, at)[np.cumsum(~same) - 1]
    lost = np.zeros(len(text), bool)
    lost[sa] = valid[sa] & (owner > low)
    edge = np.diff(np.r_[False, lost, False].astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    r = row[a]
    content = np.array([x[2] for x in rows], np.int64)
    return doc[r], content[r], a - start[r], b - start[r]


def kept_bytes(raw: bytes, ranges) -> bytes:
    at, out = 0, []
    for a, b in ranges.tolist():
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _dealt(texts: DataFrame, marks: DataFrame, parts: int) -> DataFrame:
    """Texts and marks of each document in one partition, in the order of documents and marks first. Null ids have no
    marks and are spread over all partitions."""
    a = texts.select("doc_id", "z", *[F.lit(None).cast(k).alias(c) for c, k in (("content", "long"), ("first", "int"), ("last", "int"))])
    b = marks.select("doc_id", F.lit(None).cast("binary").alias("z"), "content", "first", "last")
    both = a.unionByName(b).repartition(parts, F.coalesce(F.col("doc_id"), -F.pmod(F.xxhash64("z"), F.lit(1 << 30))))
    return both.sortWithinPartitions("doc_id", F.col("z").isNotNull())


def lost_windows(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, content, first, last: which windows of which segments are lost (first is WHOLE: all)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select("doc_id", "text").mapInArrow(lost_pass(parts * SPREAD), "bucket int, blob binary")
    found = found.repartition(parts, "bucket").sortWithinPartitions("bucket")
    judged = saved(found.mapInArrow(judge_pass(crowd), "doc_id long, content long, what int"), "judged")
    marks = judged.select("doc_id", "content", F.col("what").alias("first"), F.col("what").alias("last"))
    texts = docs.select("doc_id", "text").mapInArrow(packed, "doc_id long, z binary")
    strings = _dealt(texts, marks.where(F.col("first") != WHOLE), parts).mapInArrow(string_pass, STRINGS)
    strings = strings.repartition(parts, "crowded", "key").sortWithinPartitions("crowded", "key", "doc_id")
    some = strings.mapInArrow(shard_pass, "doc_id long, content long, first int, last int")
    return marks.where(F.col("first") == WHOLE).unionByName(some)


def report_pass(batches):
    import pyarrow as pa

    for ids, raws, marks in partition(batches):
        rows = []
        for doc_id, raw, ranges in zip(ids, raws, cuts(raws, marks), strict=True):
            kept = kept_bytes(raw, ranges)
            rows.append((doc_id, len(raw), len(raw) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()))
        cols = [pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))]
        yield pa.RecordBatch.from_arrays(cols, REPORT_NAMES)


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
REPORT_NAMES = [x.split()[0] for x in REPORT.split(", ")]


def report(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.mapInArrow(packed, "doc_id long, z binary")
    return _dealt(texts, lost_windows(docs, crowd), parts).mapInArrow(report_pass, REPORT)


def cut_texts(docs: DataFrame) -> DataFrame:
    """docs with the lost bytes gone from text (a code point of which only a part is left goes too); n_chars, if there
    is one, counts the new text. All other values stay; a null text stays null."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = saved(_dealt(keyed.mapInArrow(packed, "doc_id long, z binary"), lost_windows(keyed), parts).mapInArrow(range_pass, "doc_id long, sig binary, text string"), "cuts")
    cuts = ranges.dropDuplicates(["doc_id", "sig"]).select(F.col("doc_id").alias("_s_id"), F.col("sig").alias("_s_sig"), F.col("text").alias("_s_text"))
    rows = docs.select(F.struct("*").alias("_s_row"), F.col("doc_id").cast("long").alias("_s_own"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("_s_md5"))
    out = rows.join(cuts, (F.col("_s_own") == F.col("_s_id")) & (F.col("_s_md5") == F.col("_s_sig")), "left")
    own = {c: F.col("_s_row").getField(c) for c in docs.columns}
    text = F.coalesce("_s_text", own["text"])
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("_s_text").isNull(), own["n_chars"]).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*[v.alias(k) for k, v in (own | {"text": text}).items()])


def range_pass(batches):
    """The texts that lose bytes: doc_id, md5 of the text, what is left of it."""
    import pyarrow as pa

    for ids, raws, marks in partition(batches):
        rows = [
            (doc_id, hashlib.md5(raw).digest(), kept_bytes(raw, ranges).decode(errors="ignore"))
            for doc_id, raw, ranges in zip(ids, raws, cuts(raws, marks), strict=True)
            if len(ranges)
        ]
        if rows:
            d, s, t = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.binary()), pa.array(t, pa.string())], ["doc_id", "sig", "text"])
