"""N-gram Jaccard join with a count-vector R-tree.

A document's set holds the 64-bit hashes of its distinct word shingles. Its tokens are hashed into groups, and the counts
of the groups are a point; the summed coordinate minima of two points bound the overlap of two sets from above. Points
are indexed in a packed R-tree whose nodes carry coordinate maxima, so the same sum over a node bounds the overlap with
everything below it. Pairs whose bound reaches the overlap that the similarity asks for are verified on the sets.

The tree is sharded so that no link is lost and nothing is compared that can't be linked. Two sets of total size s with
Jaccard t differ in at most s * (1 - t) / (1 + t) tokens. For each band of sizes the tokens are hashed into more groups
than that; linked sets then agree in many whole groups, and a group's content is a cell. That takes three passes:

1. Cells alone, eight bytes each, are dealt by their keys; those that no other set has go.
2. Back at its batch, a set whose remaining cells are fewer than a linked pair shares leaves the band, and likewise a
   home (an eighth of the band's groups) where the pair's share, dealt over the homes, can't be reached.
3. What is left is dealt by homes, with the sets' points. Sets that meet in a cell and whose points reach the bound are
   candidates (cells of many members search a tree of their own).

Points have about eight tokens a coordinate, whatever the size of a set: with fewer coordinates, chance alone gives large
sets the minima of near ones, and with them the whole corpus becomes one shard. The connected parts of the candidates'
graph are shards, and each shard has one R-tree (a shard larger than SHARD_BYTES is cut into blocks, and each pair of
blocks has a tree of its own). Within a shard pairs already connected are not verified again: components need no more
links than that.

Equal sets are one node from the start; nodes have numbers of their own, so that texts which share an id stay apart.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer words
than a shingle are one shingle; rows are judged one by one, each by its own text, so rows of equal id may be in different
components, and equal rows are in one; a similarity exactly at the limit links; a null id is its own component (null)
and links nothing; very long texts are shingled inside their row; an empty table gives an empty result; further columns,
whatever their names, are ignored by ``groups`` and kept by ``keep_first``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_bytes
from .components import components

HOMES = 8  # of a band: the cells of a home's groups go together, so a set's point has to go to few places
SPREAD = 512  # partitions from which on a home is dealt over several
SMALL = 48  # members up to which a cell's pairs are all held against the bound at once
FANOUT = 16
SHARD_BYTES = 16_000_000
BATCH = 3000  # documents whose cells are dealt together; HOMES * 2 * BATCH is below 2**16
WORDS, PERCENT = 5, 80


class Words:
    """64-bit hashes of words, cached."""

    def __init__(self, most: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def hashes(self, words: list[bytes]):
        import numpy as np
        import xxhash

        known = self.known
        new = set(words).difference(known)
        if len(known) > self.most:
            known.clear()
            new = set(words)
        known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(x):
    """A bijective scrambling of 64-bit words."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes], words: int, cache: Words) -> list:
    """The sorted set of each text."""
    import numpy as np

    split = [t.lower().split() for t in texts]
    flat = cache.hashes([w for s in split for w in s])
    out, at = [], 0
    for s in split:
        h = flat[at : at + len(s)]
        at += len(s)
        if not len(s):
            out.append(h)
            continue
        size = min(words, len(s))
        x = np.full(len(s) - size + 1, size, np.uint64)
        for k in range(size):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : len(s) - size + 1 + k])
        out.append(np.unique(x))
    return out


def bands(percent: int, most: int) -> list[int]:
    """First sizes of the bands: a linked pair's sizes lie in one band or in neighbours."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(edges[-1] * 100 // percent + 1)
    return edges


def cells(s, percent: int, edges: list[int]):
    """Of a set's band and the next one: band, keys of the cells, their homes, and how many of these cells a linked set of
    that band shares at least. A band where only equal sets can be linked has none."""
    import bisect

    import numpy as np

    out = []
    k = bisect.bisect_right(edges, len(s)) - 1
    for band in (k, k + 1):
        high = edges[band + 1] - 1
        differ = 2 * high * (100 - percent) // (100 + percent)
        if not differ:
            continue
        spare = 4 + differ // 5  # so many more groups agree in a linked pair, and few sets have more empty ones than that
        m = differ + 1 + spare
        group = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # grows along the sorted set
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        total = np.add.reduceat(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start)
        tag = np.uint64((band + 1) * 1_000_003)
        group = group[start]
        key = mix(total ^ mix(group + tag))
        none = m - len(start)
        need = 1 + spare - none  # 1 + spare groups agree, and no more of them are empty than this set has
        if none > spare:  # its empty groups count as contents too, or agreement might lie in them alone
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), group)
            key = np.r_[key, mix(mix(empty + tag) + np.uint64(1))]
            group, need = np.r_[group, empty], 1
        out.append((band, key, group * np.uint64(HOMES) // np.uint64(m), need))
    return out


def point(s, groups: int):
    """The counts of a set's tokens by group."""
    import numpy as np

    return np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def depth(size: int) -> int:
    """Of a set's point: 2**depth coordinates, about eight tokens each."""
    return min(12, max(6, (int(size) // 8).bit_length()))


class Points:
    """Points of different depths. The deeper of two is folded before they are compared."""

    def __init__(self, depths, flat):
        """flat: all points one after the other."""
        import numpy as np

        self.depths, self.flat = depths, flat
        self.start = np.cumsum(1 << depths) - (1 << depths)

    def fold(self, at, to: int):
        """The points at some places as rows of 2**to coordinates."""
        import numpy as np

        out = np.empty((len(at), 1 << to), np.uint32)
        for d in np.unique(self.depths[at]).tolist():
            own = np.flatnonzero(self.depths[at] == d)
            whole = self.flat[self.start[at[own]][:, None] + np.arange(1 << d)]
            out[own] = whole.reshape(len(own), -1, 1 << to).sum(1, dtype=np.uint32)
        return out


def digest(s) -> tuple[int, int]:
    import numpy as np
    import xxhash

    raw = s.tobytes()
    two = xxhash.xxh3_128_intdigest(raw)
    return tuple(int(x) for x in np.array([two >> 64, two & (1 << 64) - 1], np.uint64).view(np.int64))


DIGESTS = "doc_id long, sig long, n_shingles long, d1 long, d2 long"


def some_texts(batch, most: int = 250, size: int = 1 << 22):
    """The texts of a batch in lists of few texts and, but for the last of a list, few bytes."""
    own, total = [], 0
    for t in text_bytes(batch):
        own.append(t)
        total += len(t)
        if len(own) >= most or total >= size:
            yield own
            own, total = [], 0
    if own:
        yield own


def digest_pass(words: int):
    """A row a document; its third column, a hash of its text, goes along."""

    def run(batches):
        import pyarrow as pa

        cache = Words()
        for batch in batches:
            at = 0
            for texts in some_texts(batch):
                rows = [(len(s), *digest(s)) for s in shingles(texts, words, cache)]
                own = batch.slice(at, len(texts))
                at += len(texts)
                cols = [own.column(0), own.column(2), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sig", "n_shingles", "d1", "d2"])

    return run


def bound_reached(sizes, points: Points, a, b, percent: int):
    """Whether the summed minima of the pairs' points reach the overlap that a link needs."""
    import numpy as np

    out = np.zeros(len(a), bool)
    depths = np.minimum(points.depths[a], points.depths[b])
    for d in np.unique(depths).tolist():
        some, step = np.flatnonzero(depths == d), max(1, 2_000_000 >> d)
        for k in range(0, len(some), step):
            at = some[k : k + step]
            bound = np.minimum(points.fold(a[at], d), points.fold(b[at], d)).sum(1, dtype=np.int64)
            out[at] = bound * (100 + percent) >= percent * (sizes[a[at]] + sizes[b[at]])
    return out


def cell_links(key, node, sizes, points, percent: int):
    """Pairs of nodes (numbers) that meet in a cell and reach the bound, as many as connect what such pairs connect."""
    import numpy as np

    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[start, len(key)])
    some = (count > 1) & (count <= SMALL)
    pairs = []
    for d in range(1, int(count[some].max(initial=1))):  # all pairs of the small cells, by their distance in the cell
        at = start[some & (count > d)]
        n = count[some & (count > d)] - d
        i = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs.append(np.stack([node[i], node[i + d]], 1))
    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    pairs = pairs[bound_reached(sizes, points, pairs[:, 0], pairs[:, 1], percent)]
    root = list(range(len(sizes)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []

    def join(a, b):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b))

    for a, b in pairs.tolist():
        join(a, b)
    seen = set()
    for k in np.flatnonzero(count > SMALL).tolist():  # the others by the tree, unless all of a cell is connected
        own = np.unique(node[start[k] : start[k] + count[k]])
        what = own.tobytes()
        if what in seen or len({find(x) for x in own.tolist()}) == 1:
            continue
        seen.add(what)
        dots = points.fold(own, int(points.depths[own].min()))
        tree, left = RTree(sizes[own], dots), np.ones(len(own), bool)
        for first in range(len(own)):  # from one to all that it reaches; a search leaves little for the next
            queue = [first] if left[first] else []
            left[first] = False
            while queue and left.any():
                x = queue.pop()
                near = tree.search(int(sizes[own[x]]), dots[x], percent)
                near = near[left[near]]
                left[near] = False
                for y in near.tolist():
                    join(int(own[x]), int(own[y]))
                queue += near.tolist()
    return np.array(out, np.int64).reshape(-1, 2)


def _six(key) -> bytes:
    """The low six bytes of each key."""
    return key.view("u1").reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw, n: int, at: int):
    import numpy as np

    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, at).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def cell_pass(words: int, percent: int, buckets: int):
    """The cells of each batch, a row for each bucket (equal ranges of the keys): six bytes of the key and two of the
    member's number, band and home. A last row, the batch's head, is marked and has the members' names, sizes and points,
    what their bands need, and the number of the batch's other rows."""

    def parts(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                yield batch.slice(first, BATCH)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        cache, limits = Words(), bands(percent, 1 << 40)
        edges = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
        for part in parts(batches):
            found, size, dots, keys, codes = {}, [], [], [], []
            band, need = np.zeros(2 * part.num_rows, np.int64), np.zeros(2 * part.num_rows, np.int64)
            for texts in some_texts(part):
                for s in shingles(texts, words, cache):
                    if len(s) and (d := digest(s)[0]) not in found:
                        found[d] = node = len(found)
                        for which, (b, key, home, least) in enumerate(cells(s, percent, limits)):
                            band[2 * node + which], need[2 * node + which] = b, least
                            keys.append(key)
                            codes.append((home + np.uint64(HOMES * (2 * node + which))).astype(np.uint16))
                        size.append(len(s))
                        x = point(s, 1 << depth(len(s)))
                        dots.append(x.astype(np.uint8 if x.max() < 256 else np.uint32))
            if not keys:
                continue
            key, code = np.concatenate(keys), np.concatenate(codes)
            order = np.argsort(key)
            key, code = key[order], code[order]
            cut = np.r_[np.searchsorted(key, edges), len(key)].tolist()
            some = [b for b in range(buckets) if cut[b] < cut[b + 1]]
            blobs = [code[cut[b] : cut[b + 1]].tobytes() + _six(key[cut[b] : cut[b + 1]]) for b in some]
            name, n = np.fromiter(found, np.int64, len(found)), len(found)
            dots = np.concatenate(dots)
            head = np.r_[n, len(some), dots.itemsize, name, size, band[: 2 * n], need[: 2 * n]].astype(np.int64).tobytes()
            head += dots.tobytes()
            batch = xxhash.xxh3_64_intdigest(head) - (1 << 63)
            rows = [[*some, batch % buckets], [batch] * (len(some) + 1), [False] * len(some) + [True], [*blobs, head]]
            kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True)], ["bucket", "batch", "head", "blob"])

    return run


def _grouped(batches):
    """Lists of rows that are equal in their first column; the rows come sorted."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=lambda r: r[0])


def meet_pass(batches):
    """The cells that more than one row of a bucket has, a row for each that came in; heads go along."""
    import numpy as np
    import pyarrow as pa

    def out(rows):
        cols = zip(*rows, strict=True)
        kinds = (pa.int64(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cols, kinds, strict=True)], ["batch", "head", "blob"])

    for _, own in _grouped(batches):
        names, codes, keys = [], [], []
        for _, batch, head, blob in own:
            if head:
                yield out([(batch, True, blob)])
                continue
            n = len(blob) // 8
            names.append(batch)
            codes.append(np.frombuffer(blob, np.uint16, n))
            keys.append(_from_six(blob, n, 2 * n))
        if not names:
            continue
        key = np.concatenate(keys)
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(key), bool)
        again[order] = np.r_[False, same] | np.r_[same, False]
        del key, order, same
        at, rows = 0, []
        for batch, code, key in zip(names, codes, keys, strict=True):
            some = again[at : at + len(code)]
            at += len(code)
            rows.append((batch, False, code[some].tobytes() + _six(key[some])))
        yield out(rows)


def peel_pass(buckets: int):
    """Of each batch, whose rows come together: the cells of the members, bands and homes that can have a link, a row for
    each bucket with the members' names, sizes and points."""
    fine = max(1, buckets // SPREAD)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, rows in _grouped(batches):
            heads, blobs = [], []
            for _, is_head, blob in rows:
                (heads if is_head else blobs).append(blob)
            n, sent, wide = np.frombuffer(heads[0], np.int64, 3).tolist() if heads else (0, 0, 1)
            if not heads or len(blobs) != sent * len(heads):  # equal batches have equal names
                raise RuntimeError("a batch of documents was read in another order when it was read again")
            name, size, band, need = np.split(np.frombuffer(heads[0], np.int64, 6 * n, 24), [n, 2 * n, 4 * n])
            depths = np.array([depth(x) for x in size.tolist()], np.int64)
            points = Points(depths, np.frombuffer(heads[0], np.uint8 if wide == 1 else np.uint32, -1, 24 + 48 * n))
            code = np.concatenate([np.frombuffer(x, np.uint16, len(x) // 8) for x in blobs]).astype(np.int64)
            key = np.concatenate([_from_six(x, len(x) // 8, len(x) // 8 * 2) for x in blobs])
            unit = code // HOMES
            keep = np.bincount(unit, minlength=2 * n)[unit] >= need[unit]
            keep &= np.bincount(code, minlength=2 * n * HOMES)[code] >= -(-need[unit] // HOMES)
            key, code, unit = key[keep], code[keep], unit[keep]
            if not len(key):
                continue
            home = mix((band[unit] * HOMES + code % HOMES).astype(np.uint64))
            bucket = ((home + key % np.uint64(fine)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((key, bucket))
            key, node, bucket = key[order], unit[order] // 2, bucket[order]
            some, first = np.unique(bucket, return_index=True)
            out = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
                members, place = np.unique(node[a:b], return_inverse=True)
                dots = np.concatenate([points.flat[points.start[x] : points.start[x] + (1 << depths[x])] for x in members.tolist()])
                top = np.array([b - a, len(members), wide], np.int64)
                out.append(b"".join([top.tobytes(), name[members].tobytes(), size[members].tobytes(), place.astype(np.uint16).tobytes(), _six(key[a:b]), dots.tobytes()]))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(out, pa.binary())], ["bucket", "blob"])

    return run


def bucket_links(blobs: list[bytes], percent: int):
    """Links in the cells of one bucket."""
    import numpy as np

    keys, nodes, names, sizes, dots = [], [], [], [], []
    total = 0
    for x in blobs:
        n, m, wide = np.frombuffer(x, np.int64, 3).tolist()
        names.append(np.frombuffer(x, np.int64, m, 24))
        sizes.append(np.frombuffer(x, np.int64, m, 24 + 8 * m))
        at = 24 + 16 * m
        nodes.append(np.frombuffer(x, np.uint16, n, at).astype(np.int64) + total)
        keys.append(_from_six(x, n, at + 2 * n))
        dots.append(np.frombuffer(x[at + 8 * n :], np.uint8 if wide == 1 else np.uint32))
        total += m
    size = np.concatenate(sizes)
    name, first, inverse = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
    points = Points(np.array([depth(x) for x in size.tolist()], np.int64), np.concatenate(dots))
    points.depths, points.start = points.depths[first], points.start[first]
    found = cell_links(np.concatenate(keys), inverse[np.concatenate(nodes)], size[first], points, percent)
    return name[found]


def link_cells(percent: int):
    """Links of the buckets of one partition, which come sorted by bucket."""

    def run(batches):
        import pyarrow as pa

        for _, own in _grouped(batches):
            pairs = bucket_links([x for _, x in own], percent)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def candidates(docs: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """Pairs of names of sets (a, b) that connect all that may be linked."""
    cells = docs.mapInArrow(cell_pass(words, percent, parts), "bucket int, batch long, head boolean, blob binary")
    met = cells.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet_pass, "batch long, head boolean, blob binary")
    left = met.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(peel_pass(parts), "bucket int, blob binary")
    return left.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(link_cells(percent), "a long, b long")


class RTree:
    """Packed R-tree over count vectors, sorted by set size and then by the coordinates' halves."""

    def __init__(self, sizes, points):
        import numpy as np

        self.n, self.points = sizes, points
        half = points[:, : points.shape[1] // 2].sum(1)
        quarter = points[:, ::2].sum(1)
        order = np.argsort(sizes, kind="stable")  # slices by size, then by the half, then by the quarter
        slab = max(FANOUT, int(np.ceil(len(order) ** (2 / 3))))
        order = np.concatenate([_sliced(order[k : k + slab], half, quarter) for k in range(0, len(order), slab)])
        self.order = order
        self.levels = []  # from the leaves up: (maxima, least size, greatest size) of FANOUT children each
        top, low, high = points[order], sizes[order], sizes[order]
        while len(top) > 1:
            at = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    def search(self, size: int, point, percent: int):
        """Indices of the points whose bound on the overlap reaches what a link needs."""
        import numpy as np

        at = np.zeros(1, np.int64)
        for k in range(len(self.levels) - 1, -2, -1):
            if k >= 0:
                top, low, high = self.levels[k]
                top, low, high = top[at], low[at], high[at]
            else:
                i = self.order[at]
                top, low, high = self.points[i], self.n[i], self.n[i]
            bound = np.minimum(top, point).sum(1, dtype=np.int64)
            ok = bound * (100 + percent) >= percent * (size + low)
            ok &= (low * percent <= 100 * size) & (high * 100 >= percent * size)
            at = at[ok]
            if k >= 0:
                below = len(self.levels[k - 1][0]) if k else len(self.order)
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < below]
        return self.order[at]


def _sliced(order, half, quarter):
    import numpy as np

    order = order[np.argsort(half[order], kind="stable")]
    step = max(FANOUT, int(np.ceil(len(order) ** 0.5)))
    return np.concatenate([s[np.argsort(quarter[s], kind="stable")] for s in (order[k : k + step] for k in range(0, len(order), step))])


def overlap(a, b) -> int:
    import numpy as np

    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def shard_links(ids: list[int], sets: list, side: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked; side: with two sides, only pairs across them are looked at."""
    import numpy as np

    sizes = np.array([len(s) for s in sets], np.int64)
    groups = 1 << depth(sizes.mean())
    points = np.stack([point(s, groups) for s in sets]).astype(np.uint16 if sizes.max() < 65536 else np.uint32)
    tree, across, sides = RTree(sizes, points), len(set(side)) > 1, np.array(side)
    part = np.arange(len(ids))  # the connected part of each
    out = []
    for q in range(len(ids)):
        if across and side[q]:
            continue
        found = tree.search(int(sizes[q]), points[q], percent)
        found = found[(sides[found] != side[q]) if across else found < q]
        found = found[part[found] != part[q]]
        while len(found):
            x = int(found[0])
            common = overlap(sets[q], sets[x])
            if 100 * common >= percent * (sizes[q] + sizes[x] - common):
                part[part == part[x]] = part[q]
                out.append((ids[q], ids[x]))
                found = found[part[found] != part[q]]
            else:
                found = found[1:]
    return out


def link_pass(words: int, percent: int):
    """Links of the shards of one partition; its rows (root, i, j, side, n, d1, d2, z) come sorted by shard. A text
    that hasn't the digest it was chosen for belongs to another row of the same id."""

    def run(batches):
        from itertools import groupby

        import pyarrow as pa
        import zstandard

        cache, unpack = Words(), zstandard.ZstdDecompressor().decompress

        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        for _, own in groupby(rows(), key=lambda r: r[:3]):
            own = list(own)
            sets = []
            for k in range(0, len(own), 100):  # the words of few texts at once
                sets += shingles([unpack(r[7]) for r in own[k : k + 100]], words, cache)
            keep = [k for k, (r, s) in enumerate(zip(own, sets, strict=True)) if digest(s) == r[5:7]]
            if len(keep) < 2:
                continue
            links = shard_links([own[k][4] for k in keep], [sets[k] for k in keep], [own[k][3] for k in keep], percent)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def packed(batches):
    """Texts compressed for the way: smaller than their sets."""
    import pyarrow as pa
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([z.compress(t) for t in text_bytes(batch)], pa.binary())], ["doc_id", "z"])


def rows_of_groups(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, sig (a hash of the text), n_shingles, component_id."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("sig"))
    digests = saved(docs.mapInArrow(digest_pass(words), DIGESTS), "digests")
    docs = docs.select("doc_id", "text")
    shards = components(candidates(docs, words, percent, parts))
    reps = digests.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"))
    reps = saved(reps.withColumn("number", F.monotonically_increasing_id()), "reps")
    chosen = reps.join(shards, reps["d1"] == shards["node"]).select("rep", "number", "d1", "d2", "root", "n")
    blocks = chosen.groupBy("root").agg(F.ceil(F.sum("n") * 8 / SHARD_BYTES).alias("blocks"))
    texts = docs.mapInArrow(packed, "doc_id long, z binary")
    chosen = chosen.join(blocks, "root").select("rep", "number", "d1", "d2", "root", "blocks")  # before the texts, which move less then
    dealt = texts.join(chosen, texts["doc_id"] == chosen["rep"]).withColumn("own", F.pmod(F.xxhash64("number"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") > F.col("other"), 1).otherwise(0)
    dealt = dealt.select("root", low.alias("i"), high.alias("j"), side.alias("side"), "number", "d1", "d2", "z")
    dealt = dealt.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    joined = components(dealt.mapInArrow(link_pass(words, percent), "a long, b long"))
    linked = joined.join(reps.select("number", "rep"), joined["node"] == F.col("number")).select("node", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "root").select("node", "least")
    named = reps.join(linked, reps["number"] == linked["node"], "left").select("d1", "d2", F.coalesce("least", "rep").alias("component"))
    out = digests.join(named, ["d1", "d2"], "left")
    component = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "sig", "n_shingles", component.alias("component_id"))


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return rows_of_groups(docs, words, percent).drop("sig")


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the members of each group but those of its smallest id; documents without words and null ids stay."""
    gone = rows_of_groups(docs, words, percent).where("component_id <> doc_id")
    gone = gone.select(F.col("doc_id").alias("_j_id"), F.col("sig").alias("_j_sig")).distinct()
    rows = docs.select(F.struct("*").alias("_j_row"), F.col("doc_id").cast("long").alias("_j_own"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_j_text"))
    same = (F.col("_j_own") == F.col("_j_id")) & (F.col("_j_text") == F.col("_j_sig"))
    return rows.join(gone, same, "left_anti").select("_j_row.*")
