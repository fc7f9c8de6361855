"""LM scoring with a Brown class-based bigram model.

p(word | previous word) = p(class | previous class) * p(word | class). Every training word has a class of its own. The
start is exchange clustering on the driver of the CLUSTERED most frequent words and of ENDINGS groups of all others by
word ending, one item at a time until nothing moves. Then a distributed sweep takes every word: a table that grows with
the corpus gathers each word's counts of neighbouring classes, and each word moves to the class under which they are
most likely while the classes' statistics are frozen. If that does not raise the training likelihood it is undone. Only
words that were never seen take the class that their ending had at the start. Transitions are interpolated with the
class frequencies, and a class emits each of its words with (count + 1) / (tokens + distinct words + 1), where the last
1 is for words that were never seen; both sum to one.

Counting covers all training text. The COMMON most frequent words are resolved from a broadcast list of fixed size, with
their counts and classes; the others' are joined to the documents that hold them, and rare words cannot be hot keys.
What tasks have counted of the listed words is added up in trees of FAN blocks, so that no group holds more than those.

Words are split at ASCII white space with A-Z lower-cased; one end token closes a text and is the context of its first
word. Defined cases: a null or empty text is the end token alone; repeated rows count and are scored one by one; words
of equal count are listed in byte order, and among equally likely classes the first is taken; with nothing to learn
from, every probability is that of an empty model; very long texts are coded inside their row; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, discard, saved, text_bytes

CLUSTERED = 960  # words that start as items of their own
ENDINGS = 64  # groups of all other words at the start, by ending
ITEMS = CLUSTERED + ENDINGS
CLASSES = 48
BLOCK = 64  # words of the list in a row of counts
ROWS = 16  # items in a row of the starting items' counts
FAN = 64  # rows of counts that are added up at once
SLICE = 1 << 21  # bytes of coded texts (four a token) that are looked at once
NONE = CLASSES  # no neighbour on this side
BACKOFF = 50.0  # pseudo-counts of the class frequencies in a transition
COMMON = 150_000  # words whose counts travel with the code; the rest is joined
FLUSH = 200_000  # distinct words that a task counts before it hands them on
FOLDS, HELD = 7, 2
END = b"\n"  # no word holds a line feed


def ending(word: bytes) -> int:
    return CLUSTERED + zlib.crc32(word[-3:]) % ENDINGS


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def count_words(batches):
    import pyarrow as pa

    def out(c):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["w", "n"])

    found: Counter = Counter()
    for batch in batches:
        for text in text_bytes(batch):
            found.update(tokens(text))
            if len(found) > FLUSH:
                yield out(found)
                found = Counter()
    yield out(found)


class Words:
    """The most frequent words, with counts."""

    def __init__(self, words: list[bytes], counts: list[int]):
        import numpy as np

        self.words, self.counts = words, np.asarray(counts, np.int64)
        self.place: dict[bytes, int] | None = None

    def __getstate__(self):
        return {"words": self.words, "counts": self.counts, "place": None}

    def ready(self) -> Words:
        if self.place is None:
            self.place = {w: k for k, w in enumerate(self.words)}
        return self

    def look(self, flat: list[bytes]):
        """Places in the list (-1: not in it) and items: the place, or the ending after all places."""
        import numpy as np

        get = self.ready().place.get
        at = np.fromiter((get(w, -1) for w in flat), np.int32, len(flat))
        item = at.copy()
        for k in np.flatnonzero(at < 0).tolist():
            item[k] = len(self.words) + ending(flat[k]) - CLUSTERED
        return at, item


CODED = "uid long, doc_id long, train boolean, ids binary, rare array<binary>"


def code_pass(words):
    """One row a text: its tokens after a leading end token as places in the list, or -1 - j for its j-th other word."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        place, uid = words.value.ready().place, TaskContext.get().partitionId() << 33
        for batch in (x for b in batches for x in slices(b, "text", 4 * SLICE)):
            ids, rare = [], []
            for text in text_bytes(batch):
                own: dict[bytes, int] = {}
                flat = [END, *tokens(text)]
                at = [place.get(w) for w in flat]
                for k, x in enumerate(at):
                    if x is None:
                        at[k] = -1 - own.setdefault(flat[k], len(own))
                ids.append(np.array(at, np.int32).tobytes())
                rare.append(list(own))
            cols = [pa.array(np.arange(uid, uid + len(ids))), batch.column(0).cast(pa.int64()), batch.column(2), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))]
            uid += len(ids)
            yield pa.RecordBatch.from_arrays(cols, ["uid", "doc_id", "train", "ids", "rare"])

    return run


def slices(batch, column: str, size: int = SLICE):
    """Runs of a batch's rows with about ``size`` bytes of a column, so that what is made of them stays small."""
    import numpy as np
    import pyarrow.compute as pc

    n = np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0)).astype(np.int64)
    run = (np.cumsum(n) - n) // size
    at = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
    for a, b in zip(at, at[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


class Tokens:
    """The tokens of a batch of coded texts, in one row: ids, leading tokens, other words and where they are."""

    def __init__(self, batch):
        import numpy as np

        raw = batch.column(batch.schema.get_field_index("ids")).to_pylist()
        self.size = np.array([len(x) // 4 for x in raw], np.int64)
        self.ids = np.frombuffer(b"".join(raw), np.int32)
        self.start = np.cumsum(self.size) - self.size
        self.lead = np.zeros(len(self.ids), bool)
        self.lead[self.start] = True
        words = batch.column(batch.schema.get_field_index("rare")).to_pylist()
        n = np.array([len(x) for x in words], np.int64)
        self.base = np.cumsum(n) - n
        self.rare = [w for own in words for w in own]
        self.spots = np.flatnonzero(self.ids < 0)
        text = np.searchsorted(self.start, self.spots, "right") - 1
        self.which = self.base[text] - 1 - self.ids[self.spots]  # number in rare

    def filled(self, common, others, kind):
        """One value a token, from the list's and the other words' values."""
        import numpy as np

        out = np.zeros(len(self.ids), kind)
        known = self.ids >= 0
        out[known] = common[self.ids[known]]
        out[self.spots] = others[self.which]
        return out

    def classes(self, batch, common, bins):
        """Class of each token, and the training count of each other word (0: never seen or not joined)."""
        import numpy as np

        k, c = np.full(len(self.rare), -1, np.int64), np.zeros(len(self.rare), np.int64)
        at = batch.schema.get_field_index("found")
        if at >= 0:
            col = batch.column(at)
            n = np.asarray(col.value_lengths().fill_null(0))
            x = col.flatten()
            to = np.repeat(self.base, n) + np.asarray(x.field("j"))
            k[to], c[to] = np.asarray(x.field("k")), np.asarray(x.field("c"))
        for i in np.flatnonzero(k < 0).tolist():
            k[i] = bins[ending(self.rare[i]) - CLUSTERED]
        return self.filled(common, k, np.int64), c


def exchange(pairs, classes: int = CLASSES):
    """Class of each item, when no single move raises the likelihood any more. pairs[i, j]: how often item j follows
    item i. Maximises the class bigram likelihood
    sum N(a, b) log N(a, b) - sum N(a, .) log N(a, .) - sum N(., b) log N(., b)."""
    import numpy as np

    pairs = np.asarray(pairs, float)
    right, left = pairs.sum(1), pairs.sum(0)
    order = np.argsort(-(right + left), kind="stable")
    of = np.zeros(len(pairs), np.int64)
    of[order] = np.arange(len(pairs)) % classes

    def xlog(x):
        return x * np.log(np.maximum(x, 1.0))

    least = 1e-9 * max(1.0, pairs.sum())
    one = np.eye(classes)[of]
    joint = one.T @ pairs @ one
    out, into = one.T @ right, one.T @ left
    moved = True
    while moved:  # every move raises the likelihood by a least amount, so this ends
        moved = False
        for i in order.tolist():
            if not right[i] and not left[i]:
                continue
            a, own = of[i], pairs[i, i]
            after = np.bincount(of, pairs[i], classes)  # from i to each class
            before = np.bincount(of, pairs[:, i], classes)
            after[a] -= own
            before[a] -= own
            joint[a] -= after
            joint[:, a] -= before
            joint[a, a] -= own
            out[a] -= right[i]
            into[a] -= left[i]
            rows = xlog(joint + after[None, :]) - xlog(joint)
            cols = xlog(joint + before[:, None]) - xlog(joint)
            diagonal = np.arange(classes)
            d = joint[diagonal, diagonal]
            gain = rows.sum(1) + cols.sum(0) - rows[diagonal, diagonal] - cols[diagonal, diagonal]
            gain += xlog(d + after + before + own) - xlog(d)
            gain -= xlog(out + right[i]) - xlog(out) + xlog(into + left[i]) - xlog(into)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + least:
                b = a
            joint[b] += after
            joint[:, b] += before
            joint[b, b] += own
            out[b] += right[i]
            into[b] += left[i]
            of[i], moved = b, moved or b != a
    return of


class Model:
    """Frozen statistics: words, class of each item, log10 transitions and log10 emission totals."""

    def __init__(self, words: Words, of, joint, distinct, n: int, v: int):
        """joint, distinct: class bigrams and distinct training words of each class; n, v: all training tokens and
        distinct words."""
        import numpy as np

        self.words, self.of, self.n, self.v = words, of, n, v
        size = joint.sum(0)  # every token follows another, so these are the classes' tokens
        prior = (size + 1) / (n + CLASSES)
        self.step = np.log10((joint + BACKOFF * prior) / (joint.sum(1, keepdims=True) + BACKOFF))
        self.total = np.log10(size + distinct + 1)
        self.base_total = float(np.log10(n + v + 1))


def likelihood(joint) -> float:
    """Log likelihood of the training text under the classes, without the words' own counts."""
    import numpy as np

    def xlog(x):
        return float((x * np.log(np.maximum(x, 1.0))).sum())

    return xlog(joint) - xlog(joint.sum(1)) - xlog(joint.sum(0))


def weights(joint):
    """Worth of each class (columns) for one neighbour of each class after a word, and before it; the last row is for
    no neighbour."""
    import numpy as np

    def side(x):  # x[b, c]: neighbours of class c of the words of class b
        prior = (x.sum(0) + 1) / (x.sum() + CLASSES)
        p = np.log((x + BACKOFF * prior) / (x.sum(1, keepdims=True) + BACKOFF))
        return np.vstack([p.T, np.zeros(CLASSES)])

    joint = np.asarray(joint, float)
    return side(joint), side(joint.T)


def joint_of(c, lead):
    import numpy as np

    y = np.flatnonzero(~lead)
    return np.bincount(c[y - 1] * CLASSES + c[y], minlength=CLASSES * CLASSES)


def sparse(cells) -> bytes:
    """The cells of a block that are not 0: places, then counts."""
    import numpy as np

    some = np.flatnonzero(cells)
    return some.astype(np.uint16).tobytes() + cells[some].astype(np.int64).tobytes()


def dense(column, size: int):
    """The sum of sparse blocks."""
    import numpy as np

    total = np.zeros(size, np.int64)
    for x in column:
        raw = x.as_buffer()
        n = raw.size // 10
        total[np.frombuffer(raw, np.uint16, n)] += np.frombuffer(raw, np.int64, n, 2 * n)
    return total


BLOCKS = "part int, block int, counts binary"


def added(rows: DataFrame, parts: int, size: int) -> DataFrame:
    """One sparse row for each block, whatever the number of parts: sums of FAN parts, then of FAN such sums."""

    def add(key, table):
        import pyarrow as pa

        total = dense(table.column("counts"), size)
        own = [pa.array([key[k].as_py()], pa.int32()) for k in (0, 1)]
        return pa.table({"part": own[1], "block": own[0], "counts": pa.array([sparse(total)], pa.binary())})

    while True:
        rows = rows.groupBy("block", F.floor(F.col("part") / FAN).cast("int").alias("fan")).applyInArrow(add, BLOCKS)
        if parts <= FAN:
            return rows
        parts = -(-parts // FAN)


JOINT = -1  # the block of the class bigrams
GATHERED = "part int, block int, w binary, counts binary"


def gather_pass(shared):
    """Counts of neighbouring classes in a partition: block JOINT is the class bigrams, -2 a word that is not in the list
    with the classes after and before each of its places, and from 0 on BLOCK words of the list."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows(block, w, counts):
            cols = [pa.array([part] * len(block), pa.int32()), pa.array(block, pa.int32()), pa.array(w, pa.binary()), pa.array(counts, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "block", "w", "counts"])

        common, bins = shared.value
        wide = 2 * CLASSES
        n_blocks = -(-len(common) // BLOCK)
        cells, joint = np.zeros(n_blocks * BLOCK * wide, np.int32), np.zeros(CLASSES * CLASSES, np.int64)
        held: dict[bytes, list[bytes]] = {}

        def handed():
            out = rows([-2] * len(held), list(held), [b"".join(x) for x in held.values()])
            held.clear()
            return out

        for batch in (x for b in batches for x in slices(b, "ids")):
            t = Tokens(batch)
            c, _ = t.classes(batch, common, bins)
            joint += joint_of(c, t.lead)
            y = np.flatnonzero(~t.lead)
            for word, cell in ((y - 1, c[y]), (y, CLASSES + c[y - 1])):
                ids = t.ids[word]
                known = ids >= 0
                np.add.at(cells, ids[known].astype(np.int64) * wide + cell[known], 1)
            if len(t.spots):
                end = np.r_[t.lead[1:], True]
                after, before = np.r_[c[1:], NONE], np.r_[NONE, c[:-1]]
                sides = np.c_[np.where(end, NONE, after), np.where(t.lead, NONE, before)][t.spots].astype(np.uint8)
                order = np.argsort(t.which, kind="stable")
                raw, number = sides[order].tobytes(), t.which[order]
                at = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
                for k, a, b in zip(number[at].tolist(), at.tolist(), [*at[1:].tolist(), len(number)], strict=True):
                    held.setdefault(t.rare[k], []).append(raw[2 * a : 2 * b])
            if len(held) > FLUSH:
                yield handed()
        yield handed()
        yield rows([JOINT], [None], [sparse(joint)])
        for b in range(n_blocks):
            own = cells[b * BLOCK * wide : (b + 1) * BLOCK * wide]
            if own.any():
                yield rows([b], [None], [sparse(own)])

    return run


def move_common(shared):
    """New classes of blocks of the list."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        after, before = shared.value
        both = np.vstack([after[:NONE], before[:NONE]])
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                total = dense(batch.column(2).slice(k, 1), BLOCK * 2 * CLASSES).reshape(BLOCK, 2 * CLASSES)
                out.append((total @ both).argmax(1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], ["block", "k"])

    return run


def move_rare(shared):
    """Counts and new classes of the words that are not in the list."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        after, before = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                raw = [b"".join(x) for x in part.column(1).to_pylist()]
                sides = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 2)
                start = np.cumsum([0, *[len(x) // 2 for x in raw[:-1]]])
                worth = np.add.reduceat(after[sides[:, 0]] + before[sides[:, 1]], start)
                c = np.add.reduceat((sides[:, 1] != NONE).astype(np.int64), start)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c), pa.array(worth.argmax(1).astype(np.int32))], ["w", "c", "k"])

    return run


def found(coded: DataFrame, rare: DataFrame | None) -> DataFrame:
    """The coded texts with counts and classes of their words that are not in the list."""
    if rare is None:
        return coded
    x = coded.select("uid", F.posexplode("rare").alias("j", "w")).join(rare, "w")
    x = x.groupBy("uid").agg(F.collect_list(F.struct("j", "c", "k")).alias("found"))
    return coded.join(x, "uid", "left")


PLACED = "doc_id long, train boolean, n_tokens long, n_known long, plus double, classes binary"


def place_pass(shared):
    """One row a text: its known tokens, the logs of their counts, and the class of every token."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words, common, bins = shared.value
        logs = np.log10(words.counts + 1.0)
        for batch in (x for b in batches for x in slices(b, "ids")):
            t = Tokens(batch)
            c, n = t.classes(batch, common, bins)
            plus = t.filled(logs, np.log10(n + 1.0), float)
            known = t.filled(np.ones(len(common), np.int64), (n > 0).astype(np.int64), np.int64)
            plus[t.lead], known[t.lead] = 0, 0
            raw = c.astype(np.uint8).tobytes()
            own = [raw[a : a + n] for a, n in zip(t.start.tolist(), t.size.tolist(), strict=True)]
            at = [batch.schema.get_field_index(x) for x in ("doc_id", "train")]
            sums = [np.add.reduceat(x, t.start) if len(own) else x for x in (known, plus)]
            cols = [*(batch.column(i) for i in at), pa.array(t.size - 1), *map(pa.array, sums), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in PLACED.split(", ")])

    return run


def class_tokens(batch):
    """Classes of all tokens of a batch of placed texts, the texts' first places, and which tokens lead."""
    import numpy as np

    own = batch.column(batch.schema.get_field_index("classes")).to_pylist()
    size = np.array([len(x) for x in own], np.int64)
    start = np.cumsum(size) - size
    c = np.frombuffer(b"".join(own), np.uint8).astype(np.int64)
    lead = np.zeros(len(c), bool)
    lead[start] = True
    return c, start, lead


def joint_pass(batches):
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    total = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in (x for b in batches for x in slices(b, "classes", SLICE // 4)):
        c, _, lead = class_tokens(batch)
        total += joint_of(c, lead)
    cols = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([JOINT], pa.int32()), pa.array([sparse(total)], pa.binary())]
    yield pa.RecordBatch.from_arrays(cols, ["part", "block", "counts"])


def summed(rows: DataFrame, parts: int):
    """Class bigrams of all parts."""
    found = added(rows.select("part", "block", "counts"), parts, CLASSES * CLASSES).select("counts").toArrow()
    return dense(found.column("counts"), CLASSES * CLASSES).reshape(CLASSES, CLASSES)


def pair_counts(words):
    """Bigrams of the starting items in a partition of coded texts: rows (block, counts) of ROWS matrix rows each."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        item = np.array([k if k < CLUSTERED else ending(w) for k, w in enumerate(words.value.words)], np.int64)
        total = np.zeros(ITEMS * ITEMS, np.int64)
        for batch in (x for b in batches for x in slices(b, "ids")):
            t = Tokens(batch)
            own = t.filled(item, np.array([ending(w) for w in t.rare], np.int64), np.int64)
            y = np.flatnonzero(~t.lead)
            total += np.bincount(own[y - 1] * ITEMS + own[y], minlength=len(total))
        blocks = total.reshape(-1, ROWS * ITEMS)
        some = [k for k in range(len(blocks)) if blocks[k].any()]
        part = [TaskContext.get().partitionId()] * len(some)
        cols = [pa.array(part, pa.int32()), pa.array(some, pa.int32()), pa.array([sparse(blocks[k]) for k in some], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["part", "block", "counts"])

    return run


def start_classes(coded: DataFrame, parts: int, shared, words: Words):
    """Classes of the list and of the endings by exchange of the starting items."""
    import numpy as np

    got = added(coded.mapInArrow(pair_counts(shared), BLOCKS), parts, ROWS * ITEMS).select("block", "counts").toArrow()
    pairs = np.zeros((ITEMS // ROWS, ROWS * ITEMS), np.int64)
    for k, block in enumerate(got["block"].to_pylist()):
        pairs[block] = dense(got["counts"].slice(k, 1), ROWS * ITEMS)
    of = exchange(pairs.reshape(ITEMS, ITEMS)).astype(np.uint8)
    return np.array([of[k if k < CLUSTERED else ending(w)] for k, w in enumerate(words.words)], np.uint8), of[CLUSTERED:]


def sweep(learned: DataFrame, parts: int, common, bins):
    """Every word moves to the class that its neighbours' classes make most likely: the list's classes, the table
    (w, c, k) of all other words, and the likelihood before."""
    import numpy as np

    share = learned.sparkSession.sparkContext.broadcast
    got = saved(learned.mapInArrow(gather_pass(share((common, bins))), GATHERED), "gathered")
    joint = summed(got.where(F.col("block") == JOINT), parts)
    frozen = share(weights(joint))
    lists = got.where("block = -2").groupBy("w").agg(F.collect_list("counts").alias("counts"))
    rare = saved(lists.mapInArrow(move_rare(frozen), "w binary, c long, k int"), "classes")
    moved = np.zeros(-(-len(common) // BLOCK) * BLOCK, np.uint8)
    blocks = added(got.where("block >= 0").select("part", "block", "counts"), parts, BLOCK * 2 * CLASSES)
    for r in blocks.mapInArrow(move_common(frozen), "block int, k binary").collect():
        moved[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["k"], np.uint8)
    discard(got)
    return moved[: len(common)], rare, likelihood(joint)


def fit(docs: DataFrame, train) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the table of all counts (w, c), and the placed texts."""
    import numpy as np

    share = docs.sparkSession.sparkContext.broadcast
    texts = docs.select("doc_id", "text", train.alias("train"))
    counts = saved(texts.where("train").select("text").mapInArrow(count_words, "w binary, n long").groupBy("w").agg(F.sum("n").alias("c")), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("c"), "w").limit(COMMON).toArrow()
    words = Words([bytes(x) for x in top["w"].to_pylist()], top["c"].to_pylist())
    shared = share(words)
    coded = saved(texts.mapInArrow(code_pass(shared), CODED), "coded")
    learned = coded.where("train").select("uid", "ids", "rare")
    parts = learned.rdd.getNumPartitions()
    start, bins = start_classes(learned, parts, shared, words)
    common, rare, before = sweep(learned, parts, start, bins)

    def placed(common, rare):
        out = saved(found(coded, rare).mapInArrow(place_pass(share((words, common, bins))), PLACED), "placed")
        joint = summed(out.where("train").select("classes").mapInArrow(joint_pass, BLOCKS), out.rdd.getNumPartitions())
        distinct = np.bincount(common, minlength=CLASSES)
        for r in rare.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect():
            distinct[r["k"]] += r["n"]
        return Model(words, np.r_[common, bins], joint, distinct, n, v), out, likelihood(joint)

    model, out, after = placed(common, rare)
    if after < before:
        discard(out)
        model, out, _ = placed(start, by_ending(words, counts, bins))
    discard(coded)
    return model, counts, out


def by_ending(words: Words, counts: DataFrame, bins) -> DataFrame:
    """(w, c, k) of the words that are not in the list, with their endings' classes."""
    listed = counts.sparkSession.createDataFrame([(w,) for w in words.words], "w binary")
    tail = F.pmod(F.crc32(F.substring("w", -3, 3)), F.lit(ENDINGS)).cast("int")
    return counts.join(listed, "w", "left_anti").select("w", "c", F.get(F.array(*[F.lit(int(b)) for b in bins]), tail).alias("k"))


def learn(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the table of all counts (w, c)."""
    return fit(train, F.lit(True))[:2]


def score_pass(shared):
    """The log10 probability of each placed text's classes and of its words in them, without the words' counts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        step, total = shared.value
        for batch in (x for b in batches for x in slices(b, "classes", SLICE // 4)):
            c, start, lead = class_tokens(batch)
            own = np.zeros(len(c))
            y = np.flatnonzero(~lead)
            own[y] = step[c[y - 1], c[y]] - total[c[y]]
            sums = np.add.reduceat(own, start) if len(start) else own
            cols = [batch.column(batch.schema.get_field_index(x)) for x in SCORED[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sums)], SCORED)

    return run


SCORED = ["doc_id", "train", "n_tokens", "n_known", "plus", "by_class"]


def score(placed: DataFrame, model: Model) -> DataFrame:
    shared = placed.sparkSession.sparkContext.broadcast((model.step, model.total))
    out = placed.mapInArrow(score_pass(shared), PLACED.replace("classes binary", "by_class double"))
    return out.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("plus") - F.col("n_tokens") * model.base_total).alias("base_score"),
        (F.col("plus") + F.col("by_class")).alias("score"),
    )


def report(docs: DataFrame) -> DataFrame:
    model, _, placed = fit(docs, crc32_mod(F.col("doc_id"), FOLDS) != HELD)
    return score(placed, model)
