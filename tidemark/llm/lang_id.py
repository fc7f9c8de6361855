"""Language ID by prediction by partial matching: byte context trees with frozen statistics.

Every language has counts of bytes after contexts of up to ORDER bytes. The code length of a byte is that of its
longest seen context, with escape probability distinct / (total + distinct) to the next shorter one (method C), down to
the uniform byte. The statistics are frozen, so the lengths of all bytes are read from tables of each language: context
of DENSE bytes -> longest seen node, (node, next older byte) -> the node one longer for each order beyond, and (node,
byte) -> bits. A text's code length is the exact sum over all its bytes; the language with the shortest code wins and
its posterior is the score.

Learned from at most SAMPLE_DOCS texts a language, chosen by a hash of id and text, and from the first SAMPLE_TEXT
bytes of each; scoring takes whole texts, PIECE bytes at a time.

Defined cases: a null text and a text without a letter are ``und`` with score 0; so is every text if there is nothing
to learn from; a language whose learning texts are all null or empty is not learned; ties go to the language first in
the alphabet; repeated rows are learned once and scored one by one; null ids are ids like others; very long texts cost
no more memory than PIECE bytes; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, label_counts, sample_texts, text_bytes

ORDER, DENSE = 4, 3  # bytes of the longest contexts, and of those that have a table of all contexts
SAMPLE_DOCS = 300  # learning texts a language at most
SAMPLE_TEXT = 20_000  # bytes that one of them adds at most
PIECE = 1 << 20  # bytes scored at once
FOLDS, HELD = 3, 1


class Trees:
    """Frozen tables of all languages over a common alphabet of byte symbols."""

    def __init__(self, texts: dict[str, list[bytes]]):
        import numpy as np

        self.langs = sorted(texts)
        joined = {lang: np.frombuffer(b"\n".join(texts[lang]) + b"\n", np.uint8) for lang in self.langs}
        present = np.zeros(256, bool)
        for a in joined.values():
            present[a] = True
        self.size = a_size = int(present.sum()) + 1  # the last symbol stands for all bytes that were never seen
        self.symbol = np.full(256, a_size - 1, np.int32)
        self.symbol[present] = np.arange(a_size - 1)
        self.tables = [self._tables(self.symbol[joined[lang]].astype(np.int64)) for lang in self.langs]

    def _tables(self, s):
        import numpy as np

        n = self.size
        rows = [np.full((1, n), 1 / 256)]  # one for each node: probabilities of all symbols
        base = {}
        below = None
        first = 1
        for order in range(ORDER + 1):
            places = max(0, len(s) - order)  # a language may have less text than a context
            code = np.zeros(places, np.int64)
            for k in range(order):
                code = code * n + s[k : places + k]
            ctx, inverse = np.unique(code, return_inverse=True)
            counts = np.bincount(inverse * n + s[order:], minlength=len(ctx) * n).reshape(len(ctx), n)
            total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            if order == 0:
                shorter = rows[0]
            else:  # the parent of a context is the context without its oldest byte; it was seen whenever the context was
                parent = ctx % n ** (order - 1)
                shorter = below[1][np.minimum(np.searchsorted(below[0], parent), len(below[0]) - 1)]
            p = np.where(counts > 0, counts, distinct * shorter) / (total + distinct)
            rows.append(p)
            base[order] = (ctx, first)
            first += len(ctx)
            below = (ctx, p)
        node = np.zeros(n**DENSE, np.int32)
        for order in range(DENSE + 1):
            ctx, at = base[order]
            view = node.reshape(-1, n**order)  # all longer contexts that end in one of these
            view[:, ctx] = at + np.arange(len(ctx), dtype=np.int32)
        longer = []
        for order in range(DENSE + 1, ORDER + 1):
            ctx, at = base[order]
            parents, first = base[order - 1]
            own = np.zeros((max(1, len(parents)), n), np.int32)
            own[np.searchsorted(parents, ctx % n ** (order - 1)), ctx // n ** (order - 1)] = at + np.arange(len(ctx), dtype=np.int32)
            longer.append((first, own.ravel()))
        return node, longer, (-np.log2(np.concatenate(rows))).astype(np.float32).ravel()

    def nodes(self, table, s):
        """The longest seen context's node before each symbol from the ORDER-th on."""
        import numpy as np

        node, longer, _ = table
        n, m = self.size, len(s) - ORDER
        code = np.zeros(m, np.int64)
        for k in range(DENSE, 0, -1):
            code = code * n + s[ORDER - k : ORDER - k + m]
        at = node[code]
        for k, (first, more) in enumerate(longer, DENSE + 1):
            own = at - first  # shorter nodes come before
            found = more[np.maximum(own, 0) * n + s[ORDER - k : ORDER - k + m]]
            at = np.where((own >= 0) & (found > 0), found, at)
        return at

    def lengths(self, texts: list[bytes]):
        """Bits of each text under each language."""
        import numpy as np

        out = np.zeros((len(texts), len(self.langs)))
        n = self.size
        for group in slices(texts):
            s = self.symbol[np.frombuffer(b"".join(part for _, part in group), np.uint8)]
            row = np.array([k for k, _ in group])
            size = np.array([len(part) - ORDER for _, part in group])
            start = np.cumsum(size + ORDER) - size - ORDER
            for j, table in enumerate(self.tables):
                bits = table[2][self.nodes(table, s).astype(np.int64) * n + s[ORDER:]]
                total = np.r_[0.0, np.cumsum(bits, dtype=np.float64)]
                np.add.at(out[:, j], row, total[start + size] - total[start])
        return out


def slices(texts: list[bytes]):
    """Groups of (number, ORDER bytes of context and up to PIECE bytes) of about PIECE bytes; empty texts have none."""
    group, total = [], 0
    for k, t in enumerate(texts):
        for at in range(0, len(t), PIECE):
            before = t[at - ORDER : at] if at else b"\n" * ORDER
            group.append((k, before + t[at : at + PIECE]))
            total += len(group[-1][1])
            if total >= PIECE:
                yield group
                group, total = [], 0
    if group:
        yield group


def learn(docs: DataFrame) -> Trees | None:
    """From the bounded sample of the learning folds."""
    rows = docs.where(F.col("lang").isNotNull() & (crc32_mod(F.col("doc_id"), FOLDS) != HELD)).select("doc_id", "lang", "text")
    found = sample_texts(rows, "lang", label_counts(rows, "lang"), SAMPLE_DOCS, SAMPLE_TEXT)
    texts = {lang: [t for _, t in got if t] for lang, got in found.items()}
    texts = {lang: got for lang, got in texts.items() if got}
    return Trees(texts) if texts else None


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            raw = text_bytes(batch)
            known = [model is not None and any(map(str.isalpha, t.decode())) for t in raw]
            lang, score = ["und"] * len(raw), np.zeros(len(raw))
            if model is not None and raw:
                bits = model.lengths(raw)
                best = bits.argmin(1)
                odds = np.exp2(-(bits - bits[np.arange(len(raw)), best][:, None])).sum(1)
                lang = [model.langs[b] if k else "und" for k, b in zip(known, best, strict=True)]
                score = np.where(known, 1 / odds, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    out = predict(docs, learn(docs))
    held = crc32_mod(F.col("doc_id"), FOLDS) == HELD
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
