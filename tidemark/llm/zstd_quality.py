"""Quality by compression: dictionaries of good and bad text, and the difference of what they compress to.

Two zstandard dictionaries are built from labelled good and bad texts. A text is cut into blocks (all of it, so that a
dictionary weighs alike in short and long texts), every block is compressed with either dictionary, and the difference
of the two sums per byte of text goes through a logistic curve that was fitted to labelled texts which neither
dictionary has seen.

Learned from at most SAMPLE_DOCS texts a label, chosen by a hash of id and text, and from the first SAMPLE_TEXT bytes
of each; in hash order they go in turns to the dictionaries and to the curve. Scoring takes whole texts.

Defined cases: a null or empty text has difference 0 and the score of that; where one label is missing, every score is
0.5; equal differences have equal scores; repeated rows and repeated labels are learned once and scored one by one; an
id that is labelled both 0 and 1 is learned as both; null ids have no label; very long texts are compressed block by
block; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, hashed, label_counts, sample_texts, text_bytes

SAMPLE_DOCS = 900  # learning texts a label at most
SAMPLE_TEXT = 20_000  # bytes that one of them adds at most
DICTIONARY = 112 * 1024
BLOCK = 2048
LEVEL = 3
FOLDS, HELD = 5, 0
PASS = 0.3  # scores from here on predict label 1


class Compressor:
    """Model: the two dictionaries' bytes and the curve."""

    def __init__(self, good: bytes, bad: bytes, slope: float = 1.0, shift: float = 0.0):
        self.data, self.slope, self.shift, self.tools = (good, bad), slope, shift, None

    def __getstate__(self):
        return self.__dict__ | {"tools": None}

    def difference(self, text: bytes) -> float:
        """(bad - good) / bytes: positive where the good dictionary compresses better."""
        import zstandard as z

        if self.tools is None:
            dicts = [z.ZstdCompressionDict(d) if d[:4] == b"\x37\xa4\x30\xec" else z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT) for d in self.data]
            for d in dicts:
                d.precompute_compress(level=LEVEL)
            self.tools = [z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False).compress for d in dicts]
        if not text:
            return 0.0
        good, bad = self.tools
        n = 0
        for k in range(0, len(text), BLOCK):
            block = text[k : k + BLOCK]
            n += len(bad(block)) - len(good(block))
        return n / len(text)

    def score(self, text: bytes) -> float:
        import math

        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * self.difference(text) + self.shift))))


def dictionary(texts: list[bytes]) -> bytes:
    import zstandard as z

    blocks = [t[k : k + BLOCK] for t in texts for k in range(0, len(t), BLOCK)]
    try:
        return z.train_dictionary(DICTIONARY, blocks, level=LEVEL).as_bytes()
    except z.ZstdError:  # too little text to select from: the text is the dictionary
        return b"".join(texts)[:DICTIONARY] or b"\n" * 8


def logistic(x, y, steps: int = 60) -> tuple[float, float]:
    """Slope and shift by Newton's method, with a small ridge."""
    import numpy as np

    x = np.asarray(x, float)
    scale = x.std() or 1.0
    a, w = np.c_[x / scale, np.ones(len(x))], np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        grad = a.T @ (p - y) + 1e-3 * w
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), grad)
    return w[0] / scale, w[1]


def learn(docs: DataFrame, labels: DataFrame) -> Compressor | None:
    rows = labels.where(F.col("quality").isin(0, 1) & (crc32_mod(F.col("doc_id"), FOLDS) != HELD))
    rows = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
    counts = label_counts(rows, "quality")
    share = F.when(F.col("quality") == 1, 2.0 * SAMPLE_DOCS / counts.get(1, 1)).otherwise(2.0 * SAMPLE_DOCS / counts.get(0, 1))
    picked = F.broadcast(rows.where(hashed("doc_id") < share))  # about 4 * SAMPLE_DOCS distinct ids, at any size
    texts = docs.select("doc_id", "text").where(F.col("text") != "").join(picked, "doc_id")
    found = sample_texts(texts, "quality", dict.fromkeys((0, 1), 1), SAMPLE_DOCS, SAMPLE_TEXT)
    parts = {(q, half): [t for _, t in found.get(q, [])][half::2] for q in (0, 1) for half in (0, 1)}
    if not all(parts.values()):
        return None
    model = Compressor(dictionary(parts[1, 0]), dictionary(parts[0, 0]))
    import numpy as np

    x, y = zip(*[(model.difference(t), float(q)) for q in (0, 1) for t in parts[q, 1]], strict=True)
    model.slope, model.shift = logistic(x, np.array(y))
    return model


def predict(docs: DataFrame, model: Compressor | None) -> DataFrame:
    """doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            score = [0.5 if m is None else m.score(t) for t in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = predict(docs, learn(docs, labels))
    held = crc32_mod(F.col("doc_id"), FOLDS) == HELD
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PASS).cast("int").alias("predicted"))
