"""Bounded-space online packing of token ids into windows of 2048.

Every partition keeps at most OPEN windows. The rest of a document (after whole windows are cut off) goes to the open
window that it fits best. If it fits none and no further window may be opened, the fullest window is filled up with
the head of the document and emitted, and what is left of the document is placed anew. At the end the windows still
open are merged: the leftovers of GROUP partitions (a bounded number of tokens) are cut into full windows, and the
last rest into sequences whose lengths are powers of two, so no position is padded.

Ids come from a cache by white-space-delimited chunk. The tokenizer removes white space, and none of its rules looks
across it, so the chunks' ids in a row are the text's ids; the tests compare them. Chunks not in the cache are given to
the tokenizer's model as words if they are plain letters and marks; the others are encoded together.

Defined cases: a null or empty text is the end id alone; equal texts and repeated rows are packed one by one; an empty
table gives no piece; further columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_bytes

WINDOW = 2048
OPEN = 32  # windows a partition keeps open
GROUP = 16  # partitions whose leftovers are merged together
END_ID = 1
CACHE = 400_000  # chunks in each of the two generations of an executor's cache
TOKENIZER = "word_bpe_49k.json"

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ROW = f"{PIECE}, part int, ids binary"


class Chunks(dict):
    """Ids of chunks. One of plain letters with ASCII marks around them is looked up in parts and by its lower case, since
    the tokenizer lower-cases and divides letters from marks; a part is one word to its model. Other chunks that are not
    known give None and wait."""

    PLAIN = re.compile("([!-&(-/:;=-@[-`{-~]*+)([a-zß-öø-ÿ]*+)([!-&(-/:;=-@[-`{-~]*+)")  # without ' and <: 's, <|endoftext|>

    def __init__(self, model, ids: list[bytes], old: dict[bytes, bytes]):
        from tokenizers.pre_tokenizers import ByteLevel

        self.model, self.ids, self.old, self.waiting = model, ids, old, {}
        to = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: to.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def __missing__(self, chunk: bytes) -> bytes | None:
        ids = self.old.get(chunk)
        if ids is not None:
            self[chunk] = ids
            return ids
        if chunk.isalpha() and chunk.islower():
            word = chunk.decode()
        else:
            found = self.PLAIN.fullmatch(chunk.decode().lower())
            if not found:
                self.waiting[chunk] = None
                return None
            before, word, after = found.groups()
            own = (word or before).encode()
            if own != chunk:
                known = own in self
                ids = self[own]
                if word and before:
                    ids = self[before.encode()] + ids
                if word and after:
                    ids += self[after.encode()]
                if known:  # rare spellings of rare words aren't worth a place
                    self[chunk] = ids
                return ids
            word = word.translate(self.letters) or before
        of = self.ids
        ids = self[chunk] = b"".join([of[x.id] for x in self.model.tokenize(word)])
        return ids


class ChunkEncoder:
    """Ids of texts as little-endian uint32 bytes."""

    DIVIDER = "<|endoftext|>"

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.divider = self.tokenizer.token_to_id(self.DIVIDER)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.ids = [k.to_bytes(4, "little") for k in range(len(self.last))]
        self.model = self.tokenizer.model
        self.chunks = Chunks(self.model, self.ids, {})

    def _encode(self, text: str):
        import numpy as np

        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, chunks: list[bytes]) -> None:
        """A chunk of letters is one word to the tokenizer, which marks the last id of a word; such chunks are encoded
        as one text. The others are kept apart by a special token, or encoded alone if they hold its first letters."""
        import numpy as np

        letters, others = [], []
        for c in chunks:
            if b"<|" in c:
                self.chunks[c] = self._encode(c.decode()).tobytes()
            else:
                (letters if c.decode().isalpha() else others).append(c)
        for k in range(0, len(letters), 20_000):
            part = letters[k : k + 20_000]
            ids = self._encode(" ".join(c.decode() for c in part))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                self._store(part, ids, np.r_[0, ends[:-1]], ends)
            else:  # a letter whose lower case isn't letters alone makes two words of one
                others += part
        for k in range(0, len(others), 20_000):
            part = others[k : k + 20_000]
            ids = self._encode(self.DIVIDER.join(c.decode() for c in part))
            at = np.flatnonzero(ids == self.divider)
            self._store(part, ids, np.r_[0, at + 1], np.r_[at, len(ids)])

    def _store(self, chunks: list[bytes], ids, start, end) -> None:
        raw = ids.tobytes()
        self.chunks.update((c, raw[a:b]) for c, a, b in zip(chunks, (4 * start).tolist(), (4 * end).tolist(), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 500):
            ids_of, late = self.chunks.__getitem__, []
            for t in texts[at : at + 500]:
                words = t.split()
                ids = list(map(ids_of, words))
                if None in ids:
                    late.append((len(out), words))
                    ids = []
                out.append(b"".join(ids))
            if late:
                self._learn(list(self.chunks.waiting))
                self.chunks.waiting.clear()
                for k, words in late:
                    out[k] = b"".join(map(ids_of, words))
            if len(self.chunks) > CACHE:
                self.chunks.old = {}
                self.chunks = Chunks(self.model, self.ids, self.chunks)
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


class Packer:
    """Open windows of one partition; every emitted window is a list of pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW, most: int = OPEN):
        self.window, self.most = window, most
        self.room: list[int] = []  # sorted free space of the open windows
        self.open: list[list[tuple]] = []  # their pieces, in the same order

    def _put(self, room: int, pieces: list[tuple]) -> None:
        k = bisect.bisect_left(self.room, room)
        self.room.insert(k, room)
        self.open.insert(k, pieces)

    def add(self, doc_id, ids: bytes) -> list[list[tuple]]:
        """The windows that became full."""
        n, at, full = len(ids) // 4, 0, []
        while n - at >= self.window:
            full.append([(doc_id, at, ids[4 * at : 4 * (at + self.window)], n)])
            at += self.window
        while at < n:
            rest = n - at
            k = bisect.bisect_left(self.room, rest)
            if k == len(self.room) and len(self.room) < self.most:
                self._put(self.window - rest, [(doc_id, at, ids[4 * at :], n)])
                break
            k = k if k < len(self.room) else 0  # best fit, or else the fullest
            room, pieces = self.room.pop(k), self.open.pop(k)
            put = min(room, rest)
            pieces.append((doc_id, at, ids[4 * at : 4 * (at + put)], n))
            at += put
            if put == room:
                full.append(pieces)
            else:
                self._put(room - put, pieces)
        return full


def rows(windows: list[list[tuple]], part: int, first: int, keep: bool):
    """An Arrow batch of pieces; keep: their ids too."""
    import pyarrow as pa

    cols = [[] for _ in range(9)]
    for w, pieces in enumerate(windows):
        offset = 0
        for doc_id, start, ids, n in pieces:
            row = (doc_id, start, len(ids) // 4, zlib.crc32(ids), n, first + 2 * w, offset, part, ids if keep else None)
            for c, v in zip(cols, row, strict=True):
                c.append(v)
            offset += len(ids) // 4
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
    names = [x.split()[0] for x in ROW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def pack_partition(path: str):
    def run(batches):
        from pyspark import TaskContext

        part, packer, enc, n = TaskContext.get().partitionId(), Packer(), encoder(path), 0
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = text_bytes(batch)
            for k in range(0, len(ids), 500):
                full = []
                for doc_id, b in zip(ids[k : k + 500], enc.encode(texts[k : k + 500]), strict=True):
                    full += packer.add(doc_id, b + end)
                yield rows(full, part, (part << 32) + 2 * n, False)
                n += len(full)
        yield rows(packer.open, part, (part << 32) + 2 * n, True)

    return run


def merge_group(key, left):
    """Leftovers of a group of partitions: full windows, then sequences of powers of two."""
    import pyarrow as pa

    left = left.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
    total, sizes = sum(r["length"] for r in left), []
    sizes = [WINDOW] * (total // WINDOW) + [1 << k for k in range(WINDOW.bit_length(), -1, -1) if (total % WINDOW) >> k & 1]
    windows, room = [], 0
    for r in left:
        at = 0
        while at < r["length"]:
            if not room:
                room = sizes[len(windows)]
                windows.append([])
            put = min(room, r["length"] - at)
            windows[-1].append((r["doc_id"], r["start"] + at, r["ids"][4 * at : 4 * (at + put)], r["doc_tokens"]))
            at, room = at + put, room - put
    return pa.Table.from_batches([rows(windows, -1, (key[0].as_py() << 32) + 1, False)])


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row a piece: which ids of which document stand where in which sequence."""
    pieces = saved(docs.select("doc_id", "text").mapInArrow(pack_partition(tokenizer_path), ROW), "pieces")
    left = pieces.where(F.col("ids").isNotNull())
    merged = left.groupBy(F.floor(F.col("part") / GROUP).cast("long").alias("g")).applyInArrow(merge_group, ROW)
    names = [x.split()[0] for x in PIECE.split(", ")]
    return pieces.where(F.col("ids").isNull()).select(*names).unionByName(merged.select(*names))
