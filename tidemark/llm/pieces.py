"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

A text gets a leading space, and spaces become the mark U+2581. The automaton reads the marked text once; at each
position its output links give all pieces that end there, and each relaxes the best score of the position. A character
that no one-character piece covers is spelled in byte pieces, each of which scores PENALTY below the lowest piece. The
ids are those of the best total score; among equal scores the longest last piece wins. As a mark only ever begins a
piece, no piece crosses from a word into the next mark, so words are encoded one by one and cached.

decode() is the exact inverse: pieces and bytes are joined, marks become spaces, the leading space goes. A U+2581 in
the text itself is spelled in bytes.

Defined cases: a null or empty text has no ids and decodes to the empty text; a very long word is one linear pass;
repeated rows are encoded one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import array
import zlib

from pyspark.sql import DataFrame

from .common import text_bytes

MARK = "▁"
PENALTY = 10.0
CACHE = 250_000  # words in each of the two generations of an executor's cache
MODEL = "piece_bpe_32k.model"


class Pieces:
    """Automaton and tables of one model."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_ids: dict[int, int]):
        """vocabulary: (piece, score) by id, with an empty piece for what isn't text; byte_ids: byte -> id."""
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.single = set()
        self.table = [p.replace(MARK, " ").encode() for p, _ in vocabulary]
        for b, i in byte_ids.items():
            self.table[i] = bytes([b])
        self.byte_ids = byte_ids
        lowest = 0.0
        for i, (p, score) in enumerate(vocabulary):
            if p and i not in byte_ids.values():
                if MARK in p.lstrip(MARK):
                    raise ValueError(f"piece {i} crosses a word")
                self.automaton.add_word(p, (len(p), score, i))
                lowest = min(lowest, score) if score > -1e8 else lowest
                if len(p) == 1:
                    self.single.add(p)
        self.automaton.make_automaton()
        self.byte_score = lowest - PENALTY
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def viterbi(self, word: str, own: str = "") -> list[int]:
        """Ids of the best split of a marked word; own: a character that stands for marks of the text itself."""
        n = len(word)
        best, back = [float("-inf")] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        done = 0  # positions up to here are final but for byte edges

        def spell(upto: int) -> None:
            nonlocal done
            for j in range(done, upto):
                if word[j] not in self.single:
                    raw = (MARK if word[j] == own else word[j]).encode()
                    s = best[j] + len(raw) * self.byte_score
                    if s > best[j + 1]:
                        best[j + 1], back[j + 1] = s, (j, raw)
            done = max(done, upto)

        for end, (size, score, i) in self.automaton.iter(word):
            if end > done:
                spell(end)
            start = end + 1 - size
            s = best[start] + score
            if s > best[end + 1] or (s == best[end + 1] and start < back[end + 1][0]):
                best[end + 1], back[end + 1] = s, (start, i)
        spell(n)
        out = []
        while n:
            n, what = back[n]
            out += [self.byte_ids[b] for b in reversed(what)] if isinstance(what, bytes) else [what]
        return out[::-1]

    def _word(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array.array("I", self.viterbi(word)).tobytes()
        self.new[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids."""
        if not text:
            return b""
        if MARK in text:  # rare: stand-in characters depend on the text, so nothing is cached
            own = next(c for c in map(chr, range(0xF0000, 0x10FFFF)) if c not in text and c not in self.single)
            marked = MARK + text.replace(MARK, own).replace(" ", MARK)
            return array.array("I", self.viterbi(marked, own)).tobytes()
        words = text.split(" ")
        if "" in words:  # runs of spaces stay with the word after them
            runs, pad = [], ""
            for w in words[:-1]:
                pad += MARK
                if w:
                    runs.append(pad + w)
                    pad = ""
            words = [*runs, pad + MARK + words[-1]]
        else:
            words = [MARK + w for w in words]
        get, out = self.new.get, []
        for w in words:
            ids = get(w)
            out.append(self._word(w) if ids is None else ids)
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        table = self.table
        return b"".join([table[i] for i in memoryview(ids).cast("I")])[1:].decode()


def from_model(path: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    vocabulary, byte_ids = [], {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:-1], 16)] = i
        text = not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        vocabulary.append((piece if text else "", sp.get_score(i)))
    return Pieces(vocabulary, byte_ids)


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = from_model(path)
    return _models[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian uint32), decoded (the text that the ids decode to)."""

    def run(batches):
        import pyarrow as pa

        m = model(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                ids = [m.encode(t.decode()) for t in text_bytes(part)]
                cols = [part.column(0), pa.array(ids, pa.binary()), pa.array([m.decode(x) for x in ids])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256; digests are taken where the ids are made."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        m = model(path)
        for batch in batches:
            rows = []
            for t in text_bytes(batch):
                ids = m.encode(t.decode())
                rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(m.decode(ids).encode()).hexdigest()))
            n, crc, sha = zip(*rows, strict=True) if rows else ((), (), ())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_ids long, ids_crc32 long, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
