import random

import pytest

from tidemark.llm import pieces

VOCAB = ["", "", "", *[""] * 256, "▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "▁▁", "c"]
SCORES = [0.0] * 259 + [-3.0, -1.5, -2.0, -2.5, -3.0, -1.0, -4.0, -2.2, -5.0, -2.0]


@pytest.fixture(scope="module")
def small():
    return pieces.Pieces(list(zip(VOCAB, SCORES, strict=True)), {b: 3 + b for b in range(256)})


def brute(m, text):
    """Best total score by plain dynamic programming over the whole marked text."""
    marked = [(pieces.MARK if c == " " else c, c == pieces.MARK) for c in " " + text]
    best = [0.0] + [float("-inf")] * len(marked)
    for j in range(len(marked)):
        for size in range(1, 6):
            part = marked[j : j + size]
            if len(part) == size and not any(own for _, own in part):
                p = "".join(c for c, _ in part)
                if p in VOCAB[259:]:
                    best[j + size] = max(best[j + size], best[j] + SCORES[VOCAB.index(p, 259)])
        c, own = marked[j]
        if own or c not in m.single:
            best[j + 1] = max(best[j + 1], best[j] + len(c.encode()) * m.byte_score)
    return best[-1]


def total(m, ids):
    return sum(m.byte_score if 3 <= i < 259 else SCORES[i] for i in ids)


def test_equals_brute_force_and_round_trips(small):
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("ab ac  é\n▁\x00") for _ in range(rng.randrange(0, 14)))
        raw = small.encode(text)
        ids = list(memoryview(raw).cast("I"))
        assert small.decode(raw) == text
        if text:
            assert total(small, ids) == pytest.approx(brute(small, text))
        else:
            assert ids == []


def test_real_model_round_trip_and_query(spark):
    import public_tokenizers

    path = public_tokenizers.path(pieces.MODEL)
    texts = ["Hello  world\n\tfoo ▁x é€😀", "", None, " ", "  lead", "trail  ", "x" * 20000, "a\x00b ▁", "Hello  world\n\tfoo ▁x é€😀"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r for r in pieces.encode(docs, path).collect()}
    assert {i: r["decoded"] for i, r in got.items()} == {i: t or "" for i, t in enumerate(texts)}
    out = {r["doc_id"]: r for r in pieces.report(docs, path).collect()}
    assert out[0]["ids_crc32"] == out[8]["ids_crc32"] and out[1]["n_ids"] == out[2]["n_ids"] == 0
    assert pieces.report(docs.limit(0), path).collect() == []
