"""Language model, language ID, fingerprints, packing and the compression classifier."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import class_lm, common, lang_id, packing, simhash, zstd_quality


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.mark.parametrize("common", [150_000, 5])
def test_class_lm_base_and_counts(docs, rows, common, monkeypatch):
    """With few words in the list nearly all are joined."""
    monkeypatch.setattr(class_lm, "COMMON", common)
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in rows}
    c = Counter(w for i, ws in tokens.items() if fold(i, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    got = class_lm.report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r["held_out"] == (fold(r["doc_id"], 7) == 2) and r["score"] < 0
    assert class_lm.report(docs.limit(0)).collect() == []


def test_class_probabilities_sum_to_one(docs):
    model, counts = class_lm.learn(docs)
    assert np.allclose((10**model.step).sum(1), 1)
    c = {bytes(r["w"]): r["c"] for r in counts.collect()}
    total = np.ones(class_lm.CLASSES)  # one place for words never seen
    for w, n in c.items():
        total[model.of[model.words.look([w])[1][0]]] += n + 1
    assert np.allclose(total / 10**model.total, 1)


def test_slices_are_all_rows_once():
    import pyarrow as pa

    sizes = [5, 0, 90, 3, 3, 3, 200, 1, 0]
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * n for n in sizes], pa.binary())], ["ids"])
    for size in (1, 7, 100, 10**6):
        parts = [p.column(0).to_pylist() for p in class_lm.slices(batch, "ids", size)]
        assert [len(x) for p in parts for x in p] == sizes and all(sum(map(len, p[:-1])) <= size for p in parts)
    assert list(class_lm.slices(batch.slice(0, 0), "ids")) == []


def test_exchange_finds_blocks():
    rng = np.random.default_rng(0)
    pairs = np.zeros((40, 40))
    for i in range(40):
        for j in range(40):
            pairs[i, j] = rng.integers(20, 30) if (i % 2) != (j % 2) else 0
    of = class_lm.exchange(pairs, classes=2)
    assert len(set(of[::2])) == len(set(of[1::2])) == 1 and of[0] != of[1]


def test_lang_id_code_lengths():
    texts = {"a": [b"abracadabra", b"abab"], "b": [b"xyzzy xyz", b"zz"]}
    trees = lang_id.Trees(texts)
    for text in (b"abra", b"xyz", b"qqab\xff", b"", b"zzabz" * 40):
        bits = trees.lengths([b"pad", text])[1]
        for k, lang in enumerate(trees.langs):
            assert bits[k] == pytest.approx(plain_bits(b"\n".join(texts[lang]) + b"\n", text, trees), rel=1e-4, abs=1e-3)


def plain_bits(train, text, trees):
    """Byte by byte, over context counts in dicts."""
    counts = {}
    s = [int(trees.symbol[c]) for c in train]
    for k in range(lang_id.ORDER + 1):
        for i in range(k, len(s)):
            counts.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1

    def p(ctx, c):
        if ctx not in counts:
            return p(ctx[1:], c)
        n = counts[ctx]
        total, distinct = sum(n.values()), len(n)
        if n[c]:
            return n[c] / (total + distinct)
        return distinct / (total + distinct) * (p(ctx[1:], c) if ctx else 1 / 256)

    x = [int(trees.symbol[c]) for c in b"\n" * lang_id.ORDER + text]
    return sum(-math.log2(p(tuple(x[i - lang_id.ORDER : i]), x[i])) for i in range(lang_id.ORDER, len(x)))


def test_lang_id_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.report(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_lang_id_edges(docs, spark):
    got = {r["doc_id"]: r for r in lang_id.report(docs).collect()}
    for i, t in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        assert (got[i]["lang_pred"] == "und") == (not any(map(str.isalpha, t or "")))
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in lang_id.report(none).collect()} == {"und"}


def test_zstd_quality_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = zstd_quality.report(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    auc = np.searchsorted(np.sort(bad), good).mean() / len(bad)
    assert auc > 0.97 and got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == got["predicted"]).all()


def test_zstd_quality_without_labels(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in zstd_quality.report(docs, labels).collect()} == {0.5}




def test_simhash_report(docs, rows):
    got = {r["doc_id"]: r for r in simhash.report(docs).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        nxt = got[order[(k + 1) % len(order)][0]]
        x = bin(int(got[i]["fingerprint"], 16) ^ int(nxt["fingerprint"], 16)).count("1")
        assert got[i]["near_next"] == pytest.approx(max(0, 1 - 2 * x / 128))
        y = bin(int(got[i]["fingerprint"], 16) ^ int(got[i]["edited_fingerprint"], 16)).count("1")
        assert got[i]["near_edited"] == pytest.approx(max(0, 1 - 2 * y / 128))
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", set()).add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert simhash.report(docs.limit(0)).collect() == []


def test_simhash_votes(spark, rows):
    """Fingerprints against votes counted word by word."""
    data = [(k, t or "") for k, (_, t) in enumerate(rows[:40])]
    d = spark.createDataFrame(data, "k int, text string")
    words = d.select("k", F.explode(F.split("text", simhash.WHITE)).alias("w")).select("k", F.xxhash64("w").alias("a"), F.xxhash64("w", F.lit(1)).alias("b"), simhash.weight(F.col("w")).alias("v"))
    votes = {}
    for r in words.collect():
        v = votes.setdefault(r["k"], [0] * 128)
        for j in range(128):
            v[j] += r["v"] * (1 if (r["ab"[j // 64]] >> (j % 64)) & 1 else -1)
    for r in simhash.fingerprints(d, ["k"]).collect():
        bits = [(r["hi" if j < 64 else "lo"] >> (j % 64)) & 1 for j in range(128)]
        assert bits == [int(x > 0) for x in votes[r["k"]]]


def test_simhash_near_pairs(spark):
    rng = random.Random(6)
    prints = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(30)]
    for hi, lo in prints[:12]:
        for flips in (1, 3, 4):
            for _ in range(flips):
                hi ^= 1 << rng.randrange(62)
            prints.append((hi, lo))
    d = spark.createDataFrame([*prints, *prints[:5]], "hi long, lo long")
    got = {tuple(r) for r in simhash.near_pairs(d, 3).collect()}
    own = sorted(set(prints))
    want = {(*a, *b, n) for k, a in enumerate(own) for b in own[k + 1 :] if (n := bin(a[0] ^ b[0]).count("1") + bin(a[1] ^ b[1]).count("1")) <= 3}
    assert got == want and len(want) > 10


PATH = public_tokenizers.path(packing.TOKENIZER)


def test_chunks_give_the_texts_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rng = random.Random(9)
    odd = ["don't stop... U.S.A. it's 3.14 ÀÉ é x́. ́lead", "a<|endoftext|>b <|x", "ＡＢ １２ ½ ٣٤", "Σίσυφος ΟΔΟΣ İI ß", "\x1cq\x85r s\xa0t", "end, of. line.\nNew,\tTab.", "ﬁ Ǆ ʰ ª º ⅷ"]
    texts = [t or "" for _, t in rows] + odd + ["".join(rng.choice("aB.,'<|> é́\n1Ⅷ中!") for _ in range(60)) for _ in range(300)]
    enc = packing.ChunkEncoder(PATH)
    for _ in range(2):  # with an empty cache, and with a full one
        for text, ids in zip(texts, enc.encode([x.encode() for x in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_plain_words_are_spelled_once_by_the_model(monkeypatch):
    """Whatever their case and the marks around them; the whole tokenizer isn't needed for them."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    enc, rng = packing.ChunkEncoder(PATH), random.Random(12)
    enc.tokenizer = None
    words = ["".join(rng.choice("abcdeéßüñÿ") for _ in range(rng.randrange(1, 12))) for _ in range(200)]
    texts = [" ".join(rng.choice(["", '"', "(", "--"]) + rng.choice([w, w.title(), w.upper()]) + rng.choice(["", ".", ",%%%", "|&)"]) for w in rng.choices(words, k=50)) for _ in range(100)]
    texts += ["... -- | ![]", "É", "Ÿ ẞ Å", ""]
    for most in (10, 400_000):
        monkeypatch.setattr(packing, "CACHE", most)
        for text in texts:
            assert np.frombuffer(enc.encode([text.encode()])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text
    words = ["don't", "1st", "<b>", "e\u0301", "ÀΣ", "x²"]
    enc = packing.ChunkEncoder(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode([w.encode() for w in words])] == [t.encode(w, add_special_tokens=False).ids for w in words]


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH).toPandas()
    size = got.groupby("sequence_id")["length"].sum()
    assert ((size == 2048) | size.map(lambda n: n & (n - 1) == 0)).all() and size.max() <= 2048
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id")["length"].cumsum() - g["length"] == g["offset"]).all()
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own, at = got[got.doc_id == i].sort_values("start"), 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert packing.pack(docs.limit(0), PATH).collect() == []


def test_packer_keeps_few_windows_open():
    rng, p, n, out = random.Random(1), packing.Packer(64, 4), 0, 0
    for k in range(500):
        m = rng.randrange(1, 150)
        n += m
        for w in p.add(k, b"\0\0\0\0" * m):
            assert sum(len(x[2]) for x in w) == 4 * 64
            out += 64
        assert len(p.open) <= 4 and p.room == sorted(p.room) and all(0 < r < 64 for r in p.room)
    assert n == out + sum(64 - r for r in p.room)


def test_class_lm_gives_each_rare_word_its_own_class(spark, monkeypatch):
    """Words of one ending that stand in opposite contexts, and far too rare to be clustered at the start."""
    monkeypatch.setattr(class_lm, "COMMON", 40)
    rng = random.Random(3)
    left, right = [f"a{k}" for k in range(15)], [f"b{k}" for k in range(15)]
    verbs, nouns = [f"verb{k}xyz" for k in range(60)], [f"noun{k}xyz" for k in range(60)]
    texts = []
    for k in range(600):
        texts.append(" ".join(x for _ in range(20) for x in (rng.choice(left), rng.choice(left), rng.choice(right), rng.choice(right))) + f" {rng.choice(left)} {verbs[k % 60]} {rng.choice(left)} {rng.choice(right)} {nouns[k % 60]} {rng.choice(right)}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, _, placed = class_lm.fit(docs, F.lit(True))
    of = {}
    for r in placed.collect():
        words = [b"\n", *texts[r["doc_id"]].encode().split(), b"\n"]
        for w, c in zip(words, r["classes"], strict=True):
            assert of.setdefault(w, c) == c
    assert {of[w.encode()] for w in verbs}.isdisjoint({of[w.encode()] for w in nouns})
    total = np.ones(class_lm.CLASSES)
    for w, n in Counter(w for t in texts for w in [*t.split(), "\n"]).items():
        total[of[w.encode()]] += n + 1
    assert np.allclose(total / 10**model.total, 1)


def test_zstd_quality_long_text_leaves_no_half_empty(spark):
    """A very long sampled text takes no more room than SAMPLE_TEXT, and rows that repeat are learned once."""
    rng = random.Random(4)
    good, bad = ["clear", "prose", "with", "sense"], ["buy", "now", "!!!", "$$$"]
    data, marks = [], []
    for k in range(80):
        q = k % 2
        data.append((k, " ".join(rng.choice(good if q else bad) for _ in range(80)) * (4000 if k < 4 else 1)))
        marks.append((k, q))
    docs = spark.createDataFrame(data + [data[9]] * 50 + [(None, "x y")] * 9, "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(None, 1)] * 9, "doc_id long, quality int")
    model = zstd_quality.learn(docs, labels)
    assert model is not None and min(map(len, model.data)) > 8
    rows = docs.join(labels, "doc_id").select("doc_id", "quality", "text")
    got = common.sample_texts(rows, "quality", {0: 1, 1: 1}, 20, 300)
    assert all(len(t) == 20 and len(set(t)) == 20 and max(len(x) for _, x in t) == 300 for t in got.values())


def test_zstd_quality_against_plain(docs, spark):
    """The whole report, computed text by text from the learned dictionaries; nulls, repeated rows, clashing names."""
    import zstandard

    rows = [r for r in docs.collect()]
    marks = [(r["doc_id"], int("the" in (r["text"] or ""))) for r in rows]
    labels = spark.createDataFrame(marks, "doc_id long, quality int").withColumn("text", F.lit("clash"))
    model = zstd_quality.learn(docs, labels)
    packers = [zstandard.ZstdCompressor(level=zstd_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO), write_content_size=False) for d in model.data]
    more = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    got = zstd_quality.report(more, labels).collect()
    texts = {(r["doc_id"], r["text"]) for r in more.collect()}
    want = Counter()
    for r in more.collect():
        t = (r["text"] or "").encode()
        sums = [sum(len(p.compress(t[k : k + zstd_quality.BLOCK])) for k in range(0, len(t), zstd_quality.BLOCK)) for p in packers]
        x = (sums[1] - sums[0]) / len(t) if t else 0.0
        score = 1 / (1 + math.exp(-max(-50.0, min(50.0, model.slope * x + model.shift))))
        held = zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0
        want[r["doc_id"], held, round(score, 9), int(score >= 0.3)] += 1
    assert Counter((r["doc_id"], r["held_out"], round(r["score"], 9), r["predicted"]) for r in got) == want and texts
    assert zstd_quality.report(docs.limit(0), labels).collect() == []


def test_lang_id_learns_what_there_is(spark):
    """A language without text, null and repeated ids and texts shorter than a context; the report against plain codes."""
    data = [(k, "plain words here", "en") for k in range(20)] + [(k, None, "fr") for k in range(20, 40)]
    data += [(k, "a" if k % 2 else "", "xx") for k in range(40, 50)] + [(None, "plain words", "en")] * 30 + [(7, "zwölf Boxkämpfer", "de")] * 9
    data += [(k, "zwölf graue Boxkämpfer", "de") for k in range(60, 75)] + [(90, "graue", None), (91, "words " * 300_000, None)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    trees = lang_id.learn(d)
    assert "fr" not in trees.langs and {"en", "de"} <= set(trees.langs)
    got = lang_id.report(d).collect()
    assert len(got) == len(data)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[90]["lang_pred"] == "de" and by_id[91]["lang_pred"] == "en" and by_id[20]["lang_pred"] == "und"
    for text, i in (("graue", 90), ("plain words here", 3)):
        bits = trees.lengths([text.encode()])[0]
        assert by_id[i]["score"] == pytest.approx(1 / np.exp2(bits.min() - bits).sum())
    assert lang_id.report(d.limit(0)).collect() == []
    for text in (b"", b"a"):
        lang_id.Trees({"x": [text]})


def test_lang_id_slices_change_nothing(monkeypatch):
    trees = lang_id.Trees({"a": [b"abracadabra"], "b": [b"xyzzy"]})
    texts = [b"abra" * 30, b"", b"xyz" * 9]
    whole = trees.lengths(texts)
    monkeypatch.setattr(lang_id, "PIECE", 7)
    assert np.allclose(trees.lengths(texts), whole)


def test_simhash_order_of_odd_ids(spark, monkeypatch):
    """Outliers, equal and null ids don't crowd a cell, and every document's next is right."""
    monkeypatch.setattr(simhash, "CELL", 8)
    data = [(k, f"text {k} of some words") for k in range(150)] + [(10**15, "far"), (-(10**17), "low")]
    data += [(70, f"same id {k}") for k in range(60)] + [(None, f"no id {k}") for k in range(80)]
    d = spark.createDataFrame(data, "doc_id long, text string").withColumn("cell", F.lit("clash"))
    cells = simhash.in_cells(d.select("doc_id", "text", F.xxhash64("text").alias("h"))).groupBy("cell").count().collect()
    assert max(r["count"] for r in cells) <= 4 * 8
    h = {r["text"]: r["h"] for r in d.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]]))
    got = {}
    for r in simhash.report(d).collect():
        got.setdefault((r["doc_id"], r["edited_sha256"]), 0)
        got[r["doc_id"], r["edited_sha256"]] += 1
    want = {}
    for k, (i, t) in enumerate(order):
        after, m = order[(k + 1) % len(order)][1], len(t) // 3
        key = i, hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()
        want[key] = want.get(key, 0) + 1
    assert got == want


@pytest.mark.parametrize("crowd", [256, 2])
def test_simhash_near_docs(docs, rows, spark, monkeypatch, crowd):
    """The report's counts against all pairs; a small CROWD deals every shared key anew."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    got = simhash.report(docs).collect()
    prints = [int(r["fingerprint"], 16) for r in got]
    for r, x in zip(got, prints, strict=True):
        assert r["near_docs"] == sum(bin(x ^ y).count("1") <= simhash.RADIUS for y in prints) - 1
    rng = random.Random(2)
    base = rng.getrandbits(120)
    near = [base ^ sum(1 << rng.randrange(120) for _ in range(rng.randrange(3))) for _ in range(80)]
    d = spark.createDataFrame([(x >> 64, x & (1 << 63) - 1) for x in near], "hi long, lo long")
    own = [((x >> 64) << 64) | (x & (1 << 63) - 1) for x in near]
    for r in simhash.near_counts(d).collect():
        x = (r["hi"] << 64) | r["lo"]
        assert r["near"] == sum(bin(x ^ y).count("1") <= 3 for y in own) - 1


@pytest.mark.parametrize("common", [150_000, 5])
def test_class_lm_scores_against_plain(docs, spark, common, monkeypatch):
    """Every score from class counts taken word by word; null and repeated ids, repeated rows, clashing names."""
    monkeypatch.setattr(class_lm, "COMMON", common)
    odd = docs.unionByName(docs.limit(9)).unionByName(docs.limit(4).withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.withColumns({c: F.lit("clash") for c in ("uid", "w", "k", "c", "ids", "train", "score")})
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    learns = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2
    model, counts, placed = class_lm.fit(odd, class_lm.crc32_mod(F.col("doc_id"), 7) != 2)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append([*(t or "").encode().lower().split(), b"\n"])
    of, c = {}, Counter()
    for r in placed.collect():
        words = next(ws for ws in texts[r["doc_id"]] if len(ws) + 1 == len(r["classes"]))
        if sum(len(ws) == len(words) for ws in texts[r["doc_id"]]) == 1 or len({tuple(x) for x in texts[r["doc_id"]]}) == 1:
            for w, k in zip([b"\n", *words], r["classes"], strict=True):
                assert of.setdefault(w, k) == k
    c.update(w for i, ws in texts.items() if learns(i) for x in ws for w in x)
    n, v, size = sum(c.values()), len(c), class_lm.CLASSES
    joint, kinds = np.zeros((size, size)), np.zeros(size)
    for i, many in texts.items():
        for ws in many if learns(i) else []:
            for a, b in zip([b"\n", *ws], ws, strict=False):
                joint[of[a], of[b]] += 1
    for w in c:
        kinds[of[w]] += 1
    tokens = joint.sum(0)
    prior = (tokens + 1) / (n + size)
    step = (joint + class_lm.BACKOFF * prior) / (joint.sum(1, keepdims=True) + class_lm.BACKOFF)
    want, got = Counter(), Counter()
    for i, many in texts.items():
        for ws in many:
            score = sum(math.log10(step[of[a], of[b]] * (c[b] + 1) / (tokens[of[b]] + kinds[of[b]] + 1)) for a, b in zip([b"\n", *ws], ws, strict=False))
            want[i, len(ws), round(score, 6)] += 1
    for r in class_lm.score(placed, model).collect():
        assert (r["train_tokens"], r["held_out"]) == (n, not learns(r["doc_id"]))
        got[r["doc_id"], r["n_tokens"], round(r["score"], 6)] += 1
    assert got == want and v == counts.count()
