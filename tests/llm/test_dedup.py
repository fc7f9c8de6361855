"""Quality rules, line dedup, Jaccard join, suffix-array dedup and the pipeline against plain versions."""

import hashlib
import random
from collections import defaultdict
from functools import reduce
from operator import or_

import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import components, line_dedup, quality_rules, shingle_join, substring_dedup, suffix_array


def test_quality_rules(docs, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in quality_rules.report(docs).collect()}
    assert got == {i: brute.quality(t) for i, t in rows}
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in rows if brute.quality(t)[-1]}
    assert quality_rules.report(docs.limit(0)).collect() == []


def test_quality_order_changes_nothing(docs):
    given = quality_rules.rules()
    a = quality_rules.judge(docs, given).select("_q_row.doc_id", "_q_kept").collect()
    b = quality_rules.judge(docs, dict(reversed(given.items()))).select("_q_row.doc_id", "_q_kept").collect()
    assert sorted(a) == sorted(b)


def test_line_dedup(docs, rows):
    kept = brute.line_dedup([t for _, t in rows])
    want = {i: (len((t or "").split("\n")), len((t or "").split("\n")) - len(k), hashlib.sha256("\n".join(k).encode()).hexdigest()) for (i, t), k in zip(rows, kept, strict=True)}
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.report(docs).collect()}
    assert got == want and any(v[1] for v in got.values())
    assert line_dedup.report(docs.limit(0)).collect() == []
    cut = line_dedup.drop_lines(docs)
    assert cut.columns == docs.columns and cut.schema == docs.schema
    assert {r["doc_id"]: (r["text"] or "", r["n_chars"]) for r in cut.collect()} == {i: ("\n".join(k), len("\n".join(k))) for (i, _), k in zip(rows, kept, strict=True)}


def test_line_dedup_repeated_rows_and_null_ids(spark):
    d = spark.createDataFrame([(1, "x\nkeep")] * 6 + [(None, "X \nother")] * 4, "doc_id long, text string")
    got = line_dedup.report(d).collect()
    assert len(got) == 10 and all(r["n_dropped"] == 1 for r in got)


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_shingle_join(docs, rows, words, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.groups(docs, words, percent).collect()}
    want = brute.components(rows, words, percent)
    assert got == {i: (len(brute.shingles(t, words)), want[i]) for i, t in rows}
    assert any(i != c for i, (_, c) in got.items())
    assert shingle_join.groups(docs.limit(0), words, percent).collect() == []
    kept = shingle_join.keep_first(docs, words, percent)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in want if want[i] == i}


def test_shingle_join_blocks_and_large_cells(spark, monkeypatch):
    """A family cut into blocks, and cells searched by their trees, give the same components."""
    rng = random.Random(3)
    stem = [f"w{k}" for k in range(60)]
    data = []
    for k in range(150):
        w = list(stem)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = f"n{rng.randrange(1000)}"
        data.append((k, " ".join(w)))
    sets = shingle_join.shingles([t.encode() for _, t in data], 3, shingle_join.Words())
    want = brute.components(data, 3, 90)
    ids = [i for i, _ in data]

    def comps(links):
        root = {i: i for i in ids}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return {i: find(i) for i in ids}

    assert comps(shingle_join.shard_links(ids, sets, [0] * 150, 90)) == want
    halves = [k % 2 for k in range(150)]
    links = shingle_join.shard_links(ids, sets, halves, 90)
    for h in (0, 1):
        own = [k for k in ids if k % 2 == h]
        links += shingle_join.shard_links(own, [sets[k] for k in own], [0] * len(own), 90)
    assert comps(links) == want
    d = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(shingle_join, "SHARD_BYTES", 8 * 58 * 40)
    assert {r["doc_id"]: r["component_id"] for r in shingle_join.groups(d, 3, 90).collect()} == want


def test_shingle_join_sends_cells_once_however_many_partitions():
    import pyarrow as pa

    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(300)]
    batch = pa.record_batch([pa.array(range(300), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    few, many = (sum(len(x) for out in shingle_join.cell_pass(5, 80, n)(iter([batch])) for x in out.column(out.num_columns - 1).to_pylist()) for n in (8, 640))
    assert many < 1.2 * few


def test_shingle_join_keeps_large_unlike_sets_apart(spark, monkeypatch):
    rng = random.Random(13)
    common = [f"c{k}" for k in range(400)]
    data = [(k, " ".join([f"w{rng.randrange(100_000)}" for _ in range(3600)] + common)) for k in range(40)]
    data += [(100 + k, t.replace(" c7 ", " other ")) for k, t in data[:5]]
    found, whole = [], shingle_join.components
    monkeypatch.setattr(shingle_join, "components", lambda edges: found.append(edges.distinct().count()) or whole(edges))
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {k: k % 100 for k, _ in data}
    assert found == [5, 5]  # candidates, links


@pytest.mark.parametrize("buckets", [1, 3, 1024])
def test_suffix_arrays_over_any_alphabet(monkeypatch, buckets):
    monkeypatch.setattr(suffix_array, "BUCKETS", buckets)
    rng = random.Random(1)
    for most in (2, 5, 4000):
        for _ in range(150):
            s = np.array([rng.randrange(rng.randrange(1, most)) for _ in range(rng.randrange(1, 120))])
            assert suffix_array.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    s = np.array([k % 37 * 50 + k % 3 for k in range(3000)])
    assert suffix_array.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("run", [0, 3, 64])
def test_runs_and_places_give_one_suffix_array(monkeypatch, run):
    monkeypatch.setattr(suffix_array, "BUCKETS", 3)
    monkeypatch.setattr(suffix_array, "RUN", run, raising=False)
    rng = random.Random(6)
    long = [*np.repeat(range(300), 7).tolist(), *np.repeat(range(300), 5)[::-1].tolist(), *[4, 4, 9] * 40]
    for s in [long, *([rng.randrange(rng.randrange(1, 5000)) for _ in range(rng.randrange(1, 150))] for _ in range(100))]:
        assert suffix_array.suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_many_symbols_are_not_induced_one_by_one():
    """Lines of Python that run while a string over many symbols, all of them frequent, is sorted."""
    import sys

    s, lines = np.random.default_rng(1).integers(0, 3000, 60_000), 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        sa = suffix_array.suffix_array(s)
    finally:
        sys.settrace(before)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i : i + 20].tolist())
    assert lines < len(s)  # place by place: more than ten lines for each


def test_order_of_anchors_and_codes_that_are_found():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 500):
        key, content, check = (rng.integers(0, k, n).astype(np.uint64) for k in (150, 3, 2))
        doc = rng.integers(-9, 9, n)
        order, first = substring_dedup.firsts(key, content, check * np.uint64(0), doc)
        rows = list(zip(key.tolist(), content.tolist(), doc.tolist(), strict=True))
        assert [rows[x] for x in order.tolist()] == sorted(rows) and sorted(order.tolist()) == list(range(n))
        assert first.tolist() == [x == 0 or r[:2] != sorted(rows)[x - 1][:2] for x, r in enumerate(sorted(rows))]
        codes = np.sort(key)
        hit, low, high = substring_dedup.matches(codes, np.arange(200, dtype=np.uint64))
        assert [(h, b - a) for h, a, b in zip(hit.tolist(), low.tolist(), high.tolist(), strict=True)] == [(k, int((key == k).sum())) for k in range(200) if (key == k).any()]


def test_permuted_prefixes():
    text = np.frombuffer(b"abcdefghij" * 20, np.uint8)
    sa = suffix_array.suffix_array(text)
    valid = np.arange(200) <= 150
    got = suffix_array.reaches(text, sa, valid, 50)
    before = dict(zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True))
    for i in range(200):
        j = before.get(i)
        assert got[i] == (j is not None and valid[i] and valid[j] and (text[i : i + 50] == text[j : j + 50]).all())


def test_substring_dedup(docs, rows, monkeypatch):
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.report(docs).collect()}
    assert got == brute.substring_report(rows) and any(v[1] for v in got.values())
    assert substring_dedup.report(docs.limit(0)).collect() == []
    cut = substring_dedup.cut_texts(docs)
    assert cut.schema == docs.schema
    flags = brute.substring_ranges(rows)
    want = {i: bytes(c for c, g in zip((t or "").encode(), f, strict=True) if not g).decode(errors="ignore") for (i, t), f in zip(rows, flags, strict=True)}
    assert {r["doc_id"]: r["text"] or "" for r in cut.collect()} == want


def test_substring_dedup_pieces_ids_and_nulls(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    d = spark.createDataFrame([(5, text), (5, text), (None, text), (9, "zz" + text[100:400]), (2, text[4000:4060]), (7, text[:30])], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in substring_dedup.report(d).collect())
    assert got == [(-1, 5000, 0, 0), (2, 60, 0, 0), (5, 5000, 60, 1), (5, 5000, 60, 1), (7, 30, 0, 0), (9, 302, 300, 1)]


def test_anchors_of_a_batch_are_sent_in_slices(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(8)
    texts = [bytes(rng.choices(b"abcdefgh ", k=4000)).decode() for _ in range(1000)] + [None, "", "x" * 300_000] * 2
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(substring_dedup, "PIECE", 1 << 16)
    monkeypatch.setattr(substring_dedup, "SLICE", 1 << 18, raising=False)
    tracemalloc.start()
    blobs = defaultdict(list)
    for out in substring_dedup.lost_pass(4)(iter([batch])):
        for b, x in zip(*(c.to_pylist() for c in out.columns), strict=True):
            blobs[b].append(x)
        peak = max(tracemalloc.get_traced_memory()[1] - sum(len(x) for own in blobs.values() for x in own), 0)
    tracemalloc.stop()
    assert peak < 30_000_000  # the whole batch at once: over 50 MB
    found = [substring_dedup.judge_bucket(own) for own in blobs.values()]
    lost = {int(d) for docs, _, what in found for d in docs[what == substring_dedup.WHOLE]}
    assert lost == {len(texts) - 1}


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.choice(b"abcdef") for _ in range(9000))
    whole = substring_dedup.all_segments([text])
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    parts = substring_dedup.all_segments([text])
    for rows, where, windows, *_ in (whole, parts):
        at = np.concatenate([np.arange(a, a + n) for a, n in zip(where, windows, strict=True)])
        assert at.tolist() == list(range(9000 - 49))
    assert set(whole[3].tolist()) == set(parts[3].tolist())


def test_pipeline_against_plain_stages(spark, sf):
    import corpus_pipeline

    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in table.collect())
    rows = [(i, t) for i, t in rows if brute.quality(t)[-1]]
    rows = [(i, "\n".join(k)) for (i, _), k in zip(rows, brute.line_dedup([t for _, t in rows]), strict=True)]
    roots = brute.components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if roots[i] == i]
    flags = brute.substring_ranges(rows)
    want = {i: bytes(c for c, g in zip(t.encode(), f, strict=True) if not g).decode(errors="ignore") for (i, t), f in zip(rows, flags, strict=True)}
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == table.columns, name
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf).select("doc_id", "length").collect():
        got[r["doc_id"]] += r["length"]
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in want.items()}


@pytest.mark.parametrize("agree", ["content", "check"])
def test_suffix_dedup_needs_both_content_hashes(agree, monkeypatch):
    """Segments of one anchor that agree in one of their two content hashes are two strings."""
    import pyarrow as pa

    def clash(texts, found=substring_dedup.all_segments):
        rows, where, windows, key, content, check = found(texts)
        content, check = (content * np.uint64(0), check) if agree == "content" else (content, check * np.uint64(0))
        return rows, where, windows, key * np.uint64(0), content, check

    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefghij klm") for _ in range(400)) for _ in range(3)]
    monkeypatch.setattr(substring_dedup, "all_segments", clash)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], ["doc_id", "text"])
    blobs = [x for b in substring_dedup.lost_pass(3)([batch]) for x in b.column(1).to_pylist()]
    assert len(blobs) == 1 and (substring_dedup.judge_bucket(blobs)[2] == substring_dedup.STRING).all()
    assert (substring_dedup.judge_bucket(blobs, 3)[2] == substring_dedup.WINDOWS).all()


def test_second_content_hash_depends_on_all_bytes():
    rng = random.Random(5)
    text = bytes(rng.choice(b"abcdef ") for _ in range(300))
    _, where, windows, _, content, check = substring_dedup.all_segments([text])
    again = substring_dedup.all_segments([b"xx" * 40 + text])
    assert set(zip(content.tolist(), check.tolist(), strict=True)) - set(zip(again[4].tolist(), again[5].tolist(), strict=True)) <= {(int(content[0]), int(check[0]))}
    assert len(set(check.tolist())) == len(check) == len(set(content.tolist()))


@pytest.mark.parametrize("crowd", [0, 2])
def test_substring_dedup_of_crowded_anchors(docs, rows, crowd):
    """All strings, or those of anchors with more than two, are compared window by window."""
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.report(docs, crowd).collect()}
    assert got == brute.substring_report(rows)


def test_partitions_are_read_in_chunks():
    """Marks and texts of a document fall into different batches and chunks, and each text has all of its own."""
    import pyarrow as pa
    import zstandard

    rng = random.Random(3)
    z = zstandard.ZstdCompressor().compress
    table, want = [(None, z(b"no id"), None, None, None)], [(None, [])]
    for doc in range(1, 40):
        own = sorted(rng.sample(range(10**6), rng.randrange(5)))
        table += [(doc, None, c, -1, -1) for c in own]
        for _ in range(rng.randrange(3)):
            table.append((doc, z(b"x" * rng.randrange(300)), None, None, None))
            want.append((doc, own))
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
    names = ["doc_id", "z", "content", "first", "last"]
    for rows_at_once in (1, 7, 1000):
        parts = [table[k : k + rows_at_once] for k in range(0, len(table), rows_at_once)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*p, strict=True), kinds, strict=True)], names) for p in parts]
        got = []
        for ids, raws, marks in substring_dedup.partition(iter(batches), 500):
            assert len(ids) == len(raws)
            for t, i in enumerate(ids):
                codes = sorted(marks[1][marks[0] == t].tolist())
                own = next(w for d, w in want if d == i)
                assert codes == sorted(substring_dedup.mark_code(np.array(own, np.int64), np.full(len(own), t)).tolist())
                got.append((i, own))
        assert got == want


def test_quality_cascade_is_short(docs, rows, monkeypatch):
    """The base rule is ordered among the others, and no windows are looked at in what cheaper rules reject."""
    names = [name for name, _ in quality_rules.ordered(docs, docs.count())]
    assert sorted(names) == sorted([*quality_rules.rules(), quality_rules.BASE])
    order = [*quality_rules.rules().items(), (quality_rules.BASE, quality_rules.base_failed())]
    monkeypatch.setattr(quality_rules, "ordered", lambda *_: order)
    cheap = quality_rules.judge(docs, short=True).withColumn("cheap", reduce(or_, [c for _, c in order[:-1]])).collect()
    full = {r["_q_row"]["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert any(r["cheap"] and full[r["_q_row"]["doc_id"]]["_q_n_repeat_words"] for r in cheap)
    for r in cheap:
        own = full[r["_q_row"]["doc_id"]]
        assert r["_q_n_repeat_words"] == (0 if r["cheap"] else own["_q_n_repeat_words"])
        assert r["_q_kept"] == own["_q_kept"]
    assert {r["doc_id"] for r in quality_rules.keep_good(docs).collect()} == {i for i, t in rows if brute.quality(t)[-1]}


def test_components_go_on_until_nothing_changes(spark, monkeypatch):
    """No bound on the rounds cuts a path into pieces."""
    monkeypatch.setattr(components, "ROUNDS", 1, raising=False)
    at = list(range(40))
    random.Random(5).shuffle(at)
    edges = spark.createDataFrame(list(zip(at, at[1:], strict=False)), "a long, b long")
    assert {(r["node"], r["root"]) for r in components.components(edges).collect()} == {(k, 0) for k in at}


CLASHES = ["_q_text", "_q_kept", "_l_text", "_l_row", "_l_kept", "_j_row", "_s_text", "_s_id", "sig", "h1", "rep", "root", "z"]


@pytest.mark.parametrize("stage", [quality_rules.keep_good, line_dedup.drop_lines, shingle_join.keep_first, substring_dedup.cut_texts])
def test_stages_keep_clashing_columns(docs, spark, stage):
    """Columns with the operators' own names come through, and null ids, repeated rows and empty tables are handled."""
    from pyspark.sql import functions as F

    own = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    plain = {r["doc_id"]: tuple(r) for r in stage(docs).collect()}
    got = stage(own)
    assert got.columns == own.columns
    for r in got.collect():
        assert all(r[c] == f"{c} {r['doc_id']}" for c in CLASHES) and tuple(r)[: len(docs.columns)] == plain.pop(r["doc_id"])
    assert not plain
    assert stage(own.limit(0)).collect() == []
    odd = own.unionByName(own.limit(4)).unionByName(own.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    assert stage(odd).count() >= len(got.collect())


def test_shingle_join_rows_of_one_id_stay_apart(spark):
    a, b, c = ("one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen", "red green blue cyan pink grey")
    d = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b), (8, b), (9, c), (9, None), (None, a)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in shingle_join.groups(d, 3, 90).collect())
    assert got == [(-1, -1), (3, 3), (5, 3), (5, 5), (5, 5), (8, 5), (9, 9), (9, 9)]
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in shingle_join.keep_first(d, 3, 90).collect() if r["text"])
    assert kept == [(-1, a), (3, a), (5, b), (5, b), (9, c)]


def test_line_dedup_leaves_no_tables(spark, docs):
    line_dedup.report(docs).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_run")]


def test_pipeline_on_odd_tables(spark, docs, sf):
    """Empty tables, null and repeated ids, null texts and clashing names run through all stages."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    odd = docs.unionByName(docs.limit(5)).unionByName(docs.limit(4).withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.withColumns({c: F.lit(c) for c in CLASHES})
    for table in (odd, odd.limit(0)):
        out = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, sf)
            assert out.columns == table.columns, name
        pieces = corpus_pipeline.STAGES[-1][1](spark, out, sf)
        assert (pieces.count() > 0) == (table is odd)


def test_quality_rules_on_repeated_rows_and_null_ids(docs, rows):
    from collections import Counter

    from pyspark.sql import functions as F

    odd = docs.unionByName(docs.limit(7)).unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    want = Counter((r["doc_id"], *brute.quality(r["text"])) for r in odd.collect())
    assert Counter(tuple(r) for r in quality_rules.report(odd).collect()) == want
    assert {name for name, _ in quality_rules.ordered(odd, odd.count())} == {*quality_rules.rules(), quality_rules.BASE}
