"""Plain versions of the operators, for small tables."""

import hashlib
import re

EDGE = " \t\n\x0b\x0c\r"


def words(t):
    return (t or "").encode().split()


def quality(t):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    t = t or ""
    w = [x.decode() for x in words(t)]
    lines = [x for x in t.split("\n") if x.strip(EDGE)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    chars = sum(map(len, w))
    symbols = sum(c in "#*$%&|<>" for c in t)
    dups = len(lines) - len(set(lines))
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    bad = symbols * 10 > len(w) or dups * 10 > 3 * len(lines) or chars < 2 * len(w) or chars > 15 * len(w)
    bad = bad or 2 * len(re.findall("[A-Z]", t)) > chars or 3 * t.count("!") > len(w)
    return len(w), chars, symbols, dups, len(covered), failed, not (failed or bad)


def ascii_lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def line_dedup(texts, at_least=10):
    """Kept text of each row; each row counts as a document."""
    split = [(t or "").split("\n") for t in texts]
    n = {}
    for lines in split:
        for k in {ascii_lower(x.strip(EDGE)) for x in lines}:
            n[k] = n.get(k, 0) + 1
    hot = {k for k, c in n.items() if k and c >= at_least}
    return [[x for x in lines if ascii_lower(x.strip(EDGE)) not in hot] for lines in split]


def shingles(t, k):
    w = (t or "").encode().lower().split()
    size = min(k, len(w))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


def components(rows, k, percent):
    """doc_id -> smallest reachable id; rows: (doc_id, text)."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def substring_ranges(rows, size=50):
    """For each row (doc_id, text) the flags of its bytes: True goes."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in raw:
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < i:
                gone[k : k + size] = [True] * size
        out.append(gone)
    return out


def substring_report(rows, size=50):
    out = {}
    for (i, t), gone in zip(rows, substring_ranges(rows, size), strict=True):
        b = (t or "").encode()
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
