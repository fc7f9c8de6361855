"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified, the substrings between leftmost smaller suffixes are sorted and named, the names are sorted by
the same procedure at any depth and over any alphabet, and all suffixes are induced from them. A string over few symbols
is induced bucket by bucket in numpy. One over many symbols is induced run by run, or place by place if it has long runs of
larger or smaller suffixes.
"""

from __future__ import annotations

import numpy as np

BUCKETS = 1024  # symbols up to which a bucket is worth a numpy call of its own
RUN = 64  # suffixes of one type in a row up to which runs are induced symbol by symbol


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of a string of small non-negative integers (a sentinel below all of them is understood)."""
    if not len(s):
        return np.zeros(0, np.int64)
    used = np.zeros(int(s.max()) + 1, bool)
    used[s] = True
    to = (np.cumsum(used)).astype(np.int32)
    return _induced(np.r_[to[s], 0].astype(np.int32), int(used.sum()) + 1)[1:]


def _types(s: np.ndarray) -> np.ndarray:
    """True for a suffix that is smaller than the next one; the sentinel counts as smaller."""
    d = np.sign(s[1:].astype(np.int64) - s[:-1])
    at = np.where(d != 0, np.arange(len(d)), len(d))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.r_[np.r_[d, 1][at] > 0, True]


def _induced(s: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of s, which ends with a 0 that stands nowhere else; symbols are below k."""
    n = len(s)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1  # leftmost smaller suffixes
    if not len(lms):
        return np.r_[n - 1, np.arange(n - 2, -1, -1)] if n > 1 else np.zeros(1, np.int64)
    names = (_names_by_induction if k <= BUCKETS else _names_by_symbols)(s, k, small, lms)
    order = lms[np.argsort(names, kind="stable") if names.max() == len(lms) - 1 else suffix_array(names)]
    return _induce(s, k, order)


def _names_by_induction(s: np.ndarray, k: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each lms place to the next one, equal ones alike: induced from their first symbols,
    which puts them in order, and compared with their neighbours."""
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    order = _induce(s, k, lms)
    order = order[is_lms[order]]
    end = np.zeros(len(s), np.int64)
    end[lms] = np.r_[lms[1:], lms[-1]]
    a, b = order[:-1], order[1:]
    size = end[b] - b
    same = end[a] - a == size
    left = np.flatnonzero(same)
    step = 0
    while len(left):  # symbol by symbol, over the pairs that still agree
        agree = s[a[left] + step] == s[b[left] + step]
        same[left[~agree]] = False
        left = left[agree & (size[left] > step)]
        step += 1
    name = np.zeros(len(s), np.int64)
    name[order] = np.r_[0, np.cumsum(~same)]
    return name[lms]


def _names_by_symbols(s: np.ndarray, k: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same by sorting the substrings symbol by symbol, those that are still alike at a time. A symbol counts with
    its type, so that no substring is the beginning of another."""
    both = s.astype(np.int64) * 2 + small
    size = np.r_[lms[1:], lms[-1]] - lms
    rank = np.zeros(len(lms), np.int64)  # how many substrings are smaller
    left, step = np.arange(len(lms)), 0
    while len(left):
        symbol = both[lms[left] + step]
        order = np.lexsort((symbol, rank[left]))
        left, symbol = left[order], symbol[order]
        group = rank[left]
        new_group = np.r_[True, group[1:] != group[:-1]]
        new = new_group | np.r_[True, symbol[1:] != symbol[:-1]]
        place = np.arange(len(left))
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank[left] = group + first - np.maximum.accumulate(np.where(new_group, place, 0))
        alone = new & np.r_[new[1:], True]
        left = left[~alone & (size[left] > step)]
        step += 1
    return np.unique(rank, return_inverse=True)[1]


def _induce(s: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the lms suffixes in order."""
    if k <= BUCKETS:
        return _by_buckets(s, k, lms)
    small = _types(s)
    edge = np.flatnonzero(np.r_[True, small[1:] != small[:-1], True])
    return _by_runs(s, small, lms) if np.diff(edge).max() <= RUN else _by_places(s, k, lms)


def _by_runs(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The larger suffixes from the lms suffixes, then the smaller ones from the larger ones. A suffix goes by the symbols
    of its run and by the rank of the suffix that ends the run, which is known and unlike all others."""
    both = s.astype(np.int64) * 2 + small

    def induced(known: np.ndarray, at: np.ndarray) -> np.ndarray:
        value = both * (len(known) + 1)
        value[known] += np.arange(1, len(known) + 1)
        return _in_order(at, value)

    larger = induced(lms, np.flatnonzero(~small))
    smaller = induced(larger, np.flatnonzero(small[:-1]))
    order = np.r_[len(s) - 1, larger, smaller]
    return order[np.argsort(both[order], kind="stable")]


def _in_order(at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places by their values, those that are still alike by the next values, and so on."""
    left, group, step = np.arange(len(at)), np.zeros(len(at), np.int64), 0
    out = at.copy()
    while len(left):
        v = value[out[left] + step]
        order = np.lexsort((v, group)) if step else np.argsort(v)
        out[left], v = out[left[order]], v[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (v[1:] != v[:-1])]
        group = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
        tied = ~(new & np.r_[new[1:], True])
        left, group = left[tied], group[tied]
        step += 1
    return out


def _by_places(s: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """One pass up an array of places for the larger suffixes, one pass down for the smaller ones."""
    size = np.bincount(s, minlength=k)
    ends = np.cumsum(size)
    symbol, small, sa = s.tolist(), _types(s).tolist(), [-1] * len(s)
    free = ends.tolist()
    for x in reversed(lms.tolist()):
        c = symbol[x]
        free[c] -= 1
        sa[free[c]] = x
    free = (ends - size).tolist()
    for x in sa:  # grows ahead of where it is read
        if x > 0 and not small[x - 1]:
            c = symbol[x - 1]
            sa[free[c]] = x - 1
            free[c] += 1
    free = ends.tolist()
    for at in range(len(sa) - 1, -1, -1):
        x = sa[at]
        if x > 0 and small[x - 1]:
            c = symbol[x - 1]
            free[c] -= 1
            sa[free[c]] = x - 1
    return np.array(sa, np.int64)


def _by_buckets(s: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """One pass up through the buckets for the larger suffixes, one pass down for the smaller ones. A bucket's own
    suffixes feed it in waves, the others in one stable deal."""
    n = len(s)
    head = s[lms]
    by = np.argsort(head, kind="stable")
    seeds, cut = lms[by], np.searchsorted(head[by], np.arange(k + 1))
    larger: list[list] = [[] for _ in range(k)]
    smaller: list[list] = [[] for _ in range(k)]

    def deal(x: np.ndarray, c: int, to: list[list], up: bool) -> None:
        before = x[x > 0] - 1
        symbol = s[before]
        keep = symbol > c if up else symbol < c
        before, symbol = before[keep], symbol[keep]
        if len(before):
            by = np.argsort(symbol.astype(np.uint16) if k < 65536 else symbol, kind="stable")
            before, symbol = before[by], symbol[by]
            at = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
            for i, j in zip(at.tolist(), [*at[1:].tolist(), len(before)], strict=True):
                to[symbol[i]].append(before[i:j])

    def waves(parts: list, c: int) -> np.ndarray:
        x = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        out = [x]
        while len(x):
            x = x[x > 0] - 1
            x = x[s[x] == c]
            out.append(x)
        return np.concatenate(out)

    done = []
    for c in range(k):
        own = waves(larger[c], c)
        done.append(own)
        deal(np.concatenate([own, seeds[cut[c] : cut[c + 1]]]), c, larger, True)
    result = [None] * k
    for c in range(k - 1, -1, -1):
        if c == 0:
            result[0] = np.r_[n - 1]
            continue
        own = waves(smaller[c], c)
        deal(np.concatenate([own, done[c][::-1]]), c, smaller, False)
        result[c] = np.concatenate([done[c], own[::-1]])
    return np.concatenate(result)


def reaches(text: np.ndarray, sa: np.ndarray, valid: np.ndarray, size: int) -> np.ndarray:
    """Permuted common prefixes, held against ``size``: for each position in text order, whether its suffix agrees in
    that many bytes with the suffix before it in the array; only where both positions are valid."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, bool)
    at = np.flatnonzero(valid & (before >= 0))
    at = at[valid[before[at]]]
    padded = np.r_[text, np.zeros(8, np.uint8)]
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 1].copy().view(np.uint64).ravel()
    for off in [*range(0, size - 7, 8), size - 8]:
        at = at[eight[at + off] == eight[before[at] + off]]
    out[at] = True
    return out
