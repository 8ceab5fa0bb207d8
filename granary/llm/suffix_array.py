"""Suffix arrays by induced sorting, and common prefixes in text order, in numpy.

Positions are classified as smaller or larger than their right neighbour; leftmost-smaller (LMS)
substrings are sorted by inducing from their first characters and named; if names repeat, the
string of names is sorted by the same procedure; the order of LMS suffixes then induces that of
all others in one pass from the left and one from the right. A pass handles a bucket of
equal first characters at a time.
"""

from __future__ import annotations

import numpy as np

#: Largest alphabet sorted by bucket passes; a string of names with more is sorted by doubling ranks.
BUCKETS = 1024
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _push(sa: np.ndarray, place: np.ndarray, chars: np.ndarray, at: np.ndarray, step: int) -> None:
    """Put suffixes ``at``, in their order, at the places of their buckets and move those on by ``step``."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if c.size else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, c.size))
    sa[place[c] + step * (np.arange(c.size) - np.repeat(first, counts))] = at[order]
    place[c[first]] += step * counts


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the LMS positions in the order of what they start."""
    top = int(s.max()) + 1
    counts = np.bincount(s, minlength=top)
    end = np.cumsum(counts)
    start = end - counts
    sa = np.full(s.size, -1, np.int64)
    lms_of = np.split(lms[np.argsort(s[lms], kind="stable")], np.cumsum(np.bincount(s[lms], minlength=top))[:-1])
    head = start.copy()
    used = np.flatnonzero(counts)
    for c in used.tolist():
        done = int(start[c])
        while done < head[c]:
            now = sa[done : head[c]]
            done = int(head[c])
            before = now[now > 0] - 1
            before = before[~smaller[before]]
            if before.size:
                _push(sa, head, s[before], before, 1)
        before = lms_of[c]
        before = before[before > 0] - 1
        if before.size:
            _push(sa, head, s[before], before, 1)
    tail = end - 1
    for c in used[::-1].tolist():
        done = int(end[c]) - 1
        while done > tail[c]:
            now = sa[tail[c] + 1 : done + 1][::-1]
            done = int(tail[c])
            before = now[now > 0] - 1
            before = before[smaller[before]]
            if before.size:
                _push(sa, tail, s[before], before, -1)
        before = sa[start[c] : head[c]][::-1]
        before = before[before > 0] - 1
        before = before[smaller[before]]
        if before.size:
            _push(sa, tail, s[before], before, -1)
    sa[0] = s.size - 1
    return sa


def _doubled(s: np.ndarray) -> np.ndarray:
    rank, step = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    while True:
        second = np.zeros_like(rank)
        second[:-step] = rank[step:] + 1 if step < rank.size else 0
        key = rank * (rank.size + 1) + second
        sa = np.argsort(key, kind="stable")
        new = np.empty_like(rank)
        new[sa] = np.concatenate([[0], np.cumsum(key[sa][1:] != key[sa][:-1])])
        if new[sa[-1]] == rank.size - 1:
            return sa
        rank, step = new, step * 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s``, whose last element is 0 and the only one."""
    n = s.size
    if n < 3:
        return np.arange(n - 1, -1, -1)
    # A position is as its right neighbour where both hold the same character.
    change = np.flatnonzero(s[:-1] != s[1:])
    smaller = np.ones(n, bool)
    nearest = np.searchsorted(change, np.arange(n - 1))
    smaller[:-1] = s[change[nearest]] < s[change[nearest] + 1]
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sa = _induce(s, smaller, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    # Names: LMS substrings by a 64-bit hash of their characters.
    with np.errstate(over="ignore"):
        power = np.full(n, _MULTIPLIER, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        inverse = np.full(n, np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64)), np.uint64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((s.astype(np.uint64) + np.uint64(1)) * power)])
        stop = np.append(lms[1:], n - 1) + 1
        own = np.empty(n, np.uint64)
        own[lms] = (sums[stop] - sums[lms]) * inverse[lms] + (stop - lms).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    name = np.empty(n, np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(own[ordered][1:] != own[ordered][:-1])])
    names = name[lms]
    distinct = int(names.max()) + 1
    if distinct == lms.size:
        order = ordered
    else:
        order = lms[suffix_array(names) if distinct <= BUCKETS else _doubled(names)]
    return _induce(s, smaller, order)


def neighbours(sa: np.ndarray) -> np.ndarray:
    """The suffix before each position's suffix in the order, -1 for the first."""
    out = np.full(sa.size, -1, np.int64)
    out[sa[1:]] = sa[:-1]
    return out


def permuted_lcp(s: np.ndarray, other: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Common prefix of each position and ``other`` of it, in text order, at most ``limit`` of both.

    Where i - 1 and its neighbour hold the same character and i has the position after that neighbour for
    its own, the prefix is that of i - 1 less one; only the remaining positions are compared, eight
    characters at a time. ``limit`` falls by one from position to position within a text.
    """
    n = s.size
    some = other >= 0
    derived = np.zeros(n, bool)
    i = np.flatnonzero(some[1:] & some[:-1] & (other[1:] == other[:-1] + 1)) + 1
    j = other[i]
    derived[i] = (s[i - 1] == s[j - 1]) & (limit[i - 1] == limit[i] + 1) & (limit[j - 1] == limit[j] + 1)
    bound = np.where(some, np.minimum(limit, limit[other]), 0)
    own = np.flatnonzero(some & ~derived)
    length = np.zeros(n, np.int64)
    padded = np.concatenate([s.astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(np.uint64)[:, 0]
    live = own
    at = np.zeros(own.size, np.int64)
    while live.size:
        i, j = live + at, other[live] + at
        go = (at < bound[live]) & (i < n) & (j < n)
        live, at, i, j = live[go], at[go], i[go], j[go]
        diff = words[i] ^ words[j]
        same = diff == 0
        low = diff & (~diff + np.uint64(1))
        step = np.where(same, 8, np.floor(np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64) // 8)
        length[live] = at + step
        live, at = live[same], at[same] + 8
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(derived, 0, place))
    return np.minimum(np.maximum(length[last] - (place - last), 0), bound)
