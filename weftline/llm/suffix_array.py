"""Suffix arrays by induced sorting and permuted longest common prefixes, on numpy arrays.

The induced passes go through the array in chunks: as long as what a chunk's suffixes induce lands behind
its end, its suffixes are final and are handled together. Chunks end where the first of them lands.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last (the sentinel) is."""
    n = len(s)
    change = np.flatnonzero(s[1:] != s[:-1])  # s[i] != s[i + 1]
    at = np.searchsorted(change, np.arange(n - 1))
    out = np.ones(n, bool)
    near = change[at]
    out[:-1] = s[near] < s[near + 1]
    return out


def _places(chars: np.ndarray, pointer: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where items of these characters land, in order; the characters met and how many of each."""
    order = np.argsort(chars, kind="stable")
    kinds = chars[order]
    change = np.flatnonzero(kinds[1:] != kinds[:-1])
    edges = np.empty(len(change) + 2, np.int64)
    edges[0], edges[1:-1], edges[-1] = 0, change + 1, len(kinds)
    heads, counts = edges[:-1], edges[1:] - edges[:-1]
    within = np.arange(len(kinds)) - np.repeat(heads, counts)
    out = np.empty(len(chars), np.int64)
    out[order] = pointer[kinds] + sign * within
    return out, kinds[heads], counts


def _pass(sa: np.ndarray, s: np.ndarray, induced: np.ndarray, pointer: np.ndarray) -> None:
    """One pass from the left: each suffix j of sa puts j - 1, if `induced`, at its character's pointer.

    The pass from the right is this one on the reversed view, with mirrored pointers.
    """
    n, at, size = len(sa), 0, 64
    while at < n:
        end = min(n, at + size)
        js = sa[at:end]
        where = np.flatnonzero(js > 0)
        before = js[where] - 1
        good = induced[before]
        where, before = where[good], before[good]
        if len(where):
            chars = s[before]
            places, kinds, counts = _places(chars, pointer, 1)
            first = int(places.min())
            if first < min(end, at + 16):  # a run of like characters: one by one is faster
                end = min(n, at + 1024)
                for i in range(at, end):
                    j = int(sa[i]) - 1
                    if j >= 0 and induced[j]:
                        c = s[j]
                        sa[pointer[c]] = j
                        pointer[c] += 1
                at, size = end, 64
                continue
            if first < end:
                end = first
                fit = int(np.searchsorted(where, end - at))
                before, chars = before[:fit], chars[:fit]
                places, kinds, counts = _places(chars, pointer, 1) if fit else (places[:0], kinds[:0], counts[:0])
            sa[places] = before
            pointer[kinds] += counts
        size = min(1 << 16, max(64, 2 * (end - at)))
        at = end


def _induce(s: np.ndarray, smaller: np.ndarray, heads: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order (or, with some order, their substrings)."""
    n = len(s)
    sa = np.full(n, -1, np.int32)
    order = np.argsort(s[lms], kind="stable")
    placed = lms[order]
    chars = s[placed]
    counts = np.bincount(chars, minlength=len(heads))
    first = ends - counts
    start = np.cumsum(np.r_[0, counts])[:-1]
    where = first[chars] + np.arange(len(placed)) - start[chars]
    sa[where] = placed
    _pass(sa, s, ~smaller, heads.copy())
    sa[where] = -1
    sa[0] = n - 1
    back = sa[::-1]
    _pass(back, s, smaller, n - ends)
    sa[0] = n - 1
    return sa


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each leftmost-smaller substring, in the order of positions; equal ones share it."""
    n = len(s)
    length = np.zeros(n, np.int32)
    length[lms] = np.diff(np.r_[lms, n - 1]) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    active, k = np.flatnonzero(same), 0
    while len(active):
        equal = s[a[active] + k] == s[b[active] + k]
        same[active[~equal]] = False
        k += 1
        active = active[equal]
        active = active[length[a[active]] > k]
    ranks = np.r_[0, np.cumsum(~same)].astype(np.int32)
    name = np.zeros(n, np.int32)
    name[ordered] = ranks
    return name[lms], int(ranks[-1]) + 1


def _sorted(s: np.ndarray) -> np.ndarray:
    """s ends with its only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = _types(s)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    heads = ends - counts
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    if len(lms) > 1:
        rough = _induce(s, smaller, heads, ends, lms)
        names, kinds = _names(s, lms, rough[is_lms[rough]])
        inner = np.argsort(names, kind="stable") if kinds == len(lms) else _sorted(names)
        lms = lms[inner]
    return _induce(s, smaller, heads, ends, lms)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The order of all suffixes of an array of small non-negative numbers."""
    return _sorted(np.r_[data.astype(np.int32) + 1, np.zeros(1, np.int32)])[1:]


def common_prefixes(data: bytes, sa: np.ndarray) -> np.ndarray:
    """By position: how many bytes a suffix has in common with the one before it in the array.

    Where the bytes before both differ they are compared; elsewhere it is one less than at the position before.
    """
    n = len(data)
    raw = np.frombuffer(data + b"\0" * 16, np.uint8)
    words = np.ndarray((n + 8,), "<u8", raw, strides=(1,))  # the eight bytes from each position on
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    here = np.arange(n, dtype=np.int32)
    start = (before <= 0) | (here == 0) | (raw[here - 1] != raw[before - 1])
    at = np.flatnonzero(start)
    length = np.zeros(len(at), np.int32)
    active = np.flatnonzero(before[at] >= 0)
    while len(active):
        x, y = at[active] + length[active], before[at[active]] + length[active]
        room = n - np.maximum(x, y)
        differ = words[np.minimum(x, n)] ^ words[np.minimum(y, n)]
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.floor(np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64) // 8)
        length[active] += np.minimum(equal, room)
        active = active[(equal == 8) & (room > 8)]
    out = np.zeros(n, np.int32)
    out[at] = length + at
    last = np.maximum.accumulate(np.where(start, here, 0))
    return np.maximum(out[last] - here, 0)


def repeats(data: bytes, length: int) -> np.ndarray:
    """Whether the `length` bytes from each position on also start at another one."""
    flags = np.zeros(len(data), bool)
    if len(data) > length:
        sa = suffix_array(np.frombuffer(data, np.uint8))
        long = common_prefixes(data, sa)[sa] >= length
        flags[sa[long]] = True
        flags[sa[:-1][long[1:]]] = True
    return flags
