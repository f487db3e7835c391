"""Suffix array and common prefixes of one shard by induced sorting, in whole-array steps."""

from __future__ import annotations

import numpy as np


def smaller_types(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(S, n): S[i] if suffix i is smaller than suffix i + 1; n[i] the first j >= i with x[j] != x[j + 1].

    The last suffix counts as larger than what follows it (an end smaller than all)."""
    n = len(x)
    change = np.flatnonzero(x[:-1] != x[1:])
    ends = np.append(change, n - 1)
    run = np.diff(np.concatenate(([-1], ends)))
    at = np.repeat(ends.astype(np.int32), run)
    rising = np.zeros(n, bool)
    rising[change] = x[change] < x[change + 1]
    return rising[at], at


def leftmost(s: np.ndarray) -> np.ndarray:
    """Places of leftmost-smaller suffixes: an S after an L."""
    return np.flatnonzero(s[1:] & ~s[:-1]) + 1


def _ranked(sub_start: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes at sub_start, which is sorted, by at least depth symbols of x.

    Leftmost-smaller substrings are named by their order, and the row of names is sorted the same way at
    doubled length, until all names differ or they cover depth symbols; each level looks at a shorter or equal row of
    names, never at the text again."""
    n, m = len(x), len(sub_start)
    padded = np.append(x.astype(np.uint64) + np.uint64(1), np.uint64(0))
    keys = np.zeros((3, m), np.uint64)
    length = np.append(np.diff(sub_start), n)  # a substring ends with the next one's first symbol, the last with the text
    for k in range(21):  # 9 bits a symbol: three words hold a substring of 21; what ends early sorts last
        part = np.where(k <= length, padded[np.minimum(sub_start + k, n)], np.uint64(511))
        keys[k // 7] = keys[k // 7] * np.uint64(512) + part
    full = np.diff(np.append(sub_start, n))
    order = np.lexsort((keys[2], keys[1], keys[0]))
    rank = _names(order, [keys[0], keys[1], keys[2]])
    if (full > 20).any():  # long substrings: go on by plain doubling over the text's own places
        return _long(sub_start, x, depth)
    step, covered = 1, int(full.min(initial=1))
    while rank.max(initial=0) + 1 < m and covered < depth:
        nxt = np.concatenate((rank[step:] + 1, np.zeros(min(step, m), rank.dtype)))
        order = np.argsort(rank * np.int64(m + 1) + nxt, kind="stable")
        rank = _names(order, [rank, nxt])
        step *= 2
        sums = np.append(sub_start, [n] * step)[step : step + m] - sub_start
        covered = int(sums[: max(1, m - step)].min(initial=depth))
    return sub_start[np.argsort(rank, kind="stable")]


def _names(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(order), bool)
    for k in keys:
        sorted_k = k[order]
        new[1:] |= sorted_k[1:] != sorted_k[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _long(sub_start: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    rank, step = x.astype(np.int64), 1
    while step < depth:
        nxt = np.concatenate((rank[step:] + 1, np.zeros(min(step, len(x)), np.int64)))[: len(x)]
        pair = rank * (nxt.max() + 1) + nxt
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        if rank.max() + 1 == len(x):
            break
        step *= 2
    return sub_start[np.argsort(rank[sub_start], kind="stable")]


def _put(sa: np.ndarray, head: np.ndarray, places: np.ndarray, chars: np.ndarray, step: int) -> None:
    """Append places to their characters' buckets in order, moving each head by step (1 or -1)."""
    if not len(places):
        return
    order = np.argsort(chars.astype(np.uint16), kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    size = np.diff(np.append(first, len(c)))
    within = np.arange(len(c)) - np.repeat(first, size)
    sa[head[c] + step * within] = places[order]
    head[c[first]] += step * size


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of the bytes x in the order of their first depth symbols at least.

    Classify, order the leftmost-smaller suffixes, then induce: one pass over the buckets places the larger
    suffixes behind those they precede, a second one backwards the smaller.  A bucket is done in waves, as
    many as its longest run of one byte."""
    n = len(x)
    x = x.astype(np.int64)
    s, _ = smaller_types(x)
    lms = leftmost(s)
    ordered = _ranked(lms, x, depth) if len(lms) else lms
    size = np.bincount(x, minlength=257)
    begin = np.concatenate(([0], np.cumsum(size)))
    sa = np.full(n, -1, np.int64)
    head = begin[:-1].copy()
    _put(sa, head, np.array([n - 1]), x[[n - 1]], 1)
    by_char = np.searchsorted(x[ordered], np.arange(258), "left")
    for c in range(257):
        done = begin[c]
        while done < head[c]:
            wave, done = sa[done : head[c]], head[c]
            before = wave[wave > 0] - 1
            before = before[~s[before]]
            _put(sa, head, before, x[before], 1)
        before = ordered[by_char[c] : by_char[c + 1]] - 1
        before = before[before >= 0]
        _put(sa, head, before, x[before], 1)
    larger = head.copy()  # larger[c]: where the larger suffixes of c end
    tail = begin[1:] - 1
    for c in range(256, -1, -1):
        top = begin[c + 1] - 1
        while top > tail[c]:
            wave, top = sa[tail[c] + 1 : top + 1][::-1], tail[c]
            before = wave[wave > 0] - 1
            before = before[s[before]]
            _put(sa, tail, before, x[before], -1)
        wave = sa[begin[c] : larger[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[s[before]]
        _put(sa, tail, before, x[before], -1)
    return sa


def common_prefixes(x: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in sa, in text order (0 for the first).

    A place whose left neighbour agrees with that of its partner has the prefix of the place before, less one;
    only the others are compared, eight bytes at a time."""
    n = len(x)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    ask = phi >= 0
    left = np.ones(n, bool)
    both = np.flatnonzero(ask & (phi > 0))
    both = both[both > 0]
    left[both] = x[both - 1] != x[phi[both] - 1]
    # a reducible place needs the place before to have the partner before
    same = both[~left[both]]
    left[same] = phi[same - 1] != phi[same] - 1
    at = np.flatnonzero(left)
    pad = np.concatenate((x.astype(np.uint8), np.zeros(16, np.uint8)))
    eight = np.zeros(n + 8, np.uint64)
    for k in range(8):
        eight |= pad[k : k + n + 8].astype(np.uint64) << np.uint64(8 * k)
    value = np.zeros(len(at), np.int64)
    live = np.flatnonzero(ask[at])
    a, b = at[live], phi[at[live]]
    while len(live):
        diff = eight[a] ^ eight[b]
        low = diff & (~diff + np.uint64(1))
        same = np.where(diff == 0, 8, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64)) // 8)
        same = np.minimum(same, n - np.maximum(a, b))
        value[live] += same
        go = (same == 8) & (np.maximum(a, b) + 8 < n)
        live, a, b = live[go], a[go] + 8, b[go] + 8
    last = np.repeat(np.arange(len(at)), np.diff(np.append(at, n)))
    return np.maximum(value[last] - (np.arange(n) - at[last]), 0)
