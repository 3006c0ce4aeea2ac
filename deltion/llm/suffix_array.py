"""Suffix arrays by induced sorting, in numpy, and permuted common prefixes.

Suffixes are classified as larger or smaller than their successor; the leftmost smaller ones are sorted by their
substrings, recursively where these repeat, and all others are induced from them in one pass up and one pass down. Each
pass handles a whole run of a bucket at once: what a run induces is dealt to its buckets by a stable radix sort.
"""

from __future__ import annotations

import numpy as np

DIGITS = 2048


def _ranks(groups: np.ndarray) -> np.ndarray:
    """Place of each element in its run of equal values (sorted input)."""
    first = np.concatenate([[True], groups[1:] != groups[:-1]])
    starts = np.flatnonzero(first)
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.append(starts, len(groups))))


def _induce(s: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost smaller ones in theirs."""
    out = np.full(len(s), -1, np.int32)
    chars = s[leftmost]
    order = np.argsort(chars, kind="stable")
    chars = chars[order]
    marked = np.bincount(chars, minlength=len(ends))
    out[ends[chars] - marked[chars] + _ranks(chars)] = leftmost[order]
    used = np.flatnonzero(ends > starts).tolist()

    def push(items: np.ndarray, kind: bool, at: np.ndarray, step: int) -> None:
        before = items[items > 0] - 1
        before = before[smaller[before] == kind]
        if len(before):
            to = s[before]
            o = np.argsort(to, kind="stable")
            to = to[o]
            rank = _ranks(to)
            out[at[to] + (rank if step > 0 else -1 - rank)] = before[o]
            last = np.append(np.flatnonzero(to[1:] != to[:-1]), len(to) - 1)
            at[to[last]] += step * (rank[last] + 1)

    head = starts.copy()
    for c in used:
        low = starts[c]
        while low < head[c]:
            high = head[c]
            push(out[low:high], False, head, 1)
            low = high
        push(out[ends[c] - marked[c] : ends[c]], False, head, 1)
    tail = ends.copy()
    tail[0] = starts[0]  # the end mark is induced by nothing
    for c in reversed(used):
        high = ends[c]
        while high > tail[c]:
            low = tail[c]
            push(out[low:high][::-1], True, tail, -1)
            high = low
        push(out[starts[c] : head[c]][::-1], True, tail, -1)
    return out


def _sorted_suffixes(s: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of `s`, whose last symbol is its only 0; symbols are below `size`."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    step = (s[1:] > s[:-1]).astype(np.int8) - (s[1:] < s[:-1]).astype(np.int8)
    change = np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n))
    smaller = np.append(step[np.minimum.accumulate(change[::-1])[::-1]] > 0, True)
    leftmost = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    ends = np.cumsum(np.bincount(s, minlength=size))
    starts = np.concatenate([[0], ends[:-1]])
    order = _induce(s, smaller, leftmost, starts, ends)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    by_substring = order[is_leftmost[order]]

    length = np.zeros(n, np.int32)  # up to and with the next leftmost smaller suffix
    length[leftmost] = np.append(np.diff(leftmost), 0) + 1
    a, b = by_substring[:-1], by_substring[1:]
    same = length[a] == length[b]
    left, k = np.flatnonzero(same), 0
    while len(left):
        equal = s[a[left] + k] == s[b[left] + k]
        same[left[~equal]] = False
        left, k = left[equal], k + 1
        left = left[length[a[left]] > k]
    names = np.concatenate([[0], np.cumsum(~same)])
    count = int(names[-1]) + 1
    if count < len(leftmost):
        place = np.zeros(n, np.int32)
        place[by_substring] = names
        reduced = place[leftmost]
        if count <= DIGITS:
            sub = _sorted_suffixes(reduced.astype(np.uint16), count)
        else:
            # Two digits a name, so that buckets stay few: suffixes at even places are in the same order.
            base = int(count**0.5) + 1
            digits = np.zeros(2 * len(reduced) - 1, np.uint16 if base < 65_000 else np.int64)
            digits[0:-1:2], digits[1::2] = reduced[:-1] // base + 1, reduced[:-1] % base + 1
            sub = _sorted_suffixes(digits, base + 2)
            sub = sub[sub % 2 == 0] // 2
        by_substring = leftmost[sub]
    return _induce(s, smaller, by_substring, starts, ends)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start places of all suffixes of a sequence of small non-negative integers, in order."""
    size = int(symbols.max()) + 2 if len(symbols) else 1
    s = np.zeros(len(symbols) + 1, np.uint16 if size < 65_000 else np.int64)
    s[:-1] = symbols + 1
    return _sorted_suffixes(s, size)[1:]


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Length, up to `limit`, of what each suffix in `order` has in common with the one before it (0 for the first).

    Compared in the order of the text, place by place with its neighbour in the suffix order, eight bytes at a time.
    """
    before = np.full(len(data) + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    places = np.flatnonzero(before >= 0)
    padded = np.concatenate([data, np.zeros(8 + limit, np.uint8)]).astype(np.uint64)
    eight = sum(padded[k : k + len(data) + limit + 1] << np.uint64(8 * k) for k in range(8))
    common = np.zeros(len(data) + 1, np.int64)
    active = places
    for done in range(0, limit, 8):
        differ = eight[active + done] ^ eight[before[active] + done]
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        ends = np.minimum(len(data) - np.maximum(active, before[active]) - done, limit - done)
        common[active] += np.minimum(equal, np.maximum(ends, 0))
        active = active[(equal == 8) & (ends > 8)]
        if not len(active):
            break
    return common[order]
