"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classed as S (less than the next one) or L; leftmost S suffixes (LMS) start the substrings that are sorted
first, named, and sorted recursively as a text of names where names repeat. All suffixes then follow from the sorted LMS
ones in two linear passes. A pass handles whole buckets at once with numpy where the alphabet is small for the text, and
single suffixes otherwise. Places are numbers of 32 bits, and what a level has done with is freed before the next one.
"""

from __future__ import annotations

import numpy as np

#: A bucket handled with numpy costs about as much as so many suffixes handled singly.
BUCKET_COST = 40
#: Places whose prefixes are compared at a time.
AT_ONCE = 1 << 18


def _classes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is of class S, and the LMS places; past the end stands a least symbol."""
    n = len(t)
    turn = np.append(t[:-1] != t[1:], True)
    at = np.where(turn, np.arange(n, dtype=np.int32), np.int32(n))
    following = np.minimum.accumulate(at[::-1])[::-1]
    after = np.append(t, t.dtype.type(-1))
    small = after[following] < after[following + 1]
    return small, np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _induce_buckets(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array that follows from lms, whole buckets at a time."""
    n, k = len(t), len(sizes)
    sa = np.full(n, -1, np.int32)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    of = t[lms]
    order = np.argsort(of, kind="stable")
    held = np.bincount(of, minlength=k)
    sa[np.repeat(ends - np.cumsum(held), held) + np.arange(len(lms))] = lms[order]
    lms_from = ends - held
    some = np.flatnonzero(sizes)

    head = begins.copy()

    def forth(entries: np.ndarray) -> None:
        j = entries - 1
        j = j[j >= 0]
        j = j[~small[j]]
        if len(j):
            c = t[j]
            order = np.argsort(c, kind="stable")
            counts = np.bincount(c, minlength=k)
            used = np.flatnonzero(counts)
            m = counts[used]
            sa[np.repeat(head[used] - np.cumsum(m) + m, m) + np.arange(len(j))] = j[order]
            head[used] += m

    forth(np.array([n]))
    for c in some.tolist():
        done = begins[c]
        while done < head[c]:
            upto = head[c]
            forth(sa[done:upto])
            done = upto
        if held[c]:
            forth(sa[lms_from[c] : ends[c]])

    tail = ends.copy()

    def back(entries: np.ndarray) -> None:
        j = entries - 1
        j = j[j >= 0]
        j = j[small[j]]
        if len(j):
            c = t[j]
            order = np.argsort(c, kind="stable")
            counts = np.bincount(c, minlength=k)
            used = np.flatnonzero(counts)
            m = counts[used]
            sa[np.repeat(tail[used] - 1 + np.cumsum(m) - m, m) - np.arange(len(j))] = j[order]
            tail[used] -= m

    for c in some[::-1].tolist():
        done = ends[c]
        while done > tail[c]:
            upto = tail[c]
            back(sa[upto:done][::-1])
            done = upto
        if head[c] > begins[c]:
            back(sa[begins[c] : head[c]][::-1])
    return sa


def _induce_singly(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same, one suffix at a time."""
    n = len(t)
    ends = np.cumsum(sizes)
    # By suffix, the bucket of the one before it if a pass has to enter that, else -1; [-1] stands for an empty place.
    forth, back = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
    forth[1:n] = np.where(small[:-1], -1, t[:-1])
    back[1:n] = np.where(small[:-1], t[:-1], -1)
    sa = np.full(n, -1, np.int32)
    held = np.bincount(t[lms], minlength=len(sizes))
    order = lms[np.argsort(t[lms], kind="stable")]
    sa[np.repeat(ends - np.cumsum(held), held) + np.arange(len(lms))] = order
    sa, head = sa.tolist(), (ends - sizes).tolist()
    c = int(t[n - 1])
    sa[head[c]] = n - 1
    head[c] += 1
    of = forth.tolist()
    del forth, order
    for i in sa:  # grows ahead of the reader
        if (c := of[i]) >= 0:
            at = head[c]
            sa[at] = i - 1
            head[c] = at + 1
    del of
    tail, of = ends.tolist(), back.tolist()
    for i in reversed(sa):
        if (c := of[i]) >= 0:
            tail[c] = at = tail[c] - 1
            sa[at] = i - 1
    return np.array(sa, np.int32)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of an array of fewer than 2 ** 31 integers from 0."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    t = t.astype(np.int32)
    sizes = np.bincount(t)
    kind = np.uint16 if len(sizes) <= 1 << 16 else np.int32  # narrow numbers are sorted by digits
    small, lms = _classes(t)
    induce = _induce_buckets if np.count_nonzero(sizes) * BUCKET_COST < n else _induce_singly
    symbols = t.astype(kind) if induce is _induce_buckets else t
    if not len(lms):
        return induce(symbols, small, lms, sizes)
    rough = induce(symbols, small, lms, sizes)
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    by_substring = rough[is_lms[rough]]
    # Name the substrings from each LMS place to the next one; equal ones share a name.
    del rough, is_lms
    length = np.zeros(n, np.int32)
    length[lms] = np.append(lms[1:], n) - lms + 1
    a, b = by_substring[:-1], by_substring[1:]
    alike = length[a] == length[b]
    alike &= (b + length[b] <= n) & (a + length[a] <= n)  # what reaches the end is unlike all else
    left, step = np.flatnonzero(alike), 0
    while len(left):
        same = t[a[left] + step] == t[b[left] + step]
        alike[left[~same]] = False
        step += 1
        left = left[same]
        left = left[length[a[left]] > step]
    names = np.empty(n, np.int32)
    names[by_substring] = np.concatenate(([0], np.cumsum(~alike)))
    reduced = names[lms]
    del length, names, alike, left, a, b
    if reduced.max() + 1 == len(lms):
        order = by_substring
    else:
        order = lms[suffix_array(reduced)]
    return induce(symbols, small, order, sizes)


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """By place in the text: the common prefix, up to most, with the suffix sorted just before; 0 for the first one.

    data are bytes; suffixes are compared eight bytes at a time, and what reaches the end of the text is filled up.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + most + 8, 8), (1, 1))
    words = np.ascontiguousarray(words).view("<u8").ravel() if n < 1 << 24 else np.lib.stride_tricks.as_strided(padded[: (len(padded) // 8) * 8].view("<u8"), (n + most + 1,), (1,))
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    lcp = np.zeros(n, np.int32)
    for first in range(0, n, AT_ONCE):
        _extend(words, before, lcp, first + np.flatnonzero(before[first : first + AT_ONCE] >= 0), most)
    ends = np.int32(n) - np.maximum(np.arange(n, dtype=np.int32), before)
    return np.minimum(np.minimum(lcp, ends), np.int32(most))


def _extend(words: np.ndarray, before: np.ndarray, lcp: np.ndarray, left: np.ndarray, most: int) -> None:
    """Common prefixes of the places left with those before them, eight bytes at a time."""
    step = 0
    while len(left) and step < most:
        x = words[left + step] ^ words[before[left] + step]
        unlike = np.flatnonzero(x)
        lcp[left] = step + 8
        low = x[unlike] & (~x[unlike] + np.uint64(1))
        lcp[left[unlike]] = step + (np.bitwise_count(low - np.uint64(1)) >> 3)
        left = left[x == 0]
        step += 8
