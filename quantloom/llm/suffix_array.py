"""Suffix arrays by induced sorting in numpy, exact to a given depth, and permuted common prefixes.

Suffixes are classified as S (smaller than the next one) or L; the leftmost S of each run (LMS) are sorted first: the
substrings between them get names in order, and the string of names is sorted recursively by doubling. From the
sorted LMS suffixes all L suffixes are induced in one pass over the buckets upward, then all S suffixes in one pass
downward. The passes are linear; each takes a bucket's suffixes a wavefront at a time instead of one by one.

Ties beyond ``depth`` bytes are left in any order: enough to find all equal substrings of that length.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the end of the text is smaller than all bytes."""
    n = len(text)
    differs = np.ones(n, bool)
    differs[:-1] = text[1:] != text[:-1]
    at = np.flatnonzero(differs)
    nearest = np.repeat(at, np.diff(np.concatenate(([-1], at))))
    following = np.full(n, -1, np.int16)
    following[:-1] = text[1:]
    return text[nearest] < following[nearest]


def names_of(text: np.ndarray, small: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """Order-preserving names of the LMS substrings, told apart up to ``depth`` bytes.

    Bytes are taken with their types, L before S, so that no substring is a proper prefix of another.
    """
    n = len(text)
    ends = np.concatenate((lms[1:], [n - 1]))
    names = np.zeros(len(lms), np.int64)
    coded = text.astype(np.uint64) * 2 + small + 1  # 1..512: ten bits, 0 is beyond the end
    for a in range(0, depth, 5):
        word = np.zeros(len(lms), np.int64)
        for k in range(a, a + 5):
            at = lms + k
            ok = at <= ends
            word = (word << 10) | np.where(ok, coded[np.minimum(at, n - 1)], 0).astype(np.int64)
        order = np.lexsort((word, names))
        new = np.concatenate(([0], np.cumsum((names[order][1:] != names[order][:-1]) | (word[order][1:] != word[order][:-1]))))
        names[order] = new
        if (ends < lms + a + 5).all() or new[-1] == len(lms) - 1:
            break
    return names


def sorted_lms(text: np.ndarray, small: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """LMS suffixes in order. Two names cover at least two bytes each, which bounds the doubling."""
    names = names_of(text, small, lms, depth)
    covered = 1
    while covered * 2 < depth and names.max(initial=0) < len(names) - 1:
        ahead = np.full(len(names), -1, np.int64)
        ahead[: len(names) - covered] = names[covered:]
        key = names * (len(names) + 1) + ahead + 1
        names = np.unique(key, return_inverse=True)[1]
        covered *= 2
    return lms[np.argsort(names, kind="stable")]


def place(target: np.ndarray, at: np.ndarray, chars: np.ndarray, suffixes: np.ndarray, step: int) -> None:
    """Append suffixes to the buckets of their bytes in the given order; ``at`` holds the next free places."""
    order = np.argsort(chars, kind="stable")
    chars, suffixes = chars[order], suffixes[order]
    count = np.bincount(chars, minlength=256)
    first = np.cumsum(count) - count
    target[at[chars] + step * (np.arange(len(chars)) - first[chars])] = suffixes
    at += step * count


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes of ``text`` (uint8), sorted by their first ``depth`` bytes."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = classify(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ordered = sorted_lms(text, small, lms, depth) if len(lms) else lms
    by_char = np.searchsorted(text[ordered], np.arange(257)) if len(ordered) else np.zeros(257, np.int64)
    count = np.bincount(text, minlength=256)
    n_small = np.bincount(text[small], minlength=256)
    begin = np.cumsum(count) - count
    middle = begin + count - n_small  # L suffixes of a byte stand before its S suffixes
    out = np.zeros(n, np.int64)

    head = begin.copy()
    place(out, head, text[n - 1 :], np.array([n - 1]), 1)  # before the end there is always an L suffix

    def induce_large(source: np.ndarray) -> None:
        before = source[source > 0] - 1
        before = before[~small[before]]
        if len(before):
            place(out, head, text[before], before, 1)

    for c in np.flatnonzero(count):
        done = begin[c]
        while done < head[c]:
            front, done = out[done : head[c]], head[c]
            induce_large(front)
        induce_large(ordered[by_char[c] : by_char[c + 1]])

    tail = begin + count - 1

    def induce_small(source: np.ndarray) -> None:
        before = source[source > 0] - 1
        before = before[small[before]]
        if len(before):
            place(out, tail, text[before], before, -1)

    for c in np.flatnonzero(count)[::-1]:
        done = begin[c] + count[c] - 1
        while done > tail[c]:
            front, done = out[tail[c] + 1 : done + 1][::-1], tail[c]
            induce_small(front)
        induce_small(out[begin[c] : middle[c]][::-1])
    return out


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position of ``order`` the length, up to ``most``, it shares with the position before it; in text order.

    The result belongs to ``np.sort(order)``.
    """
    shared = np.zeros(len(order), np.int64)
    padded = np.concatenate((text, np.zeros(most + 8, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded.view(), (len(padded) - 7, 8), (1, 1))
    a, b = order[1:], order[:-1]
    rows = np.arange(1, len(order))
    for k in range(0, most, 8):
        x = np.ascontiguousarray(words[a + k]).view(np.uint64)[:, 0] ^ np.ascontiguousarray(words[b + k]).view(np.uint64)[:, 0]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8)
        shared[rows] += same
        go = x == 0
        a, b, rows = a[go], b[go], rows[go]
        if not len(rows):
            break
    shared = np.minimum(shared, most)
    return shared[np.argsort(order, kind="stable")]
