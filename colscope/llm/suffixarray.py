"""Suffix arrays of byte strings by induced sorting, and windows that stand earlier too, in NumPy.

Suffixes are classified (smaller or larger than the next one); the leftmost smaller ones are sorted by their substrings,
which are named and, where names repeat, sorted as a string of their own; all other suffixes are induced from them in
two passes over the buckets of first bytes. A bucket is worked on in portions: each portion of known suffixes induces the ones
before them in one vector step, so a pass is linear and has as many steps as there are bytes and runs of equal bytes.
"""

from __future__ import annotations

import numpy as np


def smaller_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end of the string is smaller than all bytes."""
    n = len(s)
    differs = np.flatnonzero(s[:-1] != s[1:])
    if not len(differs):
        return np.zeros(n, bool)
    nxt = np.searchsorted(differs, np.arange(n))
    inside = nxt < len(differs)
    at = differs[np.minimum(nxt, len(differs) - 1)]
    return inside & (s[at] < s[np.minimum(at + 1, n - 1)])


def spread(s: np.ndarray, found: np.ndarray, room: np.ndarray, sa: np.ndarray, step: int) -> None:
    """Put suffixes into their buckets in order, from the heads on (step 1) or from the tails back (step -1)."""
    letters = s[found]
    order = np.argsort(letters, kind="stable")
    letters, found = letters[order], found[order]
    counts = np.bincount(letters, minlength=len(room))
    starts = np.cumsum(counts) - counts
    rank = np.arange(len(found)) - starts[letters]
    sa[room[letters] + step * rank] = found
    room += step * counts


def induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """The suffix array that a given order of the leftmost smaller suffixes induces."""
    n = len(s)
    sizes = np.bincount(s, minlength=letters)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    sa = np.full(n, -1, np.int64)
    by_letter = lms[np.argsort(s[lms], kind="stable")]
    cuts = np.searchsorted(s[by_letter], np.arange(letters + 1))
    heads = begins.copy()
    sa[heads[s[n - 1]]] = n - 1  # the last suffix is larger than the end behind it
    heads[s[n - 1]] += 1
    for c in np.flatnonzero(sizes):
        at = begins[c]
        while at < heads[c]:
            portion = sa[at: heads[c]]
            at = heads[c]
            before = portion[portion > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                spread(s, before, heads, sa, 1)
        before = by_letter[cuts[c]: cuts[c + 1]] - 1
        if len(before):
            spread(s, before, heads, sa, 1)
    tails = ends - 1
    for c in np.flatnonzero(sizes)[::-1]:
        at = ends[c] - 1
        while at > tails[c]:
            portion = sa[tails[c] + 1: at + 1][::-1]
            at = tails[c]
            before = portion[portion > 0] - 1
            before = before[smaller[before]]
            if len(before):
                spread(s, before, tails, sa, -1)
        portion = sa[begins[c]: heads[c]][::-1]
        before = portion[portion > 0] - 1
        before = before[smaller[before]]
        if len(before):
            spread(s, before, tails, sa, -1)
    return sa


def ranks_by_doubling(names: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a string of names, by doubling the length that is compared."""
    rank, width = names, 1
    while True:
        behind = np.r_[rank[width:], np.full(min(width, len(rank)), -1)][: len(rank)]
        order = np.lexsort((behind, rank))
        fresh = np.r_[False, (rank[order][1:] != rank[order][:-1]) | (behind[order][1:] != behind[order][:-1])]
        new = np.empty(len(rank), np.int64)
        new[order] = np.cumsum(fresh)
        rank, width = new, 2 * width
        if int(rank.max()) == len(rank) - 1 or width >= 2 * len(rank):
            return order


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. s: bytes."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.int64)
    smaller = smaller_types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) < 2:
        return induce(s, smaller, lms, 256)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = induce(s, smaller, lms, 256)
    order = rough[is_lms[rough]]  # sorted by their substrings
    stop = np.r_[lms[1:], n - 1]
    place = np.empty(n, np.int64)
    place[lms] = np.arange(len(lms))
    start, length = order, (stop - lms)[place[order]] + 1
    same = (length[1:] == length[:-1])
    k, left = 0, np.flatnonzero(same)
    while len(left):  # letter by letter, for those that still agree
        equal = s[start[left] + k] == s[start[left + 1] + k]
        same[left[~equal]] = False
        k += 1
        left = left[equal]
        left = left[length[left] > k]
    names = np.empty(len(lms), np.int64)
    names[place[order]] = np.cumsum(np.r_[False, ~same])
    if names.max() < len(lms) - 1:
        order = lms[ranks_by_doubling(names)]
    return induce(s, smaller, order, 256)


def repeated_windows(s: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Starts, in order, of the windows of `width` bytes that stand at an earlier valid start too.

    valid: whether a window may begin at a place. Neighbours in the suffix array are compared by their permuted common
    prefixes, that is for each start with the start that precedes it in the array, up to `width` bytes.
    """
    sa = suffix_array(s)
    sa = sa[valid[sa]]
    if len(sa) < 2:
        return np.empty(0, np.int64)
    padded = np.r_[s, np.zeros(8, np.uint8)].astype(np.uint64)
    words = np.zeros(len(s), np.uint64)
    for i in range(8):
        words |= padded[i: i + len(s)] << np.uint64(8 * i)
    follows = np.full(len(s), -1, np.int64)
    follows[sa[1:]] = sa[:-1]
    left = np.flatnonzero(follows >= 0)
    for k in [*range(0, width - 7, 8), width - 8]:
        left = left[words[left + k] == words[follows[left] + k]]
    same = np.zeros(len(s), bool)
    same[left] = True
    group_start = np.flatnonzero(~same[sa])
    earliest = np.minimum.reduceat(sa, group_start)
    group = np.cumsum(~same[sa]) - 1
    return np.sort(sa[sa != earliest[group]])
