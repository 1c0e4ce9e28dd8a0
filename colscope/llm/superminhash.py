"""Shingle sets and SuperMinHash signatures, vectorised over the elements of many documents.

SuperMinHash gives every element a random permutation of the signature's places. In step j an element offers the
value j + r (r uniform in [0, 1)) to the place that is j-th in its permutation; a place keeps the least offer. As the
offers of one element go to different places, the places are negatively correlated, which makes the share of
equal places a less scattered estimate of the similarity than independent hashes do. Once all
places of a document hold values below j + 1, later steps can't change them, so large documents stop after a few steps.
"""

from __future__ import annotations

import numpy as np
import xxhash

PLACES = 128
WORDS = 5
#: Elements whose permutations are held at once, for PLACES places.
BLOCK = 60_000
#: Word hashes that a worker remembers.
CACHE_WORDS = 100_000

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found
        return found


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of five words in a row; with fewer words one for all of them; none without words.

    A-Z are lower-cased; words lie between ASCII white space (space, tab to carriage return).
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([known[w] for w in words], np.uint64)
    n = min(WORDS, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * MULTIPLIER + h[i: len(h) - n + 1 + i]
    return np.unique(mix(out + np.uint64(n)))


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """A row of `places` 16-bit values for each set; an empty set's row has no meaning."""
    least = np.full((len(sets), places), float(places))
    begin, size, some = 0, 0, []
    block = BLOCK * PLACES // places
    for i, s in enumerate(sets):
        for at in range(0, len(s), block):
            part = s[at: at + block]
            some.append((i, part))
            size += len(part)
            if size >= block:
                offer(some, least, begin, i + 1)
                begin, size, some = i, 0, []
    if some:
        offer(some, least, begin, len(sets))
    bits = least.view(np.uint64) * MULTIPLIER
    return (bits >> np.uint64(48)).astype(np.uint16)


def offer(parts: list[tuple[int, np.ndarray]], least: np.ndarray, begin: int, end: int) -> None:
    """Let the elements of some sets offer their values to the rows begin to end of `least`."""
    places = least.shape[1]
    rows = least[begin:end]
    flat = rows.reshape(-1)
    elements = np.concatenate([p for _, p in parts])
    owner = np.repeat(np.array([i - begin for i, _ in parts]), [len(p) for _, p in parts])
    order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(elements), 1))
    here = np.arange(len(elements))
    for j in range(places):
        drawn = mix(elements + np.uint64((j + 1) * int(MULTIPLIER) % 2**64))
        value = j + (drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + (mix(drawn) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * (places - j)
        k = np.minimum(k.astype(np.int64), places - 1)
        chosen = order[here, k]
        order[here, k] = order[:, j]
        order[:, j] = chosen
        np.minimum.at(flat, owner * places + chosen, value)
        open_rows = rows.max(axis=1) > j + 1
        going = open_rows[owner]
        left = int(going.sum())
        if not left:
            return
        if left < 0.7 * len(elements):
            elements, owner, order = elements[going], owner[going], order[going]
            here = np.arange(len(elements))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on the full sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
