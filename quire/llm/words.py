"""Word hashes, shingles and sorted sets of whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ODD = np.uint64(0x9E3779B97F4A7C15)
HALF = np.uint64(32)


_R = np.random.default_rng(20240607)
#: A random number for each byte value; A-Z have those of a-z.
BYTE = _R.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
#: What stands between words: white space of ASCII; or all of ASCII but letters and digits.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def then(so_far: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hashes of sequences with one number more each. The shift between the products makes it no polynomial, so that repeated and
    swapped numbers don't cancel out."""
    return (so_far ^ (so_far >> HALF)) * ODD + following


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings in turn, and where each text's begin (one more at the end)."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


_places = np.zeros(0, np.uint64)


def place_numbers(n: int) -> np.ndarray:
    """A random number for each of n places of a word."""
    global _places
    if len(_places) < n:
        _places = mix(np.arange(1, 2 * n + 65, dtype=np.uint64) * ODD)
    return _places


def word_hashes(texts: pa.Array, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, A-Z taken as a-z, and where each text's words begin (one more at the end).

    Each byte at each place of a word has a random number of its own (a product of what byte and place stand for, with its halves
    mixed), and these are summed up: no two words are alike by their build, as under a polynomial, only by chance."""
    data, ends = raw(texts)
    hashes, begins, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + SLICE)
        if stop < len(data):  # not within a word
            after = np.flatnonzero(between[data[stop : stop + SLICE]])
            while not len(after) and stop < len(data):
                stop = min(len(data), stop + SLICE)
                after = np.flatnonzero(between[data[stop : stop + SLICE]])
            stop = min(len(data), stop + (int(after[0]) if len(after) else 0))
        part = data[at:stop]
        alive = ~between[part]
        first = alive.copy()
        first[1:] &= ~alive[:-1]
        cuts = ends[np.searchsorted(ends, at, "left") : np.searchsorted(ends, stop, "left")] - at
        first[cuts] = alive[cuts]
        begin = np.flatnonzero(first)
        if len(begin):
            start = np.zeros(len(part), np.int64)
            start[begin] = begin
            within = np.arange(len(part)) - np.maximum.accumulate(start)
            within[~alive] = 0
            value = BYTE[part]
            value ^= place_numbers(int(within.max()) + 1)[within]
            value *= ODD
            value ^= value >> HALF
            value[~alive] = 0
            hashes.append(mix(np.add.reduceat(value, begin)))
            begins.append(begin + at)
        at = stop
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    b = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return h, np.searchsorted(b, ends, "left")


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on from which so many stand."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = then(out, words[i : n + i])
    return mix(out)


def runs_at(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The same for the places ``at`` only, from each of which k words stand."""
    out = np.full(len(at), k, np.uint64)
    for i in range(k):
        out = then(out, words[at + i])
    return mix(out)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's different k-word shingles as rising 64-bit hashes; with fewer words, one hash of the whole sequence;
    with none, none."""
    words, starts = word_hashes(texts)
    every = runs(words, k)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            out.append(runs(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
