"""Shingle sets of texts, as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240601)
#: Factors of a multilinear hash over the bytes of a word, and of the words of a shingle.
_PLACES = 1024
_FACTORS = _RNG.integers(1, 2**63, _PLACES, dtype=np.uint64) | np.uint64(1)
_WORDS = _RNG.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
#: Bytes that separate words, and A-Z folded to a-z.
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, *range(9, 14)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def scan_words(texts: list[str | None], apart: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with A-Z lower-cased, begin and length of each word in them, its hash, and the number of words of each text.

    ``apart``: which bytes separate words, the blank among them.
    """
    data = [(t or "").encode() + b" " for t in texts]
    flat = FOLD[np.frombuffer(b"".join(data), dtype=np.uint8)]
    size = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    blank = apart[flat]
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1)))
    heads, stops = edge[::2], edge[1::2]
    if not len(heads):
        return flat, heads, heads, np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    length = stops - heads
    offset = np.cumsum(length) - length
    solid = flat[~blank].astype(np.uint64)
    place = np.arange(len(solid)) - np.repeat(offset, length)
    if length.max() > _PLACES:
        solid = solid + (place // _PLACES).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        place = place % _PLACES
    solid += np.uint64(1)
    solid *= _FACTORS[place]
    h = mix(np.add.reduceat(solid, offset) + length.astype(np.uint64))
    return flat, heads, length, h, np.diff(np.searchsorted(heads, np.r_[0, np.cumsum(size)]))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, A-Z lower-cased, and the number of words of each text."""
    return scan_words(texts)[3:]


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets one after the other, each sorted and without repeats, and the size of each set.

    A text of fewer than ``width`` words has its whole sequence as the only shingle;
    one without words has the empty set.
    """
    words, counts = word_hashes(texts)
    if not len(words):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    start = np.cumsum(counts) - counts
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), shingles)
    first = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    h = np.repeat(np.minimum(counts, width), shingles).astype(np.uint64)
    padded = np.r_[words, np.zeros(width, dtype=np.uint64)]
    for k in range(width):
        h += np.where(k < counts[owner], padded[first + k], np.uint64(0)) * _WORDS[k]
    h = mix(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
    return h[new], np.bincount(owner[new], minlength=len(texts))


def set_keys(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each set."""
    prefix = np.r_[np.uint64(0), np.cumsum(mix(flat + np.uint64(0x51ED270B)))]
    end = np.cumsum(sizes)
    return mix(prefix[end] - prefix[end - sizes] + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
