"""Sets of word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

from spreadloom.llm.common import ByteHashes, mix

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TURN = [np.uint64(pow(0xD1B54A32D192ED03, k + 1, 1 << 64)) for k in range(64)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each text data[offsets[i]:offsets[i + 1]], and their number per text.

    Words stand between ASCII white space. A text of one to k - 1 words has one shingle, all its words; an empty text none.
    """
    base, end, n = int(offsets[0]), int(offsets[-1]), len(offsets) - 1
    data, offsets = data[base:end], np.asarray(offsets, np.int64) - base
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(word & (cut[:-1] | np.append(True, ~word[:-1])))
    ends = np.flatnonzero(word & (cut[1:] | np.append(~word[1:], True))) + 1
    names = ByteHashes(data).of(starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(doc, minlength=n)
    first = np.cumsum(words) - words
    m = max(0, len(names) - k + 1)
    grams = np.zeros(m, np.uint64)
    for j in range(k):
        grams += names[j : j + m] * _TURN[j]
    grams = mix(grams)
    parts, counts = [], np.zeros(n, np.int64)
    for i, (f, w) in enumerate(zip(first.tolist(), words.tolist(), strict=True)):
        if w >= k:
            own = np.unique(grams[f : f + w - k + 1])
        elif w:
            own = mix(np.array([sum(int(names[f + j]) * int(_TURN[j + k]) for j in range(w)) % (1 << 64)], np.uint64))
        else:
            continue
        parts.append(own)
        counts[i] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), counts


def set_names(sets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of each whole set: equal sets have both in common, and unequal ones, even among all
    pairs of 10**12 sets, hardly ever."""
    end = np.cumsum(counts)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
        total = np.append(np.uint64(0), np.cumsum(mix(sets ^ np.uint64(salt)), dtype=np.uint64))
        out.append(mix((total[end] - total[end - counts]) * np.uint64(3) + counts.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


class MinHash:
    """Signatures of sets: the minimum of each of `width` hash functions."""

    def __init__(self, width: int = 64, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.width = width
        self.a = rng.integers(0, 1 << 31, width).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, width).astype(np.uint32)

    def of(self, sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(texts, width); rows of empty sets are 0."""
        out = np.zeros((len(counts), self.width), np.uint32)
        full = np.flatnonzero(counts)
        if len(full):
            x = (sets >> np.uint64(32)).astype(np.uint32)
            starts = (np.cumsum(counts) - counts)[full]
            for c in range(self.width):
                out[full, c] = np.minimum.reduceat(x * self.a[c] + self.b[c], starts)
        return out
