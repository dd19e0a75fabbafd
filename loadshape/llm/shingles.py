"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z in lower case), and the number of words of
    each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    blank = _BLANK[data]
    edge = np.diff(blank.view(np.int8))
    first, last = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    # sum of byte * P**place; dividing by P**first makes it a word's own
    powers = np.full(len(data), _P)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers)])
    inverse = np.full(len(data), _P_INVERSE)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    h = mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
    starts = np.concatenate([[1], 1 + np.cumsum([len(r) + 1 for r in raw])]) if raw else np.ones(1, np.int64)
    return h, np.diff(np.searchsorted(first, starts))


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and
    how many each text has. A shorter text's only shingle is all its words."""
    h, counts = word_hashes(texts)
    whole, out, sizes = np.cumsum(counts) - counts, [], np.zeros(len(texts), np.int64)
    combined = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        combined = mix(combined + h[k:len(h) - words + 1 + k]) if len(combined) else combined
    for i, (at, n) in enumerate(zip(whole.tolist(), counts.tolist())):
        if n >= words:
            s = np.unique(combined[at:at + n - words + 1])
        elif n:
            short = np.zeros(1, np.uint64)
            for x in h[at:at + n]:
                short = mix(short + x)
            s = mix(short + np.uint64(n))
        else:
            continue
        out.append(s)
        sizes[i] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes
