"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The scan of induced sorting goes bucket by bucket: what one bucket induces is
appended to the other buckets in one step, and to itself in as many rounds as
its longest run of one symbol.
"""

from __future__ import annotations

import numpy as np

from .shingles import _P, _P_INVERSE

COMPARED = 1 << 16      # suffixes compared at a time
HASHED = 1 << 19        # bytes hashed at a time


def _by_doubling(s: np.ndarray) -> np.ndarray:
    """Base case of the recursion (few suffixes a symbol): sort by the first
    symbol, then groups that still agree by twice as many, until none do. A
    suffix's rank is the first place of its group."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    rank, step, places, key = np.empty(n, np.int64), 1, np.arange(n), s[sa].astype(np.int64)
    while True:
        new = np.ones(len(places), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.flatnonzero(new)
        size = np.diff(np.append(group, len(places)))
        rank[sa[places]] = np.repeat(places[group], size)
        places = places[np.repeat(size > 1, size)]
        if not len(places):
            return sa
        some = sa[places]
        after = some + step
        key = rank[some] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        sa[places], key = some[order], key[order]
        step *= 2


def _runs(ch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal symbols."""
    first = np.concatenate([[0], np.flatnonzero(ch[1:] != ch[:-1]) + 1])
    return first, np.diff(np.append(first, len(ch)))


def _induce(s, smaller, lms, start, n_large, end):
    """The suffix array when the leftmost-smaller positions come in order."""
    sa = np.full(len(s), -1, np.int32)
    used = np.flatnonzero(end > start).tolist()
    cut = np.searchsorted(s[lms], np.arange(len(start) + 1))

    def push(batch, want_smaller, place, sign):
        before = batch[batch > 0] - 1
        before = before[smaller[before] == want_smaller]
        if not len(before):
            return
        ch = s[before]
        order = np.argsort(ch, kind="stable")
        before, ch = before[order], ch[order]
        first, n = _runs(ch)
        inside = np.arange(len(ch)) - np.repeat(first, n)
        sa[place[ch] + sign * inside] = before
        place[ch[first]] += sign * n

    head = start.copy()
    for c in used:
        done = start[c]
        while done < head[c]:
            batch, done = sa[done:head[c]].copy(), int(head[c])
            push(batch, False, head, 1)
        push(lms[cut[c]:cut[c + 1]], False, head, 1)
    tail = end - 1
    sa[0] = len(s) - 1
    for c in reversed(used):
        done = end[c] - 1
        if c == 0:
            break
        while done > tail[c]:
            batch, done = sa[tail[c] + 1:done + 1][::-1].copy(), int(tail[c])
            push(batch, True, tail, -1)
        push(sa[start[c]:start[c] + n_large[c]][::-1], True, tail, -1)
    return sa


def _sort(s: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of symbols that end with a single 0."""
    n = len(s)
    if n < 64 or symbols > n // 256:
        return _by_doubling(s)
    # a suffix is smaller than its successor as decided at the next change
    change = np.where(s[:-1] != s[1:], np.arange(n - 1, dtype=np.int32), np.int32(n))
    change = np.minimum.accumulate(change[::-1])[::-1]
    smaller = np.append(s[change] < s[change + 1], True)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    del change
    count = np.bincount(s, minlength=symbols)
    end = np.cumsum(count)
    start, n_large = end - count, np.bincount(s[:-1][~smaller[:-1]], minlength=symbols)
    sa = _induce(s, smaller, lms[np.argsort(s[lms], kind="stable")], start, n_large, end)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    # name the leftmost-smaller substrings by order, equal ones alike
    length = np.zeros(n, np.int32)
    length[lms] = np.diff(np.append(lms, n - 1)) + 1
    a, b = order[:-1], order[1:]
    alike = length[a] == length[b]
    a, b = a[alike], b[alike]
    new = np.ones(len(order), bool)
    if len(a):
        size = length[a]
        first = np.cumsum(size) - size
        inside = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
        equal = s[np.repeat(a, size) + inside] == s[np.repeat(b, size) + inside]
        new[1:][alike] = ~np.logical_and.reduceat(equal, first)
    names = np.cumsum(new) - 1
    if names[-1] + 1 < len(order):
        name_at = np.empty(n, np.int32)
        name_at[order] = names
        order = lms[_sort(name_at[lms], int(names[-1]) + 1)]
    return _induce(s, smaller, order, start, n_large, end)


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of an array over 0..symbols-1."""
    # 16 bits are sorted by radix
    ended = np.zeros(len(s) + 1, np.uint16 if symbols < 1 << 16 - 1 else np.int64)
    ended[:-1] = s
    ended[:-1] += 1
    return _sort(ended, symbols + 1)[1:]


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix, by its position, with the
    one before it in the suffix array. Only where the symbols in front differ
    it is compared; elsewhere it is one less than the position before has."""
    n, width = len(s), 16
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n, dtype=np.int32)
    own = (at == 0) | (before <= 0)
    own[1:] |= s[:-1] != s[np.maximum(before[1:], 1) - 1]
    i = np.flatnonzero(own)
    size = np.zeros(len(i), np.int64)
    padded = np.concatenate([s.astype(np.int32), np.full(width, -1, np.int32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    live = np.flatnonzero(before[i] >= 0)
    while len(live):
        longer = []
        for part in np.array_split(live, -(-len(live) // COMPARED)):     # bounded tables of symbols
            p, q = i[part] + size[part], before[i[part]] + size[part]
            ours = windows[p]
            same = (ours == windows[q]) & (ours >= 0)
            got = np.where(same.all(1), width, np.argmin(same, 1))
            size[part] += got
            longer.append(part[got == width])
        live = np.concatenate(longer)
    number = np.cumsum(own) - 1
    return size[number] - (at - i[number])


def repeated_windows(segments: list[bytes], width: int) -> np.ndarray:
    """Whether each ``width``-byte window of the segments, in order, also
    starts earlier in them. Windows lie inside one segment. Equal segments
    enter the suffix array once: all windows of the later ones start earlier.
    Of the others it gets the windows whose hash occurs twice or more; a window
    with a hash of its own equals no other."""
    out, own = _distinct(segments, width)
    segments = [segments[i] for i in own]
    sizes = np.array([max(0, len(segment) - width + 1) for segment in segments], np.int64)
    shared = _shared_hashes(segments, sizes, width)
    begin = np.cumsum(sizes) - sizes
    edge = np.zeros(len(shared) + 1, bool)
    edge[begin] = edge[-1] = True
    first = np.flatnonzero(shared & (edge[:-1] | ~np.concatenate([[False], shared[:-1]])))
    last = np.flatnonzero(shared & (edge[1:] | ~np.concatenate([shared[1:], [False]])))
    piece = np.searchsorted(begin, first, "right") - 1      # the last of those that begin there: it has windows
    parts = [segments[i][a:b] for i, a, b in zip(piece.tolist(), (first - begin[piece]).tolist(), (last - begin[piece] + width).tolist())]
    flags, chosen = _distinct(parts, width)
    flags[~flags] = _repeated([parts[i] for i in chosen], width)
    fresh = np.zeros(len(shared), bool)
    fresh[shared] = flags
    out[~out] = fresh
    return out


def _distinct(segments: list[bytes], width: int) -> tuple[np.ndarray, list[int]]:
    """Whether each window lies in a segment that equals an earlier one, and
    the numbers of the other segments."""
    first: dict[bytes, int] = {}
    for i, segment in enumerate(segments):
        first.setdefault(segment, i)
    own = list(first.values())
    again = np.ones(len(segments), bool)
    again[own] = False
    return np.repeat(again, [max(0, len(segment) - width + 1) for segment in segments]), own


def _shared_hashes(segments: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
    """Whether the rolling hash of each window occurs more than once; ``sizes``:
    the segments' numbers of windows."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, bool)
    place = np.uint64((1 << total.bit_length()) - 1)        # low bits: the window's number
    keys, at, powers = np.empty(total, np.uint64), 0, np.ones((2, 1), np.uint64)
    lengths = np.array([len(segment) for segment in segments], np.int64)
    group = (np.cumsum(lengths) - 1) // HASHED
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(segments)]
    for i, j in zip(cuts, cuts[1:]):
        data, n = np.frombuffer(b"".join(segments[i:j]), np.uint8), sizes[i:j]
        if not n.sum():
            continue
        if powers.shape[1] < len(data):
            powers = np.array([[_P], [_P_INVERSE]]).repeat(len(data), 1)
            powers[:, 0] = 1
            np.multiply.accumulate(powers, axis=1, out=powers)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[0, :len(data)], out=sums[1:])
        h = (sums[width:] - sums[:-width]) * powers[1, :len(sums) - width]
        valid = np.repeat(np.cumsum(lengths[i:j]) - lengths[i:j] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        keys[at:at + len(valid)] = h[valid]
        at += len(valid)
    keys &= ~place
    keys |= np.arange(total, dtype=np.uint64)
    keys.sort()
    number = (keys & place).astype(np.int64)
    keys >>= np.uint64(total.bit_length())
    same = keys[1:] == keys[:-1]
    out = np.zeros(total, bool)
    out[number[1:][same]] = True
    out[number[:-1][same]] = True
    return out


def _repeated(segments: list[bytes], width: int) -> np.ndarray:
    """The same for segments that all differ."""
    if not segments:
        return np.zeros(0, bool)
    text = np.zeros(sum(map(len, segments)) + len(segments), np.uint16)
    valid = np.zeros(len(text), bool)
    at = 0
    for segment in segments:
        text[at:at + len(segment)] = np.frombuffer(segment, np.uint8)
        text[at:at + len(segment)] += 1
        valid[at:at + max(0, len(segment) - width + 1)] = True
        at += len(segment) + 1
    sa = suffix_array(text, 257)
    new = common_prefixes(text, sa)[sa] < width
    new[0] = True
    first = np.flatnonzero(new)
    earliest = np.minimum.reduceat(sa, first)
    later = np.zeros(len(text), bool)
    later[sa] = sa > np.repeat(earliest, np.diff(np.append(first, len(sa))))
    return later[valid]
