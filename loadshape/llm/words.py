"""Words of many texts at once, by exact byte classes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

from .shingles import mix

LOWER = bytes(range(256)).lower()
WORD, BLANK, CUT = 0, 1, 2
HASHED_EIGHTS = 8               # longer words are hashed one by one
LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)     # masks of the lowest bytes


class Words(NamedTuple):
    distinct: list[bytes]       # the different words
    code: np.ndarray            # number of the word at each place, into ``distinct``
    piece: np.ndarray           # rises from one place to the next where a CUT byte or a text's end lies between
    ends: np.ndarray            # places before each text's end, with a 0 before


def byte_kinds(blank: bytes, cut: bytes = b"") -> bytes:
    """The kind of each byte: BLANK ones end a word, CUT ones a piece too."""
    kinds = bytearray(256)
    for b in blank:
        kinds[b] = BLANK
    for b in cut:
        kinds[b] = CUT
    return bytes(kinds)


class Spans(NamedTuple):
    data: np.ndarray            # the bytes of all texts, A-Z in lower case
    first: np.ndarray           # where each word begins in ``data``
    last: np.ndarray            # and ends
    piece: np.ndarray           # as in ``Words``
    ends: np.ndarray


def word_spans(texts: list[str], kinds: bytes) -> Spans:
    """Where the words of ``texts`` stand."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lowered = (b"\n" + b"\n".join(raw) + b"\n").translate(LOWER)
    data, kind = np.frombuffer(lowered, np.uint8), np.frombuffer(bytearray(lowered.translate(kinds)), np.uint8)
    joints = np.cumsum([0, *(len(r) + 1 for r in raw)])
    kind[joints] = CUT
    inside = kind == WORD
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, last = edge[::2], edge[1::2]
    piece = np.cumsum(kind == CUT, dtype=np.int32)[first].astype(np.int64)      # cuts before each word
    return Spans(data, first, last, piece, np.searchsorted(first, joints))


def span_words(spans: Spans, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words at some places, and the number of each place's word."""
    if not len(at):
        return [], np.zeros(0, np.int32)
    edges = np.stack([spans.first, spans.last], axis=1).ravel()     # words, and what lies between them
    cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(spans.data)])
    coded = cut.take(pa.array(2 * at)).dictionary_encode()
    return byte_strings(coded.dictionary), coded.indices.to_numpy()


def cut_words(texts: list[str], kinds: bytes) -> Words:
    """The words of ``texts`` with A-Z in lower case."""
    spans = word_spans(texts, kinds)
    return Words(*span_words(spans, np.arange(len(spans.first))), spans.piece, spans.ends)


def span_hashes(spans: Spans) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    eights = np.zeros(len(spans.data) // 8 + 2, "<u8")
    eights.view(np.uint8)[:len(spans.data)] = spans.data
    out, todo, at, left = (spans.last - spans.first).astype(np.uint64), np.arange(len(spans.first)), spans.first, spans.last - spans.first
    for _ in range(HASHED_EIGHTS):
        shift = (at & 7).astype(np.uint64) << np.uint64(3)
        key = eights[at >> 3] >> shift | eights[(at >> 3) + 1] << (np.uint64(63) - shift) << np.uint64(1)
        out[todo] = mix(out[todo] * np.uint64(0x9E3779B97F4A7C15) + (key & LOWEST[np.minimum(left, 8)]))
        on = np.flatnonzero(left > 8)
        todo, at, left = todo[on], at[on] + 8, left[on] - 8
    for i in todo.tolist():
        out[i] = xxhash.xxh64_intdigest(spans.data[spans.first[i]:spans.last[i]])
    return out


def byte_strings(column: pa.Array) -> list[bytes]:
    """The values of a binary column without nulls; slicing one buffer is
    several times faster than a Python object for each value."""
    if not len(column):
        return []
    flat = column.cast(pa.large_binary())
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[flat.offset:flat.offset + len(flat) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]
