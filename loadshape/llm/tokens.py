"""Token ids of whole texts by the tokenizers library.

The byte-level merges never cross the pieces that the public splitting pattern
cuts, and without runs of white space every blank and line feed starts a new
piece. So the ids of a blank and the word behind it never depend on the rest
of the text. ``Encoder`` cuts many texts into such words at once, keeps the ids
of up to ``MEMO`` words per Python worker in one array and hands only new words
to the library. Texts with other white space go to the library whole.
"""

from __future__ import annotations

import ctypes
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
MEMO = 500_000            # words kept per worker, some 80 MB
SLICE_CHARS = 6_000_000   # characters encoded at a time: more, so fewer words are looked up again
_BLANK = re.compile(r"[^\S\n]|\x85")     # a line feed only opens a word


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Ids of texts; strings that name special tokens are ordinary text."""

    def __init__(self, path: str, memo_words: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.line_feed = self._whole("\n")
        self.memo_words = memo_words
        self.memo: dict[str, int] = {}          # place of a word behind a blank, or of a line feed and a word
        self.ids = np.zeros(0, "<u4")           # ids of all places
        self.sizes = np.zeros(0, np.int32)      # how many each place has
        names = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(names.values()) + 1, bool)    # ids that begin with a blank
        self.opens[[i for name, i in names.items() if name[0] == "\u0120"]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words in one array, and how many each has. Many are
        encoded as one text, each behind a blank (so its first id begins with
        one) or a line feed (an id of its own)."""
        flat, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int32)]
        for i in range(0, len(new), 512):
            part = new[i:i + 512]
            text = " " + " ".join(part) if lead else "".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            first = np.flatnonzero(self.opens[ids] if lead else ids == np.frombuffer(self.line_feed, "<u4")[0])
            if len(first) != len(part):
                raise ValueError("ids that do not open their words")
            flat.append(ids)
            sizes.append(np.diff(first, append=len(ids)).astype(np.int32))
        return np.concatenate(flat), np.concatenate(sizes)

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: an array of ids, where each word's begin in
        it and how many they are; and the places of those that are no plain
        word, which have none."""
        place = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        kinds: tuple[list[int], list[int], list[int]] = [], [], []      # behind a blank, a line feed first, not plain
        for i in np.flatnonzero(place < 0).tolist():
            word = words[i]
            kinds[2 if not word or _BLANK.search(word) else word[0] == "\n"].append(i)
        new = kinds[0] + kinds[1]
        parts = [self._learn([words[i] for i in some], lead) for some, lead in zip(kinds, (" ", ""))]
        known, odd = len(self.sizes), np.array(kinds[2], np.int64)
        ids = np.concatenate([self.ids, *(flat for flat, _ in parts)])
        sizes = np.concatenate([self.sizes, *(size for _, size in parts), np.zeros(len(odd), np.int32)])
        place[new + kinds[2]] = np.arange(known, len(sizes))
        if new and known < self.memo_words:
            self.memo.update(zip([words[i] for i in new], range(known, known + len(new))))
            self.ids, self.sizes = ids, sizes[:known + len(new)]
        return ids, (np.cumsum(sizes, dtype=np.int64) - sizes)[place], sizes[place], odd

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        # every line starts a word with its line feed, the first line with one that is taken away again
        cut = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        ends = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        table, table_at, size, odd = self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        counts = size[code]
        at = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        ids = table[np.repeat(table_at[code] - at[:-1], counts) + np.arange(at[-1])]
        starts, stops = at[ends[:-1]] + 1, at[ends[1:]]
        whole = {i for i, t in enumerate(texts) if "\n " in t or "\n\n\n" in t or t.endswith("\n\n")}
        if len(odd):
            is_odd = np.zeros(len(size), bool)
            is_odd[odd] = True
            words = np.concatenate([[0], np.cumsum(is_odd[code])])
            whole |= set(np.flatnonzero(words[ends[1:]] > words[ends[:-1]]).tolist())
        parts = [np.frombuffer(self._whole(t), "<u4") if i in whole else ids[a:b]
                 for i, (t, a, b) in enumerate(zip(texts, starts.tolist(), stops.tolist()))]
        return np.concatenate(parts) if parts else ids, np.array([len(p) for p in parts], np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        ids, counts = self.encode_flat(texts)
        raw, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one end id behind each text."""
    counts = counts + 1
    out = np.full(int(counts.sum()), end_id, "<u4")
    own = np.ones(len(out), bool)
    own[np.cumsum(counts) - 1] = False
    out[own] = ids
    return out, counts


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memo_words: int = MEMO) -> Encoder:
    """The worker's encoder for a vocabulary file (kept between batches)."""
    if (path, memo_words) not in _ENCODERS:
        _ENCODERS[path, memo_words] = Encoder(path, memo_words)
    return _ENCODERS[path, memo_words]


def release_memory() -> None:
    """Give memory that is free in this worker back to the system, as the
    worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def clear_worker() -> None:
    """Drop the encoders that other operators left in this worker, and give
    the memory back; for tasks that need none."""
    _ENCODERS.clear()
    release_memory()


def text_slices(batches, limit: int = SLICE_CHARS, rows: int = 1024):
    """(first column, texts) slices of Arrow batches, some ``limit`` characters
    each; a longer text makes a slice of its own. Few rows of a batch become
    Python objects at a time."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if size and size + len(text) > limit:
                    yield keys, texts
                    keys, texts, size = [], [], 0
                keys.append(key)
                texts.append(text)
                size += len(text)
        if keys:
            yield keys, texts
    release_memory()
