"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of ``window`` words of a benchmark item (a shorter item is
one window), seen as the set of its short shingles. Shingles are ordered by
how often all documents hold them. To hold a window, a document must hold
every shingle of it, so one prefix token, the window's rarest shingle, is
necessary: only places where it stands are looked at, and a window whose
rarest shingle stands nowhere is gone at once. A place gives the window's
start by the token's offset; starts before the document's first word or ends
behind its last one fail the positional and length bounds. What is left is
compared word by word.

Documents are read where they lie, once for the counts and once for the join;
no text is shuffled. The benchmark is broadcast in blocks of ``block_bytes``;
with several blocks each goes over all documents, and their findings are
gathered by a stored row number.

Defined cases: null and empty texts have no words, so such documents are clean
and such items never occur; an item without an id marks words but is not
listed; rows that repeat an id are judged one by one; a repeated item id is
listed once; empty tables give no rows or clean documents; columns besides id
and text are not read; texts of any length are read whole.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_total, stash, table, two_columns
from .shingles import mix
from .tokens import text_slices
from .words import Words, byte_kinds, cut_words

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 8_000_000
SLICE_CHARS = 4_000_000
KINDS = byte_kinds(bytes(set(range(128)) - set(b"0123456789abcdefghijklmnopqrstuvwxyz")))
FOUND = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: the group of each member, and its place."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


class Block:
    """The windows of some items, and the words and shingles they are made of."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW, shingle: int = SHINGLE) -> None:
        words = cut_words([text for _, text in items], KINDS)
        self.number = {w: i + 1 for i, w in enumerate(words.distinct)}
        self.names = [name for name, _ in items]
        self.codes = words.code.astype(np.int64) + 1
        self.bits = max(1, len(self.number).bit_length())
        self.shingle = min(shingle, 63 // self.bits)
        n = np.diff(words.ends)
        item, place = runs(np.where(n >= window, n - window + 1, (n > 0).astype(int)))
        start, size = words.ends[:-1][item] + place, np.minimum(n, window)[item]
        self._distinct(start, size, item)
        self._tokens()

    def _distinct(self, start: np.ndarray, size: np.ndarray, item: np.ndarray) -> None:
        for self.seed in range(1, 1000):
            hashed = self.hashes(self.codes, start, size)
            self.hashed, one, which = np.unique(hashed, return_index=True, return_inverse=True)
            if self.equal(self.codes, start, start[one][which], size) and (size == size[one][which]).all():
                break       # no two different windows share a hash
        self.start, self.size = start[one], size[one]
        pairs = np.unique(np.stack([which, item], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        self.items, self.items_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(one) + 1))

    def hashes(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = mix(np.full(len(start), self.seed, np.uint64) + size.astype(np.uint64))
        for j in range(int(size.max(initial=0))):
            on = size > j
            out[on] = mix(out[on] + codes[start[on] + j].astype(np.uint64))
        return out

    def equal(self, codes: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> bool:
        return all((codes[left[on] + j] == codes[np.minimum(right[on] + j, len(codes) - 1)]).all()
                   for j in range(int(size.max(initial=0))) for on in [size > j])

    def shingles(self, codes: np.ndarray, width: int) -> np.ndarray:
        """The shingle from each place, as one number; 0 where one of its words is foreign."""
        out = codes.copy()
        for j in range(1, width):
            out[:len(codes) - j] = (out[:len(codes) - j] << self.bits) | codes[j:]
            out[len(codes) - j:] = 0
        for j in range(width):
            out[:len(codes) - j][codes[j:] == 0] = 0
        return out

    def _tokens(self) -> None:
        """Every window's shingles as (width, number in that width's list)."""
        self.widths = np.minimum(self.size, self.shingle)
        window, place = runs(self.size - self.widths + 1)
        self.of_window, self.offset = window, place
        self.lists, self.token = {}, np.zeros(len(window), np.int64)
        for width in np.unique(self.widths).tolist():
            on = self.widths[window] == width
            keys = self.shingles(self.codes, width)[self.start[window[on]] + place[on]]
            self.lists[width], self.token[on] = np.unique(keys, return_inverse=True)

    def foreign_coded(self, words: Words) -> np.ndarray:
        """The words of other texts by this block's numbers (0: none)."""
        known = np.fromiter(map(self.number.get, words.distinct, [0] * len(words.distinct)), np.int64, len(words.distinct))
        return known[words.code] if len(known) else np.zeros(0, np.int64)

    def places(self, codes: np.ndarray, ends: np.ndarray, width: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places at which one of the sorted ``keys`` stands inside one text, and which."""
        found = self.shingles(codes, width)
        at = np.flatnonzero(found)
        stop = ends[np.searchsorted(ends, at, "right")]
        at = at[at + width <= stop]
        which = np.minimum(np.searchsorted(keys, found[at]), len(keys) - 1)
        same = keys[which] == found[at]
        return at[same], which[same]

    def rank(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's prefix token by the shingles' counts."""
        width = self.widths[self.of_window]
        seen = np.zeros(len(self.token), np.int64)
        for w, n in counts.items():
            seen[width == w] = n[self.token[width == w]]
        order = np.lexsort((self.offset, self.token, seen, self.of_window))
        first = order[np.unique(self.of_window[order], return_index=True)[1]]
        first = first[seen[first] > 0]      # a shingle no document holds rules its window out
        self.prefix = {}
        for w in np.unique(width[first]).tolist():
            on = first[width[first] == w]
            rows = np.unique(np.stack([self.token[on], self.offset[on], self.size[self.of_window[on]]], 1), axis=0)
            token, at = np.unique(rows[:, 0], return_index=True)
            self.prefix[w] = self.lists[w][token], np.append(at, len(rows)), rows[:, 1], rows[:, 2]

    def matches(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence."""
        starts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width, (keys, at, offset, size) in self.prefix.items():
            place, which = self.places(codes, ends, width, keys)
            group, nth = runs((at[1:] - at[:-1])[which])
            row = at[which[group]] + nth
            start, length = place[group] - offset[row], size[row]
            text = np.searchsorted(ends, place[group], "right")
            inside = (start >= ends[text - 1]) & (start + length <= ends[text])
            starts.append(start[inside])
            sizes.append(length[inside])
        pairs = np.unique(np.stack([np.concatenate(starts), np.concatenate(sizes)], 1), axis=0)
        start, size = pairs[:, 0], pairs[:, 1]
        if not len(start):
            return start, size
        hashed = self.hashes(codes, start, size)
        window = np.minimum(np.searchsorted(self.hashed, hashed), len(self.hashed) - 1)
        ok = (self.hashed[window] == hashed) & (self.size[window] == size)
        start, window = start[ok], window[ok]
        for j in range(int(size.max())):
            at = np.minimum(j, self.size[window] - 1)
            ok = codes[start + at] == self.codes[self.start[window] + at]
            start, window = start[ok], window[ok]
        return start, window

    def find(self, words: Words) -> tuple[list, list]:
        """The maximal hit runs, by word number, and the items of each text."""
        codes, ends = self.foreign_coded(words), words.ends
        start, window = self.matches(codes, ends)
        spans, items = [[] for _ in ends[1:]], [[] for _ in ends[1:]]
        if not len(start):
            return spans, items
        change = np.bincount(start, minlength=len(codes) + 1) - np.bincount(start + self.size[window], minlength=len(codes) + 1)
        hit = np.cumsum(change)[:-1] > 0
        edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
        # a run may go on behind a text's end
        begin = np.union1d(np.flatnonzero(edge == 1), ends[:-1][hit[np.minimum(ends[:-1], len(hit) - 1)] & (ends[:-1] < len(hit))])
        stop = np.union1d(np.flatnonzero(edge == -1), ends[1:][(ends[1:] > 0) & hit[np.maximum(ends[1:], 1) - 1]])
        text = np.searchsorted(ends, begin, "right") - 1
        base = ends[text]
        for t, a, b in zip(text.tolist(), (begin - base).tolist(), (stop - base).tolist()):
            spans[t].append({"start": a, "stop": b})
        pairs = np.unique(np.stack([np.searchsorted(ends, start, "right") - 1, window], 1), axis=0)
        group, nth = runs((self.items_at[1:] - self.items_at[:-1])[pairs[:, 1]])
        listed = np.unique(np.stack([pairs[group, 0], self.items[self.items_at[pairs[group, 1]] + nth]], 1), axis=0)
        for t, i in listed.tolist():
            if self.names[i] is not None:
                items[t].append(self.names[i])
        return spans, [sorted(set(x)) for x in items]


def count_shingles(texts: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """How often all documents hold each shingle of the block."""
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def count(batches):
        held = shared.value
        sums = {w: np.zeros(len(keys), np.int64) for w, keys in held.lists.items()}
        for _, slice_texts in text_slices(batches, SLICE_CHARS):
            words = cut_words(slice_texts, KINDS)
            codes = held.foreign_coded(words)
            for w, keys in held.lists.items():
                sums[w] += np.bincount(held.places(codes, words.ends, w, keys)[1], minlength=len(keys))
        for w, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), w)), pa.array(at), pa.array(n[at])], ["width", "token", "n"])

    sums = {w: np.zeros(len(keys), np.int64) for w, keys in block.lists.items()}
    counted = texts.mapInArrow(count, "width long, token long, n long").groupBy("width", "token").agg(F.sum("n").alias("n"))
    for width, token, n in zip(*(c.to_numpy() for c in counted.toArrow().columns)):
        sums[width][token] = n
    return sums


def join_block(texts: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """The FOUND columns of every row of ``texts`` (doc_id, text); ``items``
    is one block of the benchmark."""
    block = Block([tuple(r) for r in items.select("item_id", "text").collect()], window)
    block.rank(count_shingles(texts, block))
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def find(batches):
        for ids, slice_texts in text_slices(batches, SLICE_CHARS):
            words = cut_words(slice_texts, KINDS)
            spans, listed = shared.value.find(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.diff(words.ends), pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(listed, pa.list_(pa.string()))],
                ["doc_id", "n_words", "spans", "items"])

    return texts.mapInArrow(find, FOUND)


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of some ``block_bytes`` (a longer item is a part of its own)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    items = items.withColumn("_size", F.octet_length("text").cast("long"))
    total = items.agg(F.sum("_size")).first()[0] or 0
    if total <= block_bytes:
        return [items]
    placed = stash(running_total(items, ["item_id", "text"], "_size", "_bytes_before", "benchmark")
                   .withColumn("_block", F.floor((F.col("_bytes_before") + F.col("_size")) / block_bytes)), "benchmark-blocks")
    return [placed.where(F.col("_block") == b) for (b,) in sorted(placed.select("_block").distinct().collect())]


def united(spans):
    """Overlapping and touching spans of an array as maximal ones."""
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def add(done, span):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["stop"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), none, add)


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, spans (maximal runs of hit words, from
    word ``start`` to before ``stop``), items (ids of the items that have a
    window in it, sorted)."""
    texts = two_columns(documents, id_col, text_col)
    parts = blocks_of(benchmark, item_col, item_text_col, block_bytes)
    if len(parts) == 1:
        return join_block(texts, parts[0], window)
    rows = stash(texts.withColumn("_row", F.monotonically_increasing_id()), "decontamination")
    numbered = rows.select(F.col("_row").alias("doc_id"), "text")
    found = reduce(DataFrame.unionByName, [join_block(numbered, part, window) for part in parts])
    gathered = found.groupBy(F.col("doc_id").alias("_row")).agg(
        F.max("n_words").alias("n_words"), united(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.select("_row", "doc_id").join(gathered, "_row").drop("_row")


def digests(found: DataFrame) -> DataFrame:
    """What the contract asks for, from the runs and items of each document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS l, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') AS key
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT row_no, p, l, array_to_string(w[p:p + l - 1], ' ') AS key
    FROM (SELECT row_no, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM win))),
hit AS (SELECT row_no, p, l, item_id FROM dw JOIN win USING (l, key)),
n AS (SELECT row_no, count(DISTINCT place) AS n_hit FROM (SELECT row_no, unnest(range(p, p + l)) AS place FROM hit) GROUP BY row_no),
listed AS (SELECT row_no, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
    FROM (SELECT DISTINCT row_no, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row_no) LEFT JOIN listed USING (row_no)
"""


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    return digests(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
