"""Suffix-array dedup: bytes covered by a long string that starts earlier.

A byte goes when a ``width``-byte string that covers it also starts earlier:
in a document with a smaller id, or earlier in the same one. Suffix arrays
(suffix_array.py) of shards find the equal strings; two steps keep shards small:

1. Anchors. Each string of ``width`` bytes is assigned the place in it whose
   ``GRAM`` bytes hash lowest, so equal strings have equal anchors. Strings
   whose anchor's hash occurs once in the whole corpus are unique; only the
   others reach a suffix array.
2. Shards of documents, then shards of anchors. A task sorts the suffixes of
   its documents' candidate strings and finds what repeats inside the shard.
   What is first there goes on, by the hash of its anchor, to the shard that
   gets the same strings from everywhere, in one shuffle. Copies meet in the
   first step, so the second gets one per shard of the first.

An anchor whose strings exceed ``HOT_BYTES`` (a passage in very many documents
between ever different neighbours) is not given to one shard: its strings are
grouped by their bytes, each group combined before it is shuffled, and the
earliest of each stays. Sizes are summed by hash buckets first, each of a
quarter of ``HOT_BYTES`` or so, and by anchor only in buckets beyond it.

Defined cases: a null text equals the empty one; texts shorter than ``width``
keep every byte; a null id comes before all numbers; rows that repeat an id
and its text count as one document and get equal results; rows that share an
id with different texts are told apart by a hash of the text; a very long text
is a shard of its own; an empty table gives no rows; columns besides id and
text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, stash, table, two_columns
from .shingles import _P, _P_INVERSE, mix
from .suffix_array import repeated_windows
from .tokens import release_memory

WIDTH = 100
GRAM = 32
SHARD_BYTES = 3_000_000
SLICE_BYTES = 1_000_000
HOT_BYTES = 2_000_000
HOT_BROADCAST = TOUCHED_BROADCAST = 1_000_000
SPAN = 1 << 16          # strings per anchor, at most the width
KEY = ["doc_id", "content"]


def minimum_over(x: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each ``window`` values in a row, by doubling."""
    have = 1
    while 2 * have <= window:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (window - have)], x[window - have:]) if have < window else x


class Anchors:
    """Anchors of documents; powers of the rolling hash are kept per worker."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, gram
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", _P), ("inverse", _P_INVERSE)):
                a = np.full(n, base)
                a[0] = 1
                np.multiply.accumulate(a, out=a)
                setattr(self, name, a)

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(hash, number of the text, first string, last string) of each run of
        strings with one anchor."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        valid = np.maximum(sizes - self.width + 1, 0)
        none = np.zeros(0, np.int64)
        if not valid.sum():
            return none.astype(np.uint64), none, none, none
        self._grow(len(data) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:len(data)])])
        h = mix((sums[self.gram:] - sums[:-self.gram]) * self.inverse[:len(sums) - self.gram])
        place = np.arange(len(h), dtype=np.uint64)
        lowest = minimum_over((h & np.uint64(0xFFFFFFFF00000000)) | place, self.width - self.gram + 1)
        starts = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(texts)), valid)
        inside = np.arange(len(text)) - np.repeat(np.cumsum(valid) - valid, valid)
        anchor = (lowest[starts[text] + inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(text), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(text)) - 1
        return h[anchor[first]], text[first], inside[first], inside[last]


def _slices(batches, limit: int):
    """Lists of rows of Arrow batches with ``limit`` text bytes or so; the
    third column is the text, a fourth one lists anchors (as two arrays)."""
    rows, size = [], 0
    for batch in (b.slice(i, 128) for b in batches for i in range(0, b.num_rows, 128)):
        columns = [c.to_pylist() for c in batch.columns[:3]]
        if batch.num_columns > 3:
            lists = batch.column(3)
            ends, items = lists.offsets.to_numpy().tolist(), [lists.values.field(c).to_numpy() for c in ("at", "h")]
            columns.append([tuple(x[i:j].copy() for x in items) for i, j in zip(ends[:-1], ends[1:])])
        for row in zip(*columns):
            rows.append([*row[:2], row[2].encode("utf-8", "surrogatepass"), *row[3:]])
            size += len(rows[-1][2])
            if size >= limit:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows
    release_memory()


def repeated_keys(batches):
    """The rows of sorted batches whose first column occurs more than once."""
    last, seen = None, False        # the last row so far, and whether it went out
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.concat_batches([last, batch])
        key = batch.column(0).to_numpy()
        same = key[1:] == key[:-1]
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        last, out = batch.slice(batch.num_rows - 1), bool(again[-1])
        if seen:
            again[0] = False
        seen = out or (seen and batch.num_rows == 1)
        yield batch.filter(pa.array(again))


def _order(row):
    return row[0] is not None, row[0] or 0, row[1]


def _spans(flags: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Number of the piece, first and last index in it of each run of True in
    ``flags``, the pieces of which have these (positive) sizes."""
    begin = np.cumsum(sizes) - sizes
    edge, after = np.zeros(len(flags) + 1, bool), np.zeros(len(flags) + 1, bool)
    edge[begin] = after[begin] = after[-1] = True
    first = np.flatnonzero(flags & (edge[:-1] | ~np.concatenate([[False], flags[:-1]])))
    last = np.flatnonzero(flags & (after[1:] | ~np.concatenate([flags[1:], [False]])))
    piece = np.searchsorted(begin, first, "right") - 1
    return piece, first - begin[piece], last - begin[piece]


def _table(rows, names, kinds):
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM,
                   shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, the removed spans (start and
    end in bytes, merged) and the remaining bytes."""
    if not 1 <= gram <= width < SPAN:
        raise ValueError("need 1 <= gram <= width < 65536")
    docs = two_columns(df, id_col, text_col)
    repeats = docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    content = F.xxhash64("text") if repeats else F.lit(0).cast("long")
    docs = docs.select("doc_id", content.alias("content"), "text")

    def send(batches):
        anchors = Anchors(width, gram)
        for rows in _slices(batches, SLICE_BYTES):
            h, text, first, last = anchors.find([r[2] for r in rows])
            ids = pa.array([r[0] for r in rows], pa.int64()).take(pa.array(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), ids, pa.array(np.array([r[1] for r in rows], np.int64)[text]), pa.array(first * SPAN + last - first)],
                ["h", "doc_id", "content", "at"])

    found = docs.mapInArrow(send, "h long, doc_id long, content long, at long")
    again = found.repartition("h").sortWithinPartitions("h").mapInArrow(repeated_keys, found.schema)
    wanted = (again.groupBy(*KEY)
              .agg(F.collect_set(F.struct("at", "h")).alias("anchors"))
              .select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), "anchors"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))
    met = docs.join(wanted, same)

    names = ["doc_id", "content", "h", "a", "b", "bytes"]

    def local(batches):
        """Rows of two kinds: removed spans (a, b) and strings for an anchor's
        shard (h, a, b, bytes)."""

        def batch_of(rows, a, b, h=None, texts=None):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.nulls(len(rows), pa.int64()) if h is None else pa.array(h, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.nulls(len(rows), pa.binary()) if texts is None else pa.array(texts, pa.binary())], names)

        def close(rows):
            rows = sorted(rows, key=_order)
            owner, start, stop, at, hashes, run_of, plain, n_runs = [], [], [], [], [], [], None, 0
            for r in rows:
                same, plain = plain == _order(r), _order(r)
                if same or not len(r[3][0]):   # a repeated row: its twin stands for both
                    continue
                order = np.argsort(r[3][0])
                spots, own = r[3][0][order], r[3][1][order]
                x, y = spots // SPAN, spots // SPAN + spots % SPAN
                new = np.concatenate([[True], x[1:] != y[:-1] + 1])
                first = np.flatnonzero(new)
                owner += [r] * len(first)
                start.append(x[first])
                stop.append(y[np.append(first[1:], len(x)) - 1])
                at.append(spots)
                hashes.append(own)
                run_of.append(np.cumsum(new) - 1 + n_runs)
                n_runs += len(first)
            if not owner:
                return
            start, stop, at, hashes, run_of = map(np.concatenate, (start, stop, at, hashes, run_of))
            flags = repeated_windows([r[2][a:b + width] for r, a, b in zip(owner, start.tolist(), stop.tolist())], width)
            sizes = stop - start + 1
            piece, x, y = _spans(flags, sizes)
            yield batch_of([owner[i] for i in piece.tolist()], x + start[piece], y + start[piece] + width)
            # of each anchor's strings, what lies between the first and the last that is new here
            shift = (np.cumsum(sizes) - sizes - start)[run_of]
            low = at // SPAN + shift
            high = low + at % SPAN
            fresh = np.flatnonzero(~flags)
            i, j = np.searchsorted(fresh, low), np.searchsorted(fresh, high, "right")
            some = np.flatnonzero(i < j)
            a, b = fresh[i[some]] - shift[some], fresh[j[some] - 1] - shift[some] + width
            mine = [owner[k] for k in run_of[some].tolist()]
            yield batch_of(mine, a, b, hashes[some], [r[2][k:m] for r, k, m in zip(mine, a.tolist(), b.tolist())])

        rows, size = [], 0
        for part in _slices(batches, SLICE_BYTES // 8):
            rows += part
            size += sum(int((r[3][0] % SPAN + 1).sum()) + len(r[2]) // 4 for r in part)
            if size >= shard_bytes:
                yield from close(rows)
                rows, size = [], 0
        if rows:
            yield from close(rows)

    step = stash(met.select(*KEY, "text", "anchors").mapInArrow(local, "doc_id long, content long, h long, a long, b long, bytes binary"), "suffix-local")
    strings = step.where("h is not null")
    sizes = strings.select("h", (F.col("b") - F.col("a")).alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    bucket = F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 + 4 * total // hot_bytes))
    full = stash(sizes.groupBy(bucket.alias("_bucket")).agg(F.sum("size").alias("size")).where(F.col("size") > hot_bytes)
                 .select("_bucket"), "suffix-full")
    hot = stash(sizes.withColumn("_bucket", bucket).join(broadcast_up_to(full, HOT_BROADCAST), "_bucket", "left_semi")
                .groupBy("h").agg(F.sum("size").alias("size")).where(F.col("size") > hot_bytes).select("h"), "suffix-hot")
    any_hot = hot.limit(1).count() > 0

    def remote(batches):
        key, rows = None, []

        def close():
            flags = repeated_windows([r[3] for r in rows], width)
            piece, x, y = _spans(flags, np.array([len(r[3]) - width + 1 for r in rows], np.int64))
            return _table([(*rows[i][:2], rows[i][2] + a, rows[i][2] + b + width) for i, a, b in zip(piece.tolist(), x.tolist(), y.tolist())],
                          ["doc_id", "content", "a", "b"], [pa.int64()] * 4)

        for batch in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
            for shard, doc, text, a, seg in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != key:
                    if rows:
                        yield close()
                    key, rows = shard, []
                rows.append((doc, text, a, seg))
        if rows:
            yield close()
        release_memory()

    cold = strings.join(broadcast_up_to(hot, HOT_BROADCAST), "h", "left_anti") if any_hot else strings
    cold = (cold.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
            .select("shard", *KEY, "a", "bytes").repartition("shard").sortWithinPartitions("shard", *KEY, "a"))
    spans = (step.where("h is null").select(*KEY, "a", "b")
             .unionByName(cold.mapInArrow(remote, "doc_id long, content long, a long, b long")))
    if any_hot:
        single = (strings.join(broadcast_up_to(hot, HOT_BROADCAST), "h", "left_semi")
                  .select(*KEY, "a", "bytes", F.explode(F.sequence(F.lit(1), F.length("bytes") - (width - 1))).alias("i"))
                  .select(*KEY, (F.col("a") + F.col("i") - 1).alias("a"), F.substring("bytes", F.col("i"), F.lit(width)).alias("string")))
        place = F.struct(*KEY, "a")
        earliest = single.groupBy("string").agg(F.min(place).alias("earliest"))
        spans = spans.unionByName(single.join(earliest, "string").where(F.col("earliest") < place)
                                  .select(*KEY, "a", (F.col("a") + width).alias("b")))
    gone = stash(spans.groupBy(*KEY).agg(F.collect_set(F.struct("a", "b")).alias("spans")).select(
        F.col("doc_id").alias("_id"), F.col("content").alias("_content"), "spans"), "suffix-gone")
    whole = docs.select(*KEY, F.col("text").cast("binary").alias("bytes"))
    if gone.count() <= TOUCHED_BROADCAST:
        # documents that lose nothing are not shuffled
        keys = F.broadcast(gone.select("_id", "_content"))
        rest = whole.join(keys, same, "left_anti").withColumn("spans", F.lit(None).cast(gone.schema["spans"].dataType))
        joined = whole.join(keys, same, "left_semi").join(gone, same).select("doc_id", "bytes", "spans").unionByName(rest.select("doc_id", "bytes", "spans"))
    else:
        joined = whole.join(gone, same, "left")

    def cut(batches):
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            out = []
            for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                kept, merged, end = [], [], 0
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if merged and a <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], b)
                    else:
                        merged.append({"start": a, "end": b})
                for s in merged:
                    kept.append(text[end:s["start"]])
                    end = s["end"]
                out.append((doc, len(text), merged, b"".join([*kept, text[end:]])))
            yield _table(out, ["doc_id", "n_bytes", "spans", "kept"],
                         [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()])

    return joined.select("doc_id", "bytes", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeated_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * WIDTH})) AS m FROM
      (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - {WIDTH - 1}))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
t AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {WIDTH} THEN 0 ELSE 1 END AS fresh FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + {WIDTH} AS b FROM
      (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM t) GROUP BY doc_id, span),
p AS (SELECT s.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS z FROM s),
g AS (SELECT p.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS e,
             string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
