"""Toxicity by class-conditional Kneser-Ney models.

Two models of the characters inside words, one of toxic and one of ordinary
documents, share every count below the longest context: the longest n-grams
are counted per class, and their probabilities back off to continuation counts
taken over both classes together. So an expression that one class rarely shows
is judged by what its parts do in both. A document's evidence is the difference
of the two log-likelihoods per character, in all and counting only what words
have above a few levels (so that many faint words do not drown a clear one); a
logistic curve turns it into a score.

Training counts all labelled rows that are not held out, less those that fit the
few numbers of the logistic curve: every fourth, or some ``CALIBRATION_ROWS`` of
them by the hash of their id if there are more (a documented bound; the counts
have none). The model is
broadcast as tables of ``SLOTS`` hashed slots, so its size is fixed.

Defined cases: a null or empty text has no evidence either way and gets the
score of evidence 0; rows without a label (or with a null one) are scored but
teach nothing; a document that is labelled both ways counts as toxic; a null id
is never held out and never joins a label; repeated rows score alike; without
any labelled rows of both classes every score is 0; columns besides id and text
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, small_batches, stash, table, two_columns
from .tokens import clear_worker, text_slices

ORDER = 6
DISCOUNT = 0.75
SLOTS = 1 << 20
PRIOR = 10.0
ALPHABET = 256               # the uniform base of the backoff
CLEAR = (1.0, 3.0, 5.0)      # log-likelihood differences at which a word is ever clearer evidence
CALIBRATION_ROWS = 50_000
LABEL_ROWS_BROADCAST = 2_000_000
SLICE_CHARS = 1_000_000
BATCH_ROWS = 500             # whole texts sent to a worker at a time
WORDS_AT_ONCE = 10_000       # whose n-grams a worker holds
START, END = "\x02", "\x03"


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words, the word number at each place, and where
    each text's words end (with a 0 before)."""
    cut = pc.split_pattern_regex(pa.array([t.lower() for t in texts], pa.large_string()), "[ \t-\r]+")
    coded = cut.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), cut.offsets.to_numpy()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-grams of all words (a row of code points for each character
    and the word's end), and the number of rows of each word."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    pad = START * (ORDER - 1)
    codes = np.frombuffer((pad + pad.join(w + END for w in words)).encode("utf-32-le", "surrogatepass"), "<u4") if words else np.zeros(0, "<u4")
    if not words:
        return np.zeros((0, ORDER), "<u4"), sizes
    windows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)
    begin = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return windows[at], sizes


def slot_of(codes: np.ndarray, kind: int) -> np.ndarray:
    """Slot of each row of code points in the table number ``kind``."""
    h = np.full(len(codes), 0x9E3779B97F4A7C15 + 2 * kind, np.uint64)
    for k in range(codes.shape[1]):
        h = (h ^ codes[:, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    return (h >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def _strings(codes: np.ndarray) -> list[str]:
    return np.ascontiguousarray(codes).view(f"<U{codes.shape[1]}").ravel().tolist()


def count_grams(labelled: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary) counts of a (text, toxic) frame."""

    def count(batches):
        clear_worker()
        for marks, texts in text_slices(batches, SLICE_CHARS):
            words, code, ends = words_of(texts)
            toxic = np.repeat(np.array(marks, np.float64), np.diff(ends))
            weight = np.stack([np.bincount(code, toxic, len(words)), np.bincount(code, 1 - toxic, len(words))])
            for i in range(0, len(words), WORDS_AT_ONCE):
                rows, sizes = grams(words[i:i + WORDS_AT_ONCE])
                key = _strings(rows)
                coded = pa.array(key, pa.string()).dictionary_encode()
                at, n = coded.indices.to_numpy(), len(coded.dictionary)
                sums = [np.bincount(at, np.repeat(w[i:i + WORDS_AT_ONCE], sizes), n).astype(np.int64) for w in weight]
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(sums[0]), pa.array(sums[1])], ["gram", "toxic", "ordinary"])

    return (labelled.select("toxic", "text").mapInArrow(count, "gram string, toxic long, ordinary long")
            .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))


def slot_tables(counted: DataFrame) -> DataFrame:
    """(kind, slot, a, b, c, d): the model's tables. Kind k: (continuation)
    counts of k-grams; kind 10 + k: sum and number of kinds behind a context of
    k - 1. At the top order a, b are toxic and ordinary counts, and c, d the
    kinds seen in either class."""
    none = F.lit(0).cast("long")
    parts = [counted.select(F.lit(ORDER).alias("kind"), "gram", F.col("toxic").alias("a"), F.col("ordinary").alias("b"), none.alias("c"), none.alias("d")),
             counted.groupBy(F.substring("gram", 1, ORDER - 1).alias("gram")).agg(
                 F.sum("toxic").alias("a"), F.sum("ordinary").alias("b"), F.count_if(F.col("toxic") > 0).alias("c"),
                 F.count_if(F.col("ordinary") > 0).alias("d")).select(F.lit(10 + ORDER).alias("kind"), "*")]
    level = counted.select("gram")
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("a"))
        parts.append(level.select(F.lit(k).alias("kind"), "gram", "a", none.alias("b"), none.alias("c"), none.alias("d")))
        parts.append(level.groupBy(F.substring("gram", 1, k - 1).alias("gram")).agg(F.sum("a").alias("a"), F.count("*").alias("b"))
                     .select(F.lit(10 + k).alias("kind"), "gram", "a", "b", none.alias("c"), none.alias("d")))
    everything = parts[0]
    for p in parts[1:]:
        everything = everything.unionByName(p)

    def place(batches):
        for batch in batches:
            kinds, keys = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), dtype=object)
            slots = np.zeros(len(kinds), np.int64)
            for kind in np.unique(kinds).tolist():
                at, width = np.flatnonzero(kinds == kind), kind % 10 - kind // 10
                codes = np.frombuffer("".join(keys[at]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(at), width)
                slots[at] = slot_of(codes, kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots), *batch.columns[2:]], ["kind", "slot", "a", "b", "c", "d"])

    return (everything.mapInArrow(place, "kind int, slot long, a long, b long, c long, d long")
            .groupBy("kind", "slot").agg(*[F.sum(x).alias(x) for x in "abcd"]))


class Model:
    """Kneser-Ney tables as arrays over the slots."""

    def __init__(self, rows: pa.Table):
        kind, slot = rows["kind"].to_numpy(), rows["slot"].to_numpy()
        self.tables = {}
        for k in (*range(1, ORDER + 1), *range(11, 11 + ORDER)):
            at = kind == k
            columns = "ab" if k == ORDER else "abcd" if k == 10 + ORDER else "a" if k < 10 else "ab"
            self.tables[k] = []
            for c in columns:
                values = np.zeros(SLOTS, np.float32)
                values[slot[at]] = rows[c].to_numpy()[at]
                self.tables[k].append(values)

    # travels as the filled slots only
    def __getstate__(self):
        return {k: [(at := np.flatnonzero(v).astype(np.int32), v[at]) for v in t] for k, t in self.tables.items()}

    def __setstate__(self, state):
        self.tables = {k: [np.zeros(SLOTS, np.float32) for _ in t] for k, t in state.items()}
        for k, t in state.items():
            for values, (at, own) in zip(self.tables[k], t):
                values[at] = own

    def shared(self, spark):
        """The model's broadcast, made once."""
        if not hasattr(self, "_shared"):
            self._shared = spark.sparkContext.broadcast(self)
        return self._shared

    @staticmethod
    def _step(n, total, kinds, below, prior=0.0):
        """One interpolated Kneser-Ney level; ``prior``: further observations
        that come as the level below expects them."""
        p = (np.maximum(n - DISCOUNT, 0) + (DISCOUNT * kinds + prior) * below) / np.maximum(total + prior, 1)
        return np.where(total > 0, p, below)

    def word_evidence(self, words: list[str], at_once: int = WORDS_AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
        """Toxic less ordinary log-likelihood of each word, and its length in
        predicted characters."""
        if len(words) > at_once:        # few words at a time: the tables of n-grams stay small
            parts = [self.word_evidence(words[i:i + at_once]) for i in range(0, len(words), at_once)]
            return tuple(np.concatenate(x) for x in zip(*parts))
        rows, sizes = grams(words)
        below = np.full(len(rows), 1 / ALPHABET)
        for k in range(1, ORDER):
            gram, context = slot_of(rows[:, ORDER - k:], k), slot_of(rows[:, ORDER - k:ORDER - 1], 10 + k)
            total, kinds = self.tables[10 + k]
            below = self._step(self.tables[k][0][gram], total[context], kinds[context], below)
        gram, context = slot_of(rows, ORDER), slot_of(rows[:, :-1], 10 + ORDER)
        (na, no), (ta, to, ka, ko) = (t[gram] for t in self.tables[ORDER]), (t[context] for t in self.tables[10 + ORDER])
        below = self._step(na + no, ta + to, np.maximum(ka, ko), below)
        toxic = self._step(na, ta, ka, below, PRIOR)
        ordinary = self._step(no, to, ko, below, PRIOR)
        sums = np.concatenate([[0], np.cumsum(np.log(toxic) - np.log(ordinary))])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes], sizes

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Per character of each text: the log-likelihood difference, and the
        part of it by which words exceed each of CLEAR."""
        words, code, ends = words_of(texts)
        value, size = self.word_evidence(words)
        if "" in words:                     # what lies before leading white space
            size[words.index("")], value[words.index("")] = 0, 0
        length = _sums(size, code, ends)
        return np.stack([_sums(v, code, ends) for v in (value, *(np.maximum(value - c, 0) for c in CLEAR))]) / np.maximum(length, 1)


def _sums(value: np.ndarray, code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(value[code])])
    return total[ends[1:]] - total[ends[:-1]]


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights and offset of a logistic curve over the rows of ``x`` (Newton
    steps, a weak pull to 0)."""
    scale = np.abs(x).mean(1) + 1e-12
    a = np.concatenate([(x.T / scale), np.ones((x.shape[1], 1))], 1)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, a.T @ (y - p) - 1e-2 * w)
    return np.append(w[:-1] / scale, w[-1])


def held_out(doc_id):
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> tuple[Model, np.ndarray] | None:
    """(model, curve), or None if a class has no labelled rows."""
    marks = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
             .where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    known = two_columns(documents, id_col, text_col).join(broadcast_up_to(marks, LABEL_ROWS_BROADCAST), "doc_id")
    for_curve = F.crc32(F.concat(F.lit("curve "), F.col("doc_id").cast("string"))) % 4 == 0
    # of every fourth row some CALIBRATION_ROWS fit the curve; the counts read all others
    share = CALIBRATION_ROWS / max(1, marks.where(for_curve).count())
    fits = for_curve & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1, share) * (1 << 30)))
    with small_batches(documents.sparkSession, BATCH_ROWS):
        counted = stash(count_grams(known.where(~fits)), "toxic-grams")
    rows = slot_tables(counted).toArrow()
    if not (rows["a"].to_numpy()[rows["kind"].to_numpy() == ORDER].sum() and rows["b"].to_numpy()[rows["kind"].to_numpy() == ORDER].sum()):
        return None
    model = Model(rows)
    with small_batches(documents.sparkSession, BATCH_ROWS):
        seen = evidence(known.where(fits), model, "toxic").toArrow()
    return model, fit_curve(np.stack([seen[c].to_numpy() for c in EVIDENCE]), seen["toxic"].to_numpy().astype(float))


EVIDENCE = ["evidence", *(f"above_{c:g}" for c in CLEAR)]


def evidence(documents: DataFrame, model: Model, keep: str) -> DataFrame:
    """The ``keep`` column of each row and the evidence of its text."""
    shared = model.shared(documents.sparkSession)

    def judge(batches):
        clear_worker()
        for keys, texts in text_slices(batches, SLICE_CHARS):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *map(pa.array, shared.value.evidence(texts))], [keep, *EVIDENCE])

    return documents.select(F.col(keep).cast("long"), "text").mapInArrow(
        judge, ", ".join([f"{keep} long", *(f"{c} double" for c in EVIDENCE)]))


def score(documents: DataFrame, trained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence of every row."""
    rows = two_columns(documents, id_col, text_col)
    if trained is None:
        rows = rows.select("doc_id", *(F.lit(0.0).alias(c) for c in EVIDENCE), F.lit(0.0).alias("score"))
    else:
        model, curve = trained
        power = F.lit(float(curve[-1]))
        for column, weight in zip(EVIDENCE, curve):
            power = power + F.col(column) * float(weight)
        rows = evidence(rows, model, "doc_id").withColumn("score", 1 / (1 + F.exp(-power)))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"), *EVIDENCE)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, train(documents, table(spark, sf_dir, "labels")))
