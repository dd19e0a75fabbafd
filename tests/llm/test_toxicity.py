"""Toxicity: table counts by brute force, held-out accuracy, edge cases."""

import zlib
from collections import Counter

import numpy as np
import pytest

from loadshape.llm import toxicity as T


def test_gram_counts_and_tables(spark):
    rows = [(1, "Bad bad  word"), (0, "a word\tword"), (0, ""), (1, "été")]
    df = spark.createDataFrame(rows, "toxic int, text string")
    want = {0: Counter(), 1: Counter()}
    for y, t in rows:
        for w in t.lower().replace("\t", " ").split(" "):
            padded = T.START * (T.ORDER - 1) + w + T.END
            for i in range(len(w) + 1):
                if w or " " in t or t == "":
                    want[y][padded[i:i + T.ORDER]] += 1
    got = {r.gram: (r.toxic, r.ordinary) for r in T.count_grams(df).collect()}
    for g in set(want[0]) | set(want[1]):
        if g.strip(T.START) == T.END:       # the empty word between two separators
            continue
        assert got[g] == (want[1][g], want[0][g]), g
    tables = T.slot_tables(T.count_grams(df)).collect()
    three = {g[-3:] for g in {g[-4:] for g in got}}
    left = Counter(g[-3:] for g in {g[-4:] for g in got})
    assert sum(r.a for r in tables if r.kind == 3) == sum(left.values()) and len(three) >= len([r for r in tables if r.kind == 3])


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(1, "aab abb bab"), (0, "aaa bbb bba aab")], "toxic int, text string")
    m = T.Model(T.slot_tables(T.count_grams(df)).toArrow())
    _, sizes = m.word_evidence(["ab", ""])
    assert sizes.tolist() == [3, 1]
    assert m.word_evidence([])[0].shape == (0,)


@pytest.fixture(scope="module")
def judged(spark):
    rng = np.random.default_rng(3)
    plain, foul = [f"w{a}{b}" for a in "aeiou" for b in "klmnprst"], ["grubzot", "snarfik", "blechmo"]
    docs, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain, 40))
        if i % 3 == 0:
            for k in rng.choice(40, 3, replace=False):
                words[k] = str(rng.choice(foul)) + str(rng.choice(["", "o", "ix"]))
        docs.append((" ".join(words), i, 0.5))
        labels.append((i, int(i % 3 == 0)))
    docs += [(None, 1000, 0.0), ("", 1001, 0.0), ("grubzot " * 20000, 1002, 0.0), ("x", None, 0.0), ("wak", 5, 0.0)]
    labels += [(1001, None), (None, 1), (2000, 1)]
    d = spark.createDataFrame(docs, "text string, doc_id long, score double")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    return T.score(d, T.train(d, lab)).collect(), d, lab


def test_held_out_accuracy(judged):
    rows = [r for r in judged[0] if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert {r.doc_id for r in rows} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in rows]) > 0.95


def test_edges(judged, spark):
    rows, d, lab = judged
    assert len(rows) == d.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1000].score == by[1001].score and by[1002].predicted == 1
    assert by[None].held_out is False
    only = T.score(d, T.train(d, lab.where("toxic = 0"))).collect()
    assert {r.score for r in only} == {0.0}
    assert T.score(d.limit(0), T.train(d, lab)).count() == 0


def test_counts_read_all_rows_that_do_not_fit_the_curve(spark, monkeypatch):
    rows = [(i, f"plain{i:04} grub" if i % 2 else f"plain{i:04} calm") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    learned = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    quarter = [i for i in learned if zlib.crc32(f"curve {i}".encode()) % 4 == 0]
    seen = []
    real = T.count_grams
    monkeypatch.setattr(T, "count_grams", lambda known: (seen.append({r.doc_id for r in known.collect()}), real(known))[1])
    T.train(d, lab)
    assert seen[0] == set(learned) - set(quarter)
    monkeypatch.setattr(T, "CALIBRATION_ROWS", len(quarter) // 2)
    T.train(d, lab)
    assert seen[0] < seen[1] < set(learned) and len(seen[1] & set(quarter)) > len(quarter) // 4


class Asked:
    """A frame that keeps what it is asked to run in its workers."""

    def __getattr__(self, name):
        return lambda *args: self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def counting():
    asked = Asked()
    T.count_grams(asked)
    return asked.run


def test_counting_holds_the_grams_of_few_words(spark):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [" ".join("".join(map(chr, w)) for w in rng.integers(97, 123, (400, 8))) for _ in range(250)]
    batch = pa.RecordBatch.from_arrays([pa.array([i % 2 for i in range(250)], pa.int32()), pa.array(texts)], ["toxic", "text"])
    run, sums = counting(), Counter()
    list(run([batch.slice(0, 1)]))      # imports and the like
    tracemalloc.start()
    out = run([batch])
    total = 0
    for b in out:
        total += sum(b["toxic"].to_pylist()) + sum(b["ordinary"].to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == sum(len(w) + 1 for t in texts for w in t.split(" "))
    assert peak < 60e6
    for b in run([batch]):
        for g, x, y in zip(*(c.to_pylist() for c in b.columns)):
            sums[g, 1] += x
            sums[g, 0] += y
    want = Counter()
    for i, t in enumerate(texts):
        for w in t.split(" "):
            padded = T.START * (T.ORDER - 1) + w + T.END
            want.update((padded[k:k + T.ORDER], i % 2) for k in range(len(w) + 1))
    assert +sums == want


def test_counting_drops_what_packing_left_in_the_worker(spark):
    from loadshape.llm import tokens

    tokens.encoder(tokens.vocabulary_path(), 1000)
    list(counting()([]))
    assert not tokens._ENCODERS


def test_training_sends_few_texts_at_a_time(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, stash, judge = spark.conf.get(name), [], T.stash, T.evidence

    class Watched:
        def __init__(self, df):
            self.df = df

        def toArrow(self):
            seen.append(spark.conf.get(name))
            return self.df.toArrow()

    def watched(df, what):
        seen.append(spark.conf.get(name))
        return stash(df, what)

    monkeypatch.setattr(T, "stash", watched)
    monkeypatch.setattr(T, "evidence", lambda *args: Watched(judge(*args)))
    docs = spark.createDataFrame([(i, "foul words" if i % 2 else "fine words") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert T.train(docs, labels) is not None
    assert seen == [str(T.BATCH_ROWS)] * 2 and spark.conf.get(name) == before
