"""Benchmark decontamination against a search of every window at every place."""

import hashlib
import random
import re

import pytest

from loadshape.llm import decontamination as dc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w, hit, listed = words(text), set(), set()
        for name, item in items:
            parts = words(item)
            size = min(len(parts), window)
            for k in range(len(parts) - size + 1 if size else 0):
                for p in range(len(w) - size + 1):
                    if w[p:p + size] == parts[k:k + size]:
                        hit.update(range(p, p + size))
                        listed |= {str(name)} if name is not None else set()
        out.append((doc_id, len(w), len(hit), len(listed), hashlib.sha256(",".join(sorted(listed)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, window=10, **kw):
    d = spark.createDataFrame([(t, i, 1, 2) for i, t in docs], "text string, doc_id long, item_id int, n_words int")
    b = spark.createDataFrame([(t, i, 5) for i, t in items], "text string, item_id long, doc_id int")
    return sorted((tuple(r) for r in dc.digests(dc.decontaminate(d, b, window=window, **kw)).collect()), key=str)


CASES = [(1, "zero One, two;three four-five six seven eight nine ten eleven"), (2, None), (3, ""), (None, "one two three"), (4, "... !"),
         (5, "one one one one one one one one one one one one one"), (5, "one one one one one one one one one one one one one"),
         (6, "éa Éa 中文 x_y z"), (7, "filler " * 3000 + "one two three four five six seven eight nine ten" + " filler" * 3000),
         (8, "nine ten"), (9, "ten one two three four five six seven eight nine")]
ITEMS = [(10, "ONE two three four five six seven eight nine ten"), (2, "nine ten"), (None, "zero"), (3, None), (4, ""), (10, "one two"),
         (11, "one " * 40), (12, "éa"), (13, "x_y z"), (2, "nine ten")]


@pytest.mark.parametrize("kw", [{}, {"block_bytes": 60}, {"block_bytes": 1}])
def test_cases(spark, kw):
    assert run(spark, CASES, ITEMS, **kw) == brute(CASES, ITEMS, 10)


@pytest.mark.parametrize("seed", range(4))
def test_small_alphabets(spark, seed):
    rng = random.Random(seed)
    window = [3, 4, 2, 10][seed]

    def text(longest):
        return " ".join(rng.choice("abc" if seed % 2 else "abcdefg") for _ in range(rng.randrange(longest)))
    docs = [(rng.randrange(30), text(60)) for _ in range(60)]
    items = [(rng.randrange(12), text(14)) for _ in range(25)]
    assert run(spark, docs, items, window, **({"block_bytes": 50} if seed > 1 else {})) == brute(docs, items, window)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, CASES, []) == brute(CASES, [], 10)


def test_spans_are_maximal_and_reach_only_their_document(spark):
    d = spark.createDataFrame([(1, "x a b"), (2, "a b a b y a b")], "doc_id long, text string")
    b = spark.createDataFrame([("q", "a b"), ("r", "b a")], "item_id string, text string")
    got = {r.doc_id: ([tuple(s) for s in r.spans], r["items"]) for r in dc.decontaminate(d, b).collect()}
    assert got == {1: ([(1, 3)], ["q"]), 2: ([(0, 4), (5, 7)], ["q", "r"])}


def test_the_rarest_shingle_is_the_prefix_token():
    block = dc.Block([("q", "a b c d e")], window=5)
    block.rank({3: dc.np.array([5, 1, 7])})
    keys, at, offset, size = block.prefix[3]
    assert len(keys) == 1 and offset.tolist() == [1] and size.tolist() == [5]
    block.rank({3: dc.np.array([5, 0, 7])})
    assert not block.prefix
