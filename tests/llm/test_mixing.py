"""Mixing: targets by hand, quotas of the tree, closeness, edge cases."""

import re

import numpy as np
import pytest

from loadshape.llm import mixing as M


def test_targets():
    assert M.targets([100, 100], [3, 1], 1.0) == [150.0, 50.0]
    # 300 by weight: 225 > 2 * 50, its excess goes to the other
    assert M.targets([50, 150], [3, 1], 1.5) == [100.0, 200.0]
    assert M.targets([0, 10], [3, 1]) == [0.0, 15.0]
    assert M.targets([], []) == [] and M.targets([0], [3]) == [0.0]
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = rng.integers(0, 1000, 7).tolist()
        got = M.targets(sizes, [3, 1, 2, 3, 1, 2, 3])
        assert sum(got) == pytest.approx(1.5 * sum(sizes))
        assert all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes))


def test_split_quotas_is_exact_and_fair():
    quota = np.array([1000, 10, 0, 333])
    tree = M.split_quotas(quota, 7, 1)
    assert (tree.sum(0) == quota).all() and (tree >= 0).all()
    assert np.ptp(tree.sum(1)) <= 3
    assert (tree == M.split_quotas(quota, 7, 1)).all()
    assert M.split_quotas(np.zeros(0, int), 2, 1).shape == (2, 0)


def test_mix_against_its_contract(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 40)), ["b", "a", "B", None, "é"][min(4, int(rng.integers(0, 9)))], i) for i in range(800)]
    rows += [(900, None, "a", 1), (901, "", None, 1), (None, "x y", "a", 1), (902, "z\x0bz q", "a", 1), (5, "same", "a", 1), (5, "same", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    kw = dict(block_words=50, shard_words=800)
    got = M.mix(df, **kw).collect()
    key = lambda r: str((r.doc_id, r.source, r.size, r.copies, r.shards, r.content))
    assert sorted(map(key, got)) == sorted(map(key, M.mix(df.repartition(7), **kw).collect()))
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = ["B", "a", "b", "é", None]
    size = {s: sum(words(t) for _, t, x, _ in rows if x == s) for s in order}
    want = dict(zip(order, M.targets([size[s] for s in order], [3, 1, 2, 3, 1])))
    assert sorted(str((r.doc_id, r.size)) for r in got) == sorted(str((i, words(t))) for i, t, _, _ in rows)
    for s in order:
        mine = [r for r in got if r.source == s]
        assert {(r.source_size, r.target) for r in mine} == {(size[s], want[s])}
        assert abs(sum(r.taken for r in mine) - want[s]) <= 40
        assert all(r.taken == r.copies * r.size and r.copies == len(r.shards) <= 2 for r in mine)
    used = {x for r in got for x in r.shards}
    assert len(used) > 5 and used == set(range(len(used)))


def test_mix_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(df).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in M.mix(one).collect()] == [(0, 0.0)]


def test_a_dominant_document_leaves_no_gap(spark):
    # 700 documents of 1 to 19 words and one that holds about 30 % of the source
    rows = [(i, "w " * (1 + i % 19), "a") for i in range(700)] + [(1000, "w " * 3000, "a"), (1001, "w " * 10000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (1, 2):
        got = M.mix(df, weights=(1, 10), share=0.5, block_words=500, seed=seed).where("source = 'a'").collect()
        assert 0 <= got[0].target - sum(r.taken for r in got) < 1
    wide = M.mix(df, weights=(3, 1), share=0.9, block_words=500, seed=3).where("source = 'a'").collect()
    assert 0 <= wide[0].target - sum(r.taken for r in wide) < 1


def test_few_rows_need_no_python_workers(spark):
    from loadshape.llm.common import few_rows

    schema = "source string, number int, target double, last long"
    rows = [(None, 1, 0.5, 2 ** 40), ("a", 2, 1.0, -1)]
    for some in (rows, rows[:1], []):
        df = few_rows(spark, some, schema)
        assert df.schema == spark.createDataFrame([], schema).schema and sorted(map(tuple, df.collect()), key=str) == sorted(some, key=str)
    assert "ExistingRDD" not in few_rows(spark, rows, schema)._jdf.queryExecution().toString()


def test_numbering_and_mixing_start_no_python_workers(spark, monkeypatch):
    from loadshape.llm import common

    df = spark.createDataFrame([(i, "one two three " * (i + 1), f"s{i % 2}") for i in range(12)], "doc_id long, text string, source string").localCheckpoint()
    numbered = common.running_total(df, ["doc_id"], "doc_id", "before", "numbers")
    frames, made = [], spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, schema=None: frames.append(type(data)) or made(data, schema))
    assert [r.before for r in numbered.orderBy("doc_id").collect()] == [i * (i - 1) // 2 for i in range(12)]
    common.running_total(df, ["doc_id"], "doc_id", "before", "numbers")
    M.mix(df).collect()
    assert frames and list not in frames
