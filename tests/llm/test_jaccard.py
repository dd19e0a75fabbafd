"""Jaccard join against all pairs; signatures, search and components alone."""

import random
import re

import numpy as np
import pytest

from loadshape.llm import jaccard_join as J
from loadshape.llm.components import components
from loadshape.llm.shingles import shingle_sets


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k=3, part=90, whole=100):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}
    links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for b in range(a):
            j, y = sets[b]
            if x and y and i is not None and j is not None and whole * len(x & y) >= part * len(x | y):
                links[a] += 1
                links[b] += 1
                if find(i) != find(j):
                    lo, hi = sorted((find(i), find(j)))
                    root[hi] = lo
    return sorted(str((i, len(x), None if i is None else find(i), links[a] if i is not None else 0)) for a, (i, x) in enumerate(sets))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.7:
            words = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[:-rng.randrange(1, 4)]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 12, 20, 40, 80, 150]))]
            base.append(words)
        rows.append((i * 3 - 20, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


EDGES = [(1000, None), (1001, ""), (1002, " \n\x0b"), (1003, "A b"), (1004, "a B"), (1005, "b a"), (None, "a b"), (1006, "ÄB ü"), (1007, "äB ü"),
         (1008, "x " * 30000), (1009, "x x x"), (1010, "x x x x")]


@pytest.mark.parametrize("seed,group_chars", [(1, 8_000_000), (2, 600)])
def test_against_all_pairs(spark, seed, group_chars):
    rows = corpus(seed, 220) + EDGES
    df = spark.createDataFrame([(t, i, 0, "c") for i, t in rows], "text string, doc_id long, n_shingles int, root string").repartition(5)
    got = J.jaccard_components(df, group_chars=group_chars)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id, r.n_links)) for r in got.collect()) == brute(rows)


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (9, "a b c d"), (7, "q r s t")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in J.jaccard_components(df).collect()} == {(7, 7), (9, 7)}
    assert J.jaccard_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("part,whole", [(90, 100), (80, 100), (60, 100)])
def test_linked_sets_share_a_signature(part, whole):
    rng, classes = np.random.default_rng(0), J.Classes(part, whole)
    tried = 0
    for n in [m for m in range(1, 40) for _ in range(25)] + [100, 333, 1000, 4000]:
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for _ in range(8):
            most = n * (whole - part) // part + 2
            gone, new = rng.integers(0, most), rng.integers(0, most)
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if not len(y) or whole * both < part * (len(x) + len(y) - both):
                continue
            tried += 1
            sig, of = J.signatures(np.concatenate([np.sort(x), y]), np.array([len(x), len(y)]), classes)
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())
    assert tried > 2000


def test_pairs_that_agree_in_empty_parts_alone_share_a_signature():
    """Shingles placed by hand: each filled part differs in one shingle."""
    classes = J.Classes(80, 100)
    rng = np.random.default_rng(2)
    for n in (30, 60, 200):
        level = classes.of(n)
        k = classes.parts(level)
        for _ in range(20):
            empty = set(rng.choice(k, 2, replace=False).tolist())
            filled = [p for p in range(k) if p not in empty]
            parts = [filled[i % len(filled)] for i in range(n)]
            x = np.array([((2 * p + 1) * (1 << 31) // k << 32) + int(rng.integers(1 << 20)) for p in parts], np.uint64)
            y = list(x.tolist())
            for p in filled:            # one more in each part
                if 10 * n < 8 * (len(y) + 1):
                    break
                y.append(((2 * p + 1) * (1 << 31) // k << 32) + int(rng.integers(1 << 20, 1 << 21)))
            x, y = np.unique(x), np.unique(np.array(y, np.uint64))
            assert 100 * len(x) >= 80 * len(y)
            sig, of = J.signatures(np.concatenate([x, y]), np.array([len(x), len(y)]), classes)
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_signatures_of_unlike_sets_seldom_meet_and_grow_with_size_alone():
    rng, classes = np.random.default_rng(7), J.Classes(80, 100)
    n_sets, size = 4000, 190
    hashes = np.sort(rng.integers(0, 1 << 63, (n_sets, size), dtype=np.uint64) * np.uint64(2), axis=1)
    sig, of = J.signatures(hashes.ravel(), np.full(n_sets, size), classes)
    pairs = np.unique(np.stack([sig, of.astype(np.uint64)]), axis=1)
    shared = np.unique(pairs[0], return_counts=True)[1]
    assert (shared > 1).sum() == 0
    for n in (10_000, 100_000):
        long = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert len(J.signatures(long, np.array([n]), classes)[0]) < 3 * n


def test_search_finds_all_pairs():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(150)]
    sets = [np.array(s, np.uint64) for s in sorted({tuple(s.tolist()) for s in sets}, key=len)]
    got = {(i, p) for i, ps in J.t_occurrence(sets, (7, 10)) for p in ps.tolist()}
    want = {(i, p) for i in range(len(sets)) for p in range(i)
            if 10 * len(np.intersect1d(sets[i], sets[p])) >= 7 * len(np.union1d(sets[i], sets[p]))}
    assert got == want


def test_shingle_sets_equal_plain_sets():
    texts = [t or "" for _, t in corpus(5, 60) + EDGES]
    for k in (1, 3, 5):
        hashes, sizes = shingle_sets(texts, k)
        want = [shingles(t, k) for t in texts]
        assert sizes.tolist() == [len(w) for w in want]
        ends = np.cumsum(sizes)
        own = [set(hashes[e - n:e].tolist()) for e, n in zip(ends, sizes)]
        for a in range(0, len(texts), 7):
            for b in range(len(texts)):
                assert len(own[a] & own[b]) == len(want[a] & want[b])


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}


def test_sketches_keep_all_links_and_part_texts_that_share_little():
    rng, (part, whole) = np.random.default_rng(3), (80, 100)
    sets, linked = [], []
    for size in (1, 6, 40, 500, 2000, 9000):
        base = rng.integers(0, 1 << 63, size, np.uint64)
        for cut in (size // 9, size // 3):         # linked, and not
            other = np.concatenate([base[cut:], rng.integers(0, 1 << 63, cut, np.uint64)])
            sets += [base, other]
            linked.append(whole * (size - cut) >= part * (size + cut))
    sizes = np.array([len(x) for x in sets])
    texts = J.Sketches(J.sketches(np.concatenate(sets), sizes), sizes)
    a = np.arange(0, len(sets), 2)
    near = texts.may_link(a, a + 1, (part, whole))
    assert near[np.array(linked)].all()
    assert not texts.may_link(a[6:], np.roll(a[6:], 1), (part, whole)).reshape(-1, 2)[:, 0].any()
    assert not near[9::2].any()            # long texts of which a third differs


def test_texts_that_share_a_phrase_alone_are_not_tied():
    rng = np.random.default_rng(4)
    size, n = 3000, 40
    sets = [rng.integers(0, 1 << 63, size, np.uint64) for _ in range(n)]
    sets.append(sets[7].copy())
    sizes = np.full(n + 1, size)
    texts = J.Sketches(J.sketches(np.concatenate(sets), sizes), sizes)
    i, j = J.ties(np.zeros(n + 1, np.int64), texts, (80, 100))
    assert list(zip(i.tolist(), j.tolist())) == [(7, n)]


def test_rows_of_one_id_that_meet_another_text_are_counted(spark):
    # texts 1 and 2 share most of their shingles, but too few for a link; the rows of 1 are links of each other only
    words = [f"w{i}" for i in range(120)]
    one, two = " ".join(words[:80]), " ".join(words[:70] + words[80:90])
    df = spark.createDataFrame([(1, one), (1, one), (2, two)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in J.jaccard_components(df).collect()) == [(1, 1, 1), (1, 1, 1), (2, 2, 0)]


def test_forest_joins_the_same_nodes_by_few_edges():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (6, 4), (60, 40), (200, 3000), (500, 480)):
        ids = rng.choice(10 ** 9, n, replace=False)
        a, b = ids[rng.integers(0, n, m)], ids[rng.integers(0, n, m)]
        root = {int(i): int(i) for i in ids}
        for _ in range(n):
            for x, y in zip(a.tolist(), b.tolist()):
                root[x] = root[y] = min(root[x], root[y])
        least, node = J.forest(a, b)
        assert dict(zip(node.tolist(), least.tolist())) == {i: r for i, r in root.items() if i != r}
        assert len(node) < n or not m


def test_ties_of_a_signature_do_not_grow_with_its_square(spark, monkeypatch):
    import pyarrow as pa

    class Found(Exception):
        pass

    class Frame:
        def __getattr__(self, name):
            return lambda *args: self

        def mapInArrow(self, run, schema):
            if schema == "a long, b long":
                raise Found(run)
            return self

    monkeypatch.setattr(J, "two_columns", lambda *args: Frame())
    monkeypatch.setattr(J, "stash", lambda *args: Frame())
    with pytest.raises(Found) as found:
        J.jaccard_components(None)
    words = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(300))       # tied with none, so all pairs are compared
    hashes, sizes = shingle_sets([*(f"{words} x{i}" for i in range(300)), other], 3)
    rows = pa.table({"sig": [7] * 301, "a": range(100, 401), "n": sizes, "sketch": pa.array(J.sketches(hashes, sizes), pa.binary())})
    out = pa.Table.from_batches(list(found.value.args[0](rows.to_batches())))
    assert set(out["a"].to_pylist()) | set(out["b"].to_pylist()) == set(range(100, 400))
    assert len(out) < 300
