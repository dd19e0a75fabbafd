"""The Merkle manifest against a tree built and folded in full."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loadshape.llm import merkle as mk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row, lower=False):
    row = list(row)
    row[4] = row[4].translate(LOWER) if lower and row[4] is not None else row[4]
    return h("".join(map(field, row)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k:k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def climb(tree, at, node):
    """The siblings of place ``at``, and the top with ``node`` there."""
    proof = []
    for row in tree[:-1]:
        run = list(row[at - at % 16:at - at % 16 + 16])
        proof += [x for k, x in enumerate(run) if k != at % 16]
        run[at % 16] = node
        at, node = at // 16, h("".join(run))
    return proof, node


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by_source[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, r in enumerate(by_source[s]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            inner, node = climb(trees[s], at, leaf(r, bad))
            outer, root = climb(top, k, node)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h("".join(inner + outer)), root, root == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, most):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp int")
    fields = {n: F.col(n) for n in mk.FIELDS}
    other = mk.leaf_digest({**fields, "text": mk.ascii_lower(F.col("text"))})
    rows = df.select("doc_id", "source", mk.leaf_digest(fields).alias("digest"),
                     F.when(mk.tampered(F.col("doc_id")), other).otherwise(mk.leaf_digest(fields)).alias("claimed"))
    return sorted((tuple(r) for r in mk.verify(mk.manifest(rows, most)).collect()), key=str)


def rows(seed, n, sources):
    rng = random.Random(seed)
    return [(rng.choice([None, k, k, rng.randrange(50)]), rng.choice(sources), rng.choice([None, "en", "é"]), rng.choice([None, 5, 17]),
             rng.choice([None, "", "Some Text", "lower", "ÄB 中文", "Long " * 4000])) for k in range(n)]


@pytest.mark.parametrize("n,sources,most", [(700, ["a", "b", None, "é", "ab"], 1), (300, ["a"], 1), (300, ["a", "b"], 3), (17, [None], 3), (16, ["s"], 1),
                                            (40, [f"s{k}" for k in range(40)], 1)])
def test_against_a_full_tree(spark, n, sources, most):
    made = rows(n, n, sources)
    assert run(spark, made, most) == brute(made)


def test_repeated_rows_fill_whole_chunks(spark):
    made = [(7, "a", "en", 1, "Same")] * 90 + [(8, "a", None, None, None)]
    assert run(spark, made, 1) == brute(made)


def test_a_single_row_has_an_empty_proof(spark):
    made = [(3, "a", "en", 1, "Text")]
    assert run(spark, made, 3) == brute(made)
    assert run(spark, made, 3)[0][4] == h("")


def test_empty_table(spark):
    assert run(spark, [], 3) == []


def test_a_resumed_state_gives_the_same_digest():
    children = [h(str(k)).encode() for k in range(16)]
    parent = mk.Parent(b"".join(children))
    for k in range(16):
        assert parent.fold(k, children[k]) == parent.digest
        other = children[:k] + [h("other").encode()] + children[k + 1:]
        assert parent.fold(k, h("other").encode()) == mk.Parent(b"".join(other)).digest != parent.digest
