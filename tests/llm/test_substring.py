"""Suffix arrays and substring dedup against brute force."""

import random

import numpy as np
import pytest

from loadshape.llm import suffix_array as S
from loadshape.llm import substring_dedup as D


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for _ in range(150):
        n, k = rng.choice([1, 2, 5, 50, 300, 1500]), rng.choice([1, 2, 3, 20, 200])
        s = np.array([rng.randrange(k) for _ in range(n)])
        if rng.random() < 0.3:
            s = np.concatenate([s, s[:n // 2], s])
        x = s.tolist()
        want = sorted(range(len(x)), key=lambda i: x[i:])
        sa = S.suffix_array(s, int(s.max()) + 1)
        assert sa.tolist() == want
        got = S.common_prefixes(s, sa)
        for i in range(1, len(x)):
            a, b = x[want[i]:], x[want[i - 1]:]
            m = 0
            while m < min(len(a), len(b)) and a[m] == b[m]:
                m += 1
            assert got[want[i]] == m


def test_repeated_windows():
    rng = random.Random(2)
    for _ in range(100):
        segments = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(8))]
        segments += rng.choices(segments, k=2) if segments else []
        width, seen, want = rng.choice([1, 3, 7]), set(), []
        for g in segments:
            for i in range(len(g) - width + 1):
                want.append(g[i:i + width] in seen)
                seen.add(g[i:i + width])
        assert S.repeated_windows(segments, width).tolist() == want


def brute(rows, width):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        flags = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if b[k:k + width] in seen:
                flags[k:k + width] = True
            seen.add(b[k:k + width])
        kept = bytes(np.frombuffer(b, np.uint8)[~flags])
        spans = int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum())
        out.append((i, len(b), int(flags.sum()), spans, kept))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randrange(5, 30))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(0, 40))))
        rows.append((i * 2, " ".join(parts) if not (rows and rng.random() < 0.2) else rng.choice(rows)[1]))
    return rows + [(1, None), (3, ""), (-7, "a" * 3000), (5, "ab" * 500 + "xyz"), (None, rows[3][1]), (7, passages[0] * 20)]


@pytest.mark.parametrize("seed,shard,hot", [(1, 4_000_000, 2_000_000), (2, 500, 2_000_000), (3, 700, 300)])
def test_against_brute_force(spark, seed, shard, hot):
    rows = corpus(seed)
    df = spark.createDataFrame([(t, i, b"", 0) for i, t in rows], "text string, doc_id long, kept binary, h int").repartition(3)
    got = D.repeated_bytes(df, width=20, gram=6, shard_bytes=shard, hot_bytes=hot).collect()
    found = sorted(((r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), bytes(r.kept)) for r in got), key=str)
    assert found == sorted(brute(rows, 20), key=str)


def test_repeated_rows_and_empty(spark):
    text = "the quick brown fox jumps over the lazy dog"
    df = spark.createDataFrame([(1, text), (1, text), (2, "so " + text), (2, "x")], "doc_id long, text string")
    got = sorted((r.doc_id, bytes(r.kept).decode()) for r in D.repeated_bytes(df, width=20, gram=6).collect())
    assert got == [(1, text), (1, text), (2, "so "), (2, "x")]
    assert D.repeated_bytes(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        D.repeated_bytes(df, width=5, gram=6)


def test_repeated_keys_across_batches():
    import pyarrow as pa
    from loadshape.llm.substring_dedup import repeated_keys

    keys = [1, 2, 2, 3, 4, 4, 4, 4, 5, 6, 6, 7]
    for width in (1, 2, 3, 5, 12):
        batches = [pa.record_batch([pa.array(keys[i:i + width]), pa.array(range(len(keys))[i:i + width])], ["h", "at"]) for i in range(0, len(keys), width)]
        got = [r for b in repeated_keys(iter(batches)) for r in b.column(1).to_pylist()]
        assert got == [1, 2, 4, 5, 6, 7, 9, 10], width


def test_windows_that_occur_once_stay_out_of_the_suffix_array(monkeypatch):
    rng = random.Random(4)
    passage = rng.randbytes(40)
    segments = [rng.randbytes(200), rng.randbytes(100) + passage, passage + rng.randbytes(100), rng.randbytes(5)]
    entered, sort = [], S._repeated
    monkeypatch.setattr(S, "_repeated", lambda parts, width: entered.extend(parts) or sort(parts, width))
    flags = S.repeated_windows(segments, 20)
    want = np.zeros(181 + 121 + 121, bool)
    want[302:302 + 21] = True
    assert (flags == want).all()
    assert entered == [passage]


def test_strings_travel_alone_and_once(spark, monkeypatch):
    """No document is stored with the strings, and whatever the number of
    anchors the strings are shuffled by shard only."""
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefgh", k=60))
    rows = [(i, "".join(rng.choices("abcdefgh", k=200)) + (passage if i < 3 else "")) for i in range(12)]
    stored, plans = {}, []
    stash = D.stash

    def watched(df, what):
        if what == "suffix-gone":
            plans.append(df._jdf.queryExecution().analyzed().toString())
        stored[what] = stash(df, what)
        return stored[what]

    monkeypatch.setattr(D, "stash", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(D, "HOT_BROADCAST", 0)
    got = D.repeated_bytes(df, width=20, gram=6, shard_bytes=1).collect()
    assert sorted((r.doc_id, sum(s["end"] - s["start"] for s in r.spans or ())) for r in got) == [(i, 60 if i in (1, 2) else 0) for i in range(12)]
    step = stored["suffix-local"]
    assert step.where("h is null and (a is null or bytes is not null)").count() == 0
    assert step.where("doc_id > 2").count() <= step.where("doc_id <= 2").count()
    assert "Join" not in plans[0]
