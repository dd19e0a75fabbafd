"""Token operators against the tokenizers library, document by document."""

import random
import sys
import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from loadshape.llm import packing, token_file, wavelet  # noqa: E402
from loadshape.llm.tokens import Encoder, vocabulary_path  # noqa: E402

ROWS = [(5, "one two, three.\nfour  five"), (1, ""), (2, None), (None, "no id"), (9, "same"), (9, "same"),
        (7, "word " * 5000), (-3, "été ß 中文 😀\t\r\n\n\n x"), (8, "<|endoftext|> !")]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(t, i, "x", 1) for i, t in ROWS], "text string, doc_id long, ids string, start int")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library(plain):
    e, rng = Encoder(vocabulary_path()), random.Random(1)
    alphabets = ["ab 'sz\n\t\r  09_!²½ⅷéÉ中​ \x85\x1c ퟿😀́٣", "ab 's\n\n 9.!é"]
    texts = ["".join(rng.choice(alphabets[k % 2]) for _ in range(rng.randrange(16))) for k in range(4000)]
    for i in range(0, len(texts), 50):
        for t, raw in zip(texts[i:i + 50], e.encode(texts[i:i + 50])):
            assert np.frombuffer(raw, "<u4").tolist() == plain(t), repr(t)


def test_memo_that_is_full(plain):
    e = Encoder(vocabulary_path(), 2)
    for t in ["a b c d\ne f g", "x b c y\nz f q", "a b c d\ne f g"]:
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == plain(t)


def test_known_words_cost_no_calls_each(plain):
    e, calls = Encoder(vocabulary_path()), []
    text = " ".join(f"w{i}x" for i in range(5000)) + "\nlast one"
    first = e.encode_flat([text])[0]
    sys.setprofile(lambda frame, event, what: calls.append(event))
    try:
        again = e.encode_flat([text])[0]
    finally:
        sys.setprofile(None)
    assert len(calls) < 1000            # 5000 and more when each word's ids were an object of their own
    assert again.tolist() == first.tolist() == plain(text)


def test_binary_lengths():
    for n in range(1, 3000):
        got = packing.binary_lengths(n, 1024)
        assert sum(got) == n and got == sorted(got, reverse=True)
        assert all(x & (x - 1) == 0 and x <= 1024 for x in got)
        assert len(got) == n // 1024 + bin(n % 1024).count("1")


def test_packing_is_a_partition_of_all_ids(docs, plain):
    rows = packing.pack(docs, vocabulary_path(), longest=64).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    by_seq = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert by_seq == sorted(by_seq, reverse=True)
    want = sorted((str(i), plain(t) + [1]) for i, t in ROWS)
    got = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.start)):
        assert r.offset == 0 and len(r.ids) == 4 * r.length and r.length & (r.length - 1) == 0
        got.setdefault(str(r.doc_id), []).append(r)
    for key, ids in want:
        if key == "9":                      # the repeated row is packed twice
            assert len(got[key]) % 2 == 0
            continue
        assert [x for r in got[key] for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert {r.doc_tokens for r in got[key]} == {len(ids)}


def test_packing_query_digest_and_empty(spark, docs, plain):
    rows = packing.digests(docs.where("doc_id = 5")).collect()
    ids = plain(ROWS[0][1]) + [1]
    assert sorted((r.start, r.length, r.ids_crc32) for r in rows) == sorted(
        (r.start, r.length, crc(ids[r.start:r.start + r.length])) for r in rows)
    assert packing.digests(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(docs, "", longest=100)


def test_token_file_round_trip(spark, docs, plain, tmp_path):
    folder = str(tmp_path / "tokens")
    token_file.write(docs, folder, vocabulary_path(), shard_tokens=16)
    rows = token_file.read(spark, folder).collect()
    assert len(rows) == len(ROWS)
    at = 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r, (i, t) in zip(sorted(rows, key=lambda r: r.start), order):
        ids = plain(t) + [0]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (i, at, len(ids), ids)
        at += len(ids)
    empty = str(tmp_path / "none")
    token_file.write(docs.limit(0), empty, vocabulary_path())
    assert token_file.read(spark, empty).count() == 0


@pytest.mark.parametrize("top", [1, 2, 5000, 70000])
def test_wavelet_access_count_select(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 3000)
    m = wavelet.WaveletMatrix(wavelet.encode(ids, np.array([1, 2]), np.array([1000, 2000])))
    assert m.doc_ids.tolist() == [1, 2] and m.lengths.tolist() == [1000, 2000]
    for i in range(0, 3000, 61):
        token = int(ids[i])
        at = np.flatnonzero(ids == token)
        assert m.access(i) == token
        assert m.count(token) == len(at) and m.count(token, 100, 2000) == ((at >= 100) & (at < 2000)).sum()
        k = int(np.searchsorted(at, i))
        assert m.select(token, k) == i
    assert m.count(top) == 0
    with pytest.raises(IndexError):
        m.select(top, 0)
    assert (m.decode() == ids).all()
    assert len(wavelet.WaveletMatrix(wavelet.encode(ids[:0], ids[:0], ids[:0])).decode()) == 0


def test_packing_sends_few_texts_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from loadshape.llm import common, packing

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    seen, total = [], packing.running_total

    def watched(df, *rest):
        seen.append(max(r.n for r in spark.range(2000, numPartitions=1).mapInArrow(sizes, "n long").collect()))
        return total(df, *rest)

    monkeypatch.setattr(packing, "running_total", watched)
    df = spark.createDataFrame([(i, "some words " * i) for i in range(20)], "doc_id long, text string")
    out = packing.digests(df)
    assert out.where("start = 0").count() == 20 and seen == [packing.BATCH_ROWS]
    assert spark.conf.get(name) == before
    with common.small_batches(spark, 10 ** 6):      # a smaller size stays
        assert spark.conf.get(name) == before
