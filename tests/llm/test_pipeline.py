"""The pipeline against a brute-force version of its stages."""

import numpy as np

import corpus_pipeline as C
from loadshape.llm import toxicity
from loadshape.llm.tokens import Encoder, vocabulary_path
from tests.llm.test_jaccard import brute as jaccard_brute
from loadshape.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, folder):
    rng = np.random.default_rng(8)
    plain, foul = [f"w{a}{b}" for a in "aeiou" for b in "klmnprst"], ["grubzot", "snarfik"]
    rows, labels = [], []
    for i in range(300):
        words = list(rng.choice(plain, int(rng.integers(20, 60))))
        if i % 4 == 0:
            for k in rng.choice(len(words), 3, replace=False):
                words[k] = str(rng.choice(foul))
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 1))
        labels.append((i, int(i % 4 == 0)))
    rows += [(400, rows[1][1].upper(), "en", "s1", 1), (401, rows[2][1], "en", "s2", 1), (402, " ".join(rows[3][1].split()[:-1]), "de", None, 1),
             (403, None, None, None, None), (404, "", "x", "s1", 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    rows = make(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one = C.drop_toxic(spark, docs, folder)
    judged = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()
    bad = {r.doc_id for r in judged if r.predicted}
    kept = [r for r in rows if r[0] not in bad]
    assert one.columns == docs.columns and sorted(map(str, one.collect())) == sorted(map(str, spark.createDataFrame(kept, COLUMNS).collect()))
    assert len([i for i in bad if i < 300 and i % 4 == 0]) > 60 and len([i for i in bad if i >= 300 or i % 4]) < 5

    two = C.drop_equal(spark, one, folder)
    last = {}
    for r in kept:
        key = (r[1] or "").lower()
        last[key] = max(last.get(key, -1), r[0])
    kept = [r for r in kept if last[(r[1] or "").lower()] == r[0]]
    assert sorted(r.doc_id for r in two.collect()) == sorted(r[0] for r in kept)

    three = C.drop_near(spark, two, folder)
    groups = {eval(x)[0]: eval(x)[2] for x in jaccard_brute([(r[0], r[1]) for r in kept], 5, 80, 100)}
    kept = [r for r in kept if groups[r[0]] == r[0]]
    assert 402 not in {r[0] for r in kept}
    assert sorted(r.doc_id for r in three.collect()) == sorted(r[0] for r in kept)

    four = C.mix_sources(spark, three, folder)
    copies = {r.doc_id: r.copies for r in mixing.mix(three).collect()}
    assert four.columns == docs.columns
    mixed = [r for r in kept for _ in range(copies[r[0]])]
    assert sorted(map(str, four.collect())) == sorted(map(str, spark.createDataFrame(mixed, COLUMNS).collect()))

    enc = Encoder(vocabulary_path())
    want = sum(len(enc.encode([r[1] or ""])[0]) // 4 + 1 for r in mixed)
    got = C.run(spark, folder).collect()
    assert sum(r.length for r in got) == want and len({r.sequence_id for r in got}) == len(got)
    assert {r.doc_id for r in got} == {r[0] for r in mixed}


def test_near_copies_of_five_words_go(spark):
    words = [f"w{i}" for i in range(200)]
    near, far = list(words), list(words)
    for k in (40, 80, 120, 160):            # 176 of 216 five-word shingles: 0.815; of three words 186 of 210: 0.886
        near[k] = "other"
    for k in (30, 60, 90, 120, 150):        # 171 of 221: 0.774
        far[k] = "else"
    rows = [(1, " ".join(words), "en", "a", 1), (2, " ".join(near), "en", "a", 1), (3, " ".join(far), "en", "a", 1)]
    left = C.drop_near(spark, spark.createDataFrame(rows, COLUMNS), "")
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]
