"""A corpus from documents to packed sequences: toxic documents go, equal
texts and near copies are reduced to one, sources are mixed to their weights,
and what is left is packed.

Each stage reads what its predecessor kept, written as Parquet, and returns the
columns of documents; the last returns the packed pieces. Rows with null ids
pass every stage as rows of their own; rows that repeat an id and text stay or
go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadshape.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from loadshape.llm.common import broadcast_up_to, drop_rows, small_batches, stash, table

MIX_BROADCAST = 1_000_000
# workers and executors still hold memory of the stages before; more words and longer slices only save time
PACK_MEMO, PACK_SLICE = 100_000, 500_000
NEAR_WORDS = 5
NEAR_SIMILARITY = (80, 100)     # op8's own contract is three words and 0.9


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    trained = toxicity.train(docs, table(spark, sf_dir, "labels"))
    row = F.xxhash64("doc_id", _text())
    judged = toxicity.score(docs.select(row.alias("doc_id"), "text"), trained)
    with small_batches(spark, toxicity.BATCH_ROWS):     # the texts are judged in here
        return drop_rows(docs, judged.where("predicted = 1").select("doc_id"), [row])


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case), the row with the largest id."""
    found = exact_dedup.exact_duplicates(docs).where("not kept")
    digest = F.sha2(exact_dedup.ascii_lower(_text()), 256)
    return drop_rows(docs, found.select("doc_id", "text_sha256"), [F.col("doc_id"), digest])


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links (five-word shingles, similarity 0.8), the
    one with the smallest id."""
    found = jaccard_join.jaccard_components(docs, words=NEAR_WORDS, similarity=NEAR_SIMILARITY)
    return drop_rows(docs, found.where("doc_id <> component_id").select("doc_id"), [F.col("doc_id")])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix(docs).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("content").alias("_content"), "copies")
    taken = stash(taken.dropDuplicates(["_id", "_source", "_content"]).where("copies > 0"), "mix-copies")
    same = (F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
            & (F.xxhash64(_text()) == F.col("_content")))
    joined = docs.join(broadcast_up_to(taken, MIX_BROADCAST), same)
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents; a repeated document is packed each time."""
    return packing.digests(docs, PACK_MEMO, PACK_SLICE)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_equal),
    ("n-gram Jaccard join", drop_near),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]
# a language model and a tokenizer are at work: SQL cannot express the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
