"""Exact dedup over an extendible-hash index on shared files (built-in
functions only).

Build: equal normalised texts are gathered by (64-bit hash, text), so texts
that collide on the hash are told apart by their bytes and form a chain of
records under one key. The directory starts with one slot and doubles until
every bucket holds at most ``capacity`` records or ``max_depth`` is reached;
a bucket that is still too full then (many records under one prefix) just has
a longer chain. The records go to shared files in key order, each owner task
writing the buckets of one key range. Probe: every row looks up its bucket in
the directory and its record in the bucket.

A group of copies is one record (counts are combined before the shuffle), so
no bucket, key range or build task grows with the number of copies; the probe
is a plain join that adaptive execution may split.

Defined cases: a null text equals the empty text; a null id never wins over a
number and all-null groups keep null; rows that repeat an id and its text are
all marked kept if that id wins; an empty table gives an empty result; columns
besides id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, table, two_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CAPACITY = 1 << 18
MAX_DEPTH = 14          # the directory has at most 2**14 slots, whatever the input


def ascii_lower(text):
    """Lower-case A-Z only; the fast built-in does that on pure ASCII texts."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def _slot(key, depth):
    """The ``depth`` leading bits of the key (0 for depth 0)."""
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftrightunsigned", key, (F.lit(64) - depth).cast("int")))


def directory(records: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per slot of the deepest directory that has records: slot
    (``max_depth`` leading bits), local depth and bucket prefix. Doubling step
    d splits every bucket that holds more than ``capacity`` records at depth
    d - 1, so a slot's local depth is the first depth at which it fits."""
    slots = records.groupBy(_slot(F.col("key"), F.lit(max_depth)).alias("slot")).agg(F.count("*").alias("n"))
    steps = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    steps = steps.withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {max_depth} - depth)"))
    fits = (steps.groupBy("depth", "prefix").agg(F.sum("n").alias("size"))
            .where((F.col("size") <= capacity) | (F.col("depth") == max_depth)))
    # at most 2 ** (max_depth + 1) rows
    return (steps.drop("n").join(F.broadcast(fits), ["depth", "prefix"])
            .groupBy("slot").agg(F.min(F.struct("depth", "prefix")).alias("b"))
            .select("slot", F.col("b.depth").alias("local_depth"), F.col("b.prefix").alias("bucket")))


def with_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = two_columns(df, id_col, text_col).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    return d.withColumn("key", F.xxhash64("norm"))


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(directory, index records) from the shared files. A record: key, bucket,
    sha256 and length of the normalised text, keep_id, group_size."""
    records = stash(with_key(df, id_col, text_col)
                    .groupBy("key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
                    .select("key", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"),
                            "keep_id", "group_size"), "exact-records")
    slots = stash(directory(records, capacity, max_depth), "exact-directory")
    placed = (records.withColumn("slot", _slot(F.col("key"), F.lit(max_depth)))
              .join(F.broadcast(slots), "slot").drop("slot"))
    # owner tasks: contiguous key ranges, bucket after bucket
    order = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))      # unsigned order of the key
    index = stash(placed.repartitionByRange(order).sortWithinPartitions(order, "text_sha256"), "exact-index")
    return slots, index


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per input row: doc_id, keep_id (largest id with an equal text),
    group_size, kept, text_sha256, bucket."""
    slots, index = build_index(df, id_col, text_col, capacity, max_depth)
    rows = (with_key(df, id_col, text_col)
            .select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"))
            .withColumn("slot", _slot(F.col("key"), F.lit(max_depth)))
            .join(F.broadcast(slots.select("slot", "bucket")), "slot"))
    found = rows.join(index.drop("local_depth"), ["bucket", "key", "n_bytes", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        "text_sha256", "bucket")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("bucket")


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
