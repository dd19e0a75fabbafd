"""Mixing sources to target weights by a multivariate-hypergeometric
splitting tree.

Each source's documents are dealt into blocks by a keyed hash of their id and
text; a block is some ``BLOCK_WORDS`` words. The target of a source says how
many whole passes over it the mix takes and how many words more. For the rest
the blocks, in a keyed random order, are taken while they fit, and from the
next block its documents in keyed order; then, of all documents left over, those
that still fit, so the mix is short of a target only by less than the smallest
document left. The last ones go to shards by a keyed hash. Which output shard gets which block:
the root of a binary tree holds every source's block quota, and each node hands
a multivariate-hypergeometric draw of its blocks to its left half, so shards
are random, disjoint and of equal size. A shard numbers its blocks by drawing
from each source's permuted list; the order of the documents inside a shard (the
method's local shuffle) is left to whoever writes the shards.

Whole passes deal their blocks to shards in the same way.

The driver and the tree see one number per source, pass and shard, never a block or
a document (the number of sources is taken to be small, as sources are named
collections; ``MAX_SOURCES`` is checked). Reruns agree: every random choice
hashes the seed.

Defined cases: a null text has size 0; such documents are in every whole pass
and take no words; a null source is a source, last in order; rows that repeat
an id are documents of their own (equal rows may be taken differently only by
ties in their keyed order); a null id is allowed; an empty table or one without
words takes nothing; columns besides id, text and source are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT, few_rows, stash, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5                 # size of the mix by the size of all sources
CAP = 2.0                   # a source is taken this often at most
BLOCK_WORDS = 20_000
SHARD_WORDS = 50_000_000
MAX_SOURCES = 100_000
SEED = 7


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words wanted of each source: ``share`` of all words by weight; what
    exceeds ``cap`` times a source goes to the others by weight."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in full)
        open_ -= set(full)
    return out


def split_quotas(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block counts: a binary tree of hypergeometric draws,
    each node giving its left half a share in proportion to its shards."""
    out = np.zeros((shards, len(quota)), np.int64)
    nodes = [(0, shards, quota.astype(np.int64))]
    while nodes:
        first, last, own = nodes.pop()
        if last - first == 1:
            out[first] = own
            continue
        middle = (first + last) // 2
        n = int(own.sum()) * (middle - first) // (last - first)
        draw = np.random.default_rng([seed, first, last]).multivariate_hypergeometric(own, n, method="marginals")
        nodes += [(first, middle, draw), (middle, last, own - draw)]
    return out


def _key(seed: int, *columns):
    return F.xxhash64(F.lit(seed), *columns)


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, WORD_SPLIT), lambda x: x != "")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                     F.size(words).cast("long").alias("size"), F.xxhash64(text).alias("content"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, block_words: int = BLOCK_WORDS,
        shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target,
    copies, taken, shards (the output shard of each copy) and content (a hash
    of the text)."""
    spark = df.sparkSession
    docs = stash(sized(df, id_col, text_col, source_col), "mix-sizes")
    found = docs.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError("more sources than MAX_SOURCES")
    # code-point order, null last
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["size"] for r in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, cap)
    passes = [int(w // s) if s else 0 for w, s in zip(wanted, sizes)]
    plan = few_rows(
        spark,
        [(r["source"], s, float(w), p, int(w - p * s), max(1, s // block_words), i)
         for i, (r, s, w, p) in enumerate(zip(found, sizes, wanted, passes))],
        "source string, source_size long, target double, passes int, rest long, n_blocks long, number int")
    placed = (docs.join(F.broadcast(plan), docs["source"].eqNullSafe(plan["source"])).drop(plan["source"])
              .withColumn("block", F.pmod(_key(seed, "doc_id", "content"), "n_blocks")))
    taken = stash(_take_blocks(placed, seed), "mix-blocks")
    # quota of each (source, pass): one number each, to the splitting tree
    quota = [(r["number"], r["pass"], r["n"], r["words"]) for r in
             taken.groupBy("number", "pass").agg(F.count("*").alias("n"), F.sum("words").alias("words")).orderBy("number", "pass").collect()]
    shards = max(1, round(sum(q[3] for q in quota) / shard_words))
    tree = split_quotas(np.array([q[2] for q in quota], np.int64), shards, seed)
    ends = np.cumsum(tree, 0)
    ranges = few_rows(
        spark,
        [(quota[i][0], quota[i][1], s, int(ends[s, i])) for s, i in zip(*map(np.ndarray.tolist, np.nonzero(tree)))],
        "number int, pass int, shard int, last long")
    spans = ranges.groupBy("number", "pass").agg(F.sort_array(F.collect_list(F.struct("last", "shard"))).alias("spans"))
    taken = (taken.join(F.broadcast(spans), ["number", "pass"])
             .withColumn("shard", F.filter("spans", lambda s: s["last"] > F.col("rank"))[0]["shard"])
             .groupBy("number", "block").agg(F.sort_array(F.collect_list(F.when(~F.col("cut"), F.col("shard")))).alias("shards"),
                                             F.max(F.when(F.col("cut"), F.col("before"))).alias("before"),
                                             F.max(F.when(F.col("cut"), F.col("shard"))).alias("cut_shard")))
    picked = placed.join(taken, ["number", "block"], "left").withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))
    # one block of a source at most is cut: its documents are taken in keyed order while they fit
    in_block = Window.partitionBy("number").orderBy(_key(seed + 2, "doc_id", "content"), "doc_id", "content")
    upto = F.col("before") + F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    cut = (picked.where("before is not null").withColumn("_to", upto)
           .withColumn("shards", F.when(F.col("_to") <= F.col("rest"), F.array_append("shards", F.col("cut_shard"))).otherwise(F.col("shards")))
           .drop("_to"))
    rows = _fill(stash(picked.where("before is null").unionByName(cut).withColumn("_row", F.monotonically_increasing_id()), "mix-rows"), shards, seed)
    copies = F.size("shards")
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"), "shards", "content")


def _fill(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """``rows`` with the partial passes filled up: of the documents they left,
    in keyed order, all that fit, skipping those larger than what is left. Each
    round takes documents up to the first that does not fit; it ends when no
    document of any source fits."""
    spark = rows.sparkSession
    last = F.size("shards") > F.col("passes")
    left = {r[0]: r[1] for r in rows.groupBy("number").agg(F.max("rest") - F.coalesce(F.sum(F.when(last, F.col("size"))), F.lit(0))).collect()}
    order = F.pmod(_key(seed + 3, "doc_id", "content"), F.lit(1 << 40))
    open_ = rows.where(~last & (F.col("size") > 0)).select("_row", "number", "size", order.alias("order"))
    filled = None
    while left:
        room = few_rows(spark, list(left.items()), "number int, room long")
        open_ = stash(open_.join(F.broadcast(room), "number").where("size <= room").withColumn("slice", F.shiftright("order", 28)), "mix-open")
        if not open_.limit(1).count():
            break
        by_slice = Window.partitionBy("number").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        slices = (open_.groupBy("number", "slice").agg(F.sum("size").alias("w"))
                  .select("number", "slice", F.coalesce(F.sum("w").over(by_slice), F.lit(0)).alias("w")))
        inside = Window.partitionBy("number", "slice").orderBy("order", "_row").rowsBetween(Window.unboundedPreceding, 0)
        got = stash(open_.join(slices, ["number", "slice"]).where("w < room").withColumn("upto", F.col("w") + F.sum("size").over(inside))
                    .where("upto <= room").select("_row", "number", "size", "order"), "mix-filled")
        for r in got.groupBy("number").agg(F.sum("size").alias("size")).collect():
            left[r["number"]] -= r["size"]
        filled = got if filled is None else filled.unionByName(got)
        open_ = open_.join(got.select("_row"), "_row", "left_anti").drop("room", "slice")
    if filled is None:
        return rows
    extra = filled.select("_row", F.pmod(F.col("order"), F.lit(shards)).cast("int").alias("_extra"))
    return rows.join(extra, "_row", "left").withColumn(
        "shards", F.when(F.col("_extra").isNotNull(), F.array_append("shards", F.col("_extra"))).otherwise(F.col("shards")))


def _take_blocks(placed: DataFrame, seed: int) -> DataFrame:
    """(number, block, pass, words, before, rank, cut): the blocks each pass
    over a source takes, with their rank and the words before them in the
    pass's keyed order. Sums run in two steps, by slices of that order first,
    so no task holds all blocks of a source."""
    blocks = (placed.groupBy("number", "block").agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("passes", "rest")])
              .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
              .withColumn("order", F.pmod(_key(seed + 1, "number", "block", "pass"), F.lit(1 << 40)))
              .withColumn("slice", F.shiftright("order", 28)))
    blocks = stash(blocks, "mix-order")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    by_slice = before(Window.partitionBy("number", "pass").orderBy("slice"))
    slices = (blocks.groupBy("number", "pass", "slice").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
              .select("number", "pass", "slice", F.coalesce(F.sum("w").over(by_slice), F.lit(0)).alias("w"),
                      F.coalesce(F.sum("n").over(by_slice), F.lit(0)).alias("n")))
    inside = Window.partitionBy("number", "pass", "slice").orderBy("order", "block")
    return (blocks.join(slices, ["number", "pass", "slice"])
            .withColumn("before", F.col("w") + F.coalesce(F.sum("words").over(before(inside)), F.lit(0)))
            .withColumn("rank", F.col("n") + F.row_number().over(inside) - 1)
            .where("pass < passes or before < rest")
            .select("number", "block", "pass", "words", "before", "rank",
                    (F.expr("pass = passes and before + words > rest")).alias("cut")))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
