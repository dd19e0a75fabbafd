"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the (a, b) edges; the root is the
    component's smallest node. Each round links all larger neighbours of a node
    to its smallest one, then all smaller ones; rounds are stored in the shared
    folder, and their number grows with the logarithm of a component's size."""
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        now = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = now.groupBy("a").agg(F.min("b").alias("m"))
        linked = now.join(low, "a")
        now = (linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = stash(now, "edges")
        was, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
