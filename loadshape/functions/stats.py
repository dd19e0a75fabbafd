"""Distributed exact quantiles for a few large groups.

``F.percentile`` is exact but keeps one group's values in the single task
that finalises the group, which is fine for household-period groups (their
size is bounded by the readings of one meter in one period) but not for
study-wide statistics such as the usage-group thresholds or the peak box
statistics, whose groups grow with the whole table. This helper ranks the
values with a range-partitioned sort instead: each task sorts one value range,
per-partition counts (a table with at most ``partitions x groups`` rows)
turn local positions into global ranks, and only the two rows around each
requested position are kept. Interpolation is linear between the values at
ranks ``floor((n-1)p)`` and ``ceil((n-1)p)`` (the usual ``linear`` rule).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadshape.functions.bits import from_ordered_bits, ordered_bits
from loadshape.plans.hints import broadcast_if_small
from loadshape.session import materialize


# Largest group that may be finalised by one task with ``F.percentile``
# (a value -> count map of at most this many entries, a few tens of MB).
SINGLE_TASK_MAX = 1_000_000


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    by: Sequence[str] = (), partitions: int | None = None,
                    single_task_max: int | None = SINGLE_TASK_MAX) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per ``by`` group.

    Returns one row per group and probability: ``by..., q_index (int),
    q_prob (double), quantile (double)``. NULL / NaN values are ignored.
    The per-partition count table (at most ``partitions x groups`` rows) and
    the wanted-rank table are broadcast after a row-count check, else joined
    by shuffle.

    Size check first (one counting job): when the largest group holds at
    most ``single_task_max`` values, one exact ``percentile`` aggregate is
    cheaper and is used; otherwise the distributed ranking below runs.
    ``single_task_max=None`` always ranks.
    """
    for p in probs:
        if not 0.0 <= float(p) <= 1.0:
            raise ValueError(f"quantile must be within [0, 1]: {p}")
    keys = list(by)
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    vals = df.select(*keys, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    if single_task_max is not None:
        largest = vals.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if largest <= single_task_max:
            q = vals.groupBy(*keys).agg(
                F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("_q"))
            prob_arr = F.array(*[F.lit(float(p)) for p in probs])
            return q.select(*keys, F.posexplode(F.arrays_zip(prob_arr.alias("p"), F.col("_q").alias("q")))
                            .alias("q_index", "_pq")).select(
                *keys, F.col("q_index").cast("int").alias("q_index"),
                F.col("_pq.p").alias("q_prob"), F.col("_pq.q").alias("quantile"))
    # Positions come from the partition id and the in-partition row order,
    # which both readers below must see identically (and which a retried
    # task must not change): write the ranked rows once and read them back.
    # Equal values are one row with a count: a range partition cannot split
    # them, and meters that read 0 are the normal case.
    ordered = materialize(
        vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
        .repartitionByRange(parts, *keys, "_v")
        .withColumn("_pid", F.spark_partition_id())
    )
    seg = ordered.groupBy("_pid", *keys).agg(F.sum("_c").alias("_cnt"))
    w_all = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w_run = w_all.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("_offset", F.coalesce(F.sum("_cnt").over(w_run), F.lit(0))) \
             .withColumn("_n", F.sum("_cnt").over(w_all))

    prob_rows = F.array(*[
        F.struct(F.lit(i).alias("q_index"), F.lit(float(p)).alias("q_prob"))
        for i, p in enumerate(probs)
    ])
    targets = (
        seg.groupBy(*keys).agg(F.max("_n").alias("_n"))
        .select(*keys, "_n", F.inline(prob_rows))
        .withColumn("_h", (F.col("_n") - 1) * F.col("q_prob"))
        .withColumn("_lo", F.floor("_h"))
        .withColumn("_hi", F.ceil("_h"))
        .withColumn("_frac", F.col("_h") - F.col("_lo"))
        .withColumn("_rest", F.col("_hi") - F.col("_h"))
    )
    wanted = targets.groupBy(*keys).agg(F.collect_list(F.struct(
        "q_index", "q_prob", "_frac", "_rest", "_lo", "_hi")).alias("_want"))

    # Join on renamed copies of the keys: both sides derive from ``ordered``.
    seg_r = seg.select(F.col("_pid").alias("_s_pid"), *[F.col(k).alias(f"_sk_{k}") for k in keys], "_offset")
    on = F.col("_pid") == F.col("_s_pid")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_sk_{k}"))
    inside = Window.partitionBy("_pid", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ordered.withColumn("_before", F.coalesce(F.sum("_c").over(inside), F.lit(0))) \
        .join(broadcast_if_small(seg_r), on, "inner").select(
        *keys, "_v", (F.col("_offset") + F.col("_before")).alias("_from"),
        (F.col("_offset") + F.col("_before") + F.col("_c")).alias("_to"))
    # each group's few wanted ranks (two per probability) meet its values
    want_r = wanted.select(F.lit(0).alias("_wk"), *[F.col(k).alias(f"_wk_{k}") for k in keys], "_want")
    on = F.col("_rk") == F.col("_wk")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_wk_{k}"))
    has = lambda w, r: (w[r] >= F.col("_from")) & (w[r] < F.col("_to"))
    hit = ranked.withColumn("_rk", F.lit(0)).join(broadcast_if_small(want_r), on, "inner").select(
        *keys, "_v", "_from", "_to", F.explode(F.filter("_want", lambda w: has(w, "_lo") | has(w, "_hi"))).alias("w"))
    out = hit.groupBy(*keys, F.col("w.q_index").alias("q_index"), F.col("w.q_prob").alias("q_prob")).agg(
        F.min("_v").alias("_lo_v"), F.max("_v").alias("_hi_v"),
        F.first("w._frac").alias("_frac"), F.first("w._rest").alias("_rest"))
    # the built-in percentile's own interpolation, so both paths agree to the bit
    value_at = F.when(F.col("_lo_v") == F.col("_hi_v"), F.col("_lo_v")).otherwise(
        F.col("_rest") * F.col("_lo_v") + F.col("_frac") * F.col("_hi_v"))
    return out.select(*keys, "q_index", "q_prob", value_at.alias("quantile"))


PREFIX_BITS = 16


def selected_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of a few groups of any size, wide: ``keys..., _q0, ...``.

    Selection by bit prefixes, without sorting values: each value becomes an
    integer in the same order, a round counts the next ``PREFIX_BITS`` bits of
    the values that share a wanted rank's prefix (a histogram of at most 65,536
    cells a group and prefix, combined before the shuffle), and the cell that
    holds the rank extends the prefix. After 64 / ``PREFIX_BITS`` rounds the
    prefix is the value. Every round is a scan and a hash aggregate, however the
    values are spread; NULL and NaN are missing; groups without values have none.
    """
    keys = list(keys)
    on = [f"_k{i}" for i in range(len(keys))]
    vals = materialize(df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], ordered_bits(F.col(value).cast("double")).alias("_b")).where(F.col("_b").isNotNull()))
    fields = [F.struct(F.lit(i).alias("q"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]
    ranks = vals.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).select(*on, "_n", F.inline(F.array(*fields)))
    at = (F.col("_n") - 1) * F.col("p")
    both = F.array(F.struct(F.lit(0).alias("side"), F.floor(at).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(at).alias("rank")))
    wanted = ranks.select(*on, "q", (at - F.floor(at)).alias("_frac"), (F.ceil(at) - at).alias("_rest"), F.lit(0).cast("long").alias("_prefix"), F.inline(both))

    def same(left: DataFrame, right: DataFrame, columns: Sequence[str]):
        cond = F.lit(True)
        for c in columns:
            cond = cond & left[c].eqNullSafe(right[f"_r{c}"])
        return cond

    for shift in range(64 - PREFIX_BITS, -1, -PREFIX_BITS):
        wanted = materialize(wanted)
        # the first round looks at all values, the next ones at those below a wanted prefix
        parent = F.lit(0).cast("long") if shift == 64 - PREFIX_BITS else F.shiftright("_b", shift + PREFIX_BITS)
        rows = vals.withColumn("_prefix", parent)
        some = wanted.select(*[F.col(c).alias(f"_r{c}") for c in (*on, "_prefix")]).distinct()
        rows = rows.join(broadcast_if_small(some), same(rows, some, [*on, "_prefix"]), "left_semi")
        cells = rows.groupBy(*on, "_prefix", F.shiftright("_b", shift).alias("_next")).agg(F.count(F.lit(1)).alias("_c"))
        order = Window.partitionBy(*on, "_prefix").orderBy("_next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = cells.withColumn("_upto", F.sum("_c").over(order)).select(
            *[F.col(c).alias(f"_r{c}") for c in (*on, "_prefix")], "_next", (F.col("_upto") - F.col("_c")).alias("_before"), "_upto")
        found = wanted.join(cells, same(wanted, cells, [*on, "_prefix"]) & (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_upto")))
        wanted = found.select(*on, "q", "_frac", "_rest", F.col("_next").alias("_prefix"), "side", (F.col("rank") - F.col("_before")).alias("rank"))
    values = wanted.select(*on, "q", "_frac", "_rest", "side", from_ordered_bits(F.col("_prefix")).alias("_v"))
    ends = values.groupBy(*on, "q").agg(F.min(F.when(F.col("side") == 0, F.col("_v"))).alias("_lo"), F.max(F.when(F.col("side") == 1, F.col("_v"))).alias("_hi"),
                                        F.first("_frac").alias("_frac"), F.first("_rest").alias("_rest"))
    # the built-in percentile's own interpolation, so both paths agree to the bit
    value_at = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_rest") * F.col("_lo") + F.col("_frac") * F.col("_hi"))
    wide = ends.groupBy(*on).agg(*[F.max(F.when(F.col("q") == i, value_at)).alias(f"_q{i}") for i in range(len(probs))])
    return wide.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[f"_q{i}" for i in range(len(probs))])


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                      single_task_max: int = SINGLE_TASK_MAX) -> DataFrame:
    """Exact quantiles for many groups, wide: ``keys..., _q0, _q1, ...``.

    Ordinary groups are finalised by ``F.percentile`` in one task each. A
    counting pass (partial-aggregated) first looks for groups above
    ``single_task_max`` values; such hot groups, if any, are split off and
    selected by :func:`selected_quantiles`, so no oversized
    group is ever held by one task or sorted. There are at most ``rows /
    single_task_max`` hot groups, so their key table is small.
    """
    keys = list(keys)
    arr = F.array(*[F.lit(float(p)) for p in probs])
    # NaN is missing, on every path
    v = F.col(value).cast("double")
    vals = df.select(*keys, F.when(~F.isnan(v), v).alias("_v"))

    def cold_part(frame: DataFrame) -> DataFrame:
        q = frame.groupBy(*keys).agg(F.percentile("_v", arr).alias("_qa"))
        return q.select(*keys, *[F.col("_qa")[i].alias(f"_q{i}") for i in range(len(probs))])

    counts = vals.groupBy(*keys).agg(F.count("_v").alias("_n"))
    hot = counts.where(F.col("_n") > single_task_max).select(*keys)
    if hot.isEmpty():
        return cold_part(vals)
    hot_b = broadcast_if_small(hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys]))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    cold = cold_part(vals.join(hot_b, on, "left_anti"))
    hot_vals = vals.join(hot_b, on, "left_semi")
    return cold.unionByName(selected_quantiles(hot_vals, keys, "_v", probs))
