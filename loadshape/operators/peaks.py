"""Peak tables over the top-3 columns of an aggregate: peak-hour
distribution, month x hour heatmaps (overall and before/after adoption),
peak-size histogram and per-rank box statistics.

Every table is an aggregate over the unpivoted (rank, time, kWh) pairs, so
all work is partial-aggregated map-side; hour axes are fixed (0..23) and
the month axis is the months present, so schemas are static.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadshape import schemas as S
from loadshape.functions.stats import exact_quantiles
from loadshape.session import materialize

HOURS = 24
MODES = ("count", "consumption")


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError("mode must be 'count' or 'consumption'")


def peaks_long(df: DataFrame, keep: tuple[str, ...] = (S.ID, S.TS, S.PRICE, S.ACTIVE)) -> DataFrame:
    """Wide peaks -> one row per (group, rank) with ``peak_time`` and
    ``peak_consumption``; pairs with a missing time or value are dropped."""
    keep = tuple(c for c in keep if c in df.columns)
    stacked = df.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(i).alias("rank"), F.col(f"peak{i}_time").alias("peak_time"),
                 F.col(f"peak{i}_consumption").alias("peak_consumption"))
        for i in (1, 2, 3)])))
    return stacked.where(F.col("peak_time").isNotNull() & F.col("peak_consumption").isNotNull())


def peak_hour_distribution(df: DataFrame, mode: str = "count") -> DataFrame:
    """Peaks per hour of day (``n_peaks``) or their summed kWh
    (``peak_consumption``), by hour; hours without peaks are absent."""
    _check_mode(mode)
    p = peaks_long(df).withColumn("hour", F.hour("peak_time").cast("int"))
    if mode == "count":
        return p.groupBy("hour").agg(F.count(F.lit(1)).alias("n_peaks")).orderBy("hour")
    return p.groupBy("hour").agg(F.sum("peak_consumption").alias("peak_consumption")).orderBy("hour")


def _hour_cells(mode: str, extra_filter=None) -> list:
    h = F.hour("peak_time")
    cells = []
    for hour in range(HOURS):
        cond = h == hour if extra_filter is None else (h == hour) & extra_filter
        if mode == "count":
            cells.append(F.count(F.when(cond, F.lit(1))))
        else:
            cells.append(F.coalesce(F.sum(F.when(cond, F.col("peak_consumption"))), F.lit(0.0)))
    return cells


def peak_heatmap(df: DataFrame, mode: str = "count") -> DataFrame:
    """Month x hour grid of peak counts or summed kWh (0 where no peak):
    ``month, hour, value`` for every month present and all 24 hours."""
    _check_mode(mode)
    p = peaks_long(df).withColumn("month", F.month("peak_time").cast("int"))
    wide = p.groupBy("month").agg(F.array(*_hour_cells(mode)).alias("_cells"))
    return wide.select("month", F.posexplode("_cells").alias("hour", "value")) \
        .withColumn("hour", F.col("hour").cast("int"))


def tariff_peak_heatmap(df: DataFrame, mode: str = "count") -> DataFrame:
    """Before (``tariff_active`` = 0) and after (= 1) heatmaps on one month x
    hour axis (months present in either, all 24 hours, 0-filled) and their
    difference: ``month, hour, before, after, diff``."""
    _check_mode(mode)
    p = peaks_long(df).withColumn("month", F.month("peak_time").cast("int"))
    act = F.col(S.ACTIVE)
    wide = p.groupBy("month").agg(
        F.array(*_hour_cells(mode, act == 0)).alias("_b"),
        F.array(*_hour_cells(mode, act == 1)).alias("_a"))
    out = wide.select("month", F.posexplode(F.arrays_zip("_b", "_a")).alias("hour", "_c"))
    return out.select("month", F.col("hour").cast("int").alias("hour"),
                      F.col("_c._b").alias("before"), F.col("_c._a").alias("after"),
                      (F.col("_c._a") - F.col("_c._b")).alias("diff"))


def tariff_peak_max(heat: DataFrame) -> DataFrame:
    """Shared colour-scale maximum over the before and after grids."""
    return heat.agg(F.max(F.greatest("before", "after")).alias("vmax"))


def peak_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width histogram of every non-missing peak value over
    [min, max] (the last bin is closed; min == max widens the range by 0.5
    each side), bin assignment checked against the computed edges so values
    on an edge fall in the upper bin. ``bin, bin_start, bin_end, n`` for all
    ``bins`` bins. The range is one aggregate brought back as two numbers."""
    vals = df.select(F.explode(F.array(*[F.col(f"peak{i}_consumption") for i in (1, 2, 3)])).alias("v")) \
        .where(F.col("v").isNotNull())
    mn, mx = vals.agg(F.min("v"), F.max("v")).first()
    spark = df.sparkSession
    if mn is None:
        return spark.createDataFrame([], "bin int, bin_start double, bin_end double, n bigint")
    lo, hi = (mn - 0.5, mx + 0.5) if mn == mx else (mn, mx)
    step = (hi - lo) / float(bins)

    def edge(i):
        return F.when(i >= bins, F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))

    idx0 = F.floor((F.col("v") - F.lit(lo)) * F.lit(float(bins) / (hi - lo)))
    b = vals.withColumn("_i", F.when(idx0 >= bins, F.lit(bins - 1)).otherwise(idx0))
    b = b.withColumn("_i", F.when(F.col("v") < edge(F.col("_i")), F.col("_i") - 1).otherwise(F.col("_i")))
    b = b.withColumn("_i", F.when((F.col("v") >= edge(F.col("_i") + 1)) & (F.col("_i") != bins - 1),
                                  F.col("_i") + 1).otherwise(F.col("_i")))
    counts = b.groupBy(F.col("_i").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    axis = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return axis.join(counts, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def peak_rank_box(df: DataFrame) -> DataFrame:
    """Box statistics per peak rank 1..3: quartiles (linear), 1.5 x IQR
    whiskers at the most extreme values inside the fences, outlier count.

    Quartiles over all households use the distributed exact quantile (the
    three rank groups grow with the table)."""
    # Read three times (size check, quantiles, fences): materialise once.
    p = materialize(peaks_long(df).select("rank", F.col("peak_consumption").alias("v")))
    q = exact_quantiles(p, "v", [0.25, 0.5, 0.75], by=["rank"])
    qw = q.groupBy("rank").agg(
        *[F.max(F.when(F.col("q_index") == i, F.col("quantile"))).alias(n)
          for i, n in enumerate(("q1", "median", "q3"))])
    qw = qw.withColumn("iqr", F.col("q3") - F.col("q1")) \
        .withColumn("_lf", F.col("q1") - 1.5 * F.col("iqr")) \
        .withColumn("_uf", F.col("q3") + 1.5 * F.col("iqr"))
    j = p.join(F.broadcast(qw), "rank")  # at most three rows
    inside = (F.col("v") >= F.col("_lf")) & (F.col("v") <= F.col("_uf"))
    stats = j.groupBy("rank").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count(F.when(~inside, F.lit(1))).alias("n_outliers"))
    return qw.join(stats, "rank").select(
        F.col("rank").cast("int").alias("rank"), "n", "q1", "median", "q3", "iqr",
        "whisker_low", "whisker_high", "n_outliers")
