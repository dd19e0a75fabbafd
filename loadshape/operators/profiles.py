"""Pre-adoption profiles: the look-back window of each household before an
adoption month, as a time series (first L rows) or as summary statistics.

A household's rows come together once, in one shuffle: its months in order, its
adoption months and whether it never adopts. Each adoption month ``Ti`` is then a
slice of that vector (``month in [Ti - L months, Ti)``), so nothing is joined or
shuffled per adoption month. The aggregate has at most two rows per household
and month (before and after the adoption), so a vector is bounded by the months
of the calendar.

``window_rows`` gives the rows of the windows themselves, as an equi-join: every
``Ti`` is expanded to the L+1 calendar months its window can touch (``|Ti| x
(L+1)`` rows, bounded by the months in the data, broadcast), joined on the
reading's month, with the exact range as a residual predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadshape import schemas as S

FEATURE_MODES = ("time_series", "summary")
SUMMARY_FEATURES = ("peak_mean", "peak_sd", "peak_volatility")


def check_mode(feature_mode: str) -> None:
    if feature_mode not in FEATURE_MODES:
        raise ValueError("feature_mode must be 'time_series' or 'summary'")


def feature_names(feature_mode: str, lookback_months: int) -> list[str]:
    check_mode(feature_mode)
    if feature_mode == "time_series":
        return [f"peak_{i}" for i in range(1, lookback_months + 1)]
    return list(SUMMARY_FEATURES)


def clean(data: DataFrame, id_col: str = S.ID, month_col: str = S.TS,
          adoption_col: str = S.START, value_col: str = "top3_mean_consumption",
          price_filter: str | None = "all", collapse_months: bool = False) -> DataFrame:
    """``id, month, adoption_month, v, ord`` rows of one price part.

    A mid-month adoption splits that month into two rows (before / after),
    which the study counts as two look-back rows. ``collapse_months=True``
    merges them first: the halves cover disjoint days, so the month's top-3
    mean is the mean of the three largest of the halves' peak values (exact;
    needs the ``peak1..3_consumption`` columns).
    """
    df = data.where(F.col(S.PRICE) == price_filter) if price_filter is not None else data
    order = F.col(S.ACTIVE) if S.ACTIVE in data.columns else F.lit(0)
    rows = df.select(
        F.col(id_col).cast("string").alias("id"),
        F.to_date(F.col(month_col)).alias("month"),
        F.to_date(F.col(adoption_col)).alias("adoption_month"),
        F.col(value_col).cast("double").alias("v"),
        order.cast("int").alias("ord"),
        *([F.array(*[F.col(f"peak{i}_consumption") for i in (1, 2, 3)]).alias("_pk")]
          if collapse_months else []),
    )
    if not collapse_months:
        return rows
    if value_col != "top3_mean_consumption":
        raise ValueError("collapse_months re-aggregates the top-3 mean only")
    # at most two rows per household-month: the collected arrays are bounded
    peaks = F.flatten(F.collect_list("_pk"))
    top = F.slice(F.sort_array(F.filter(peaks, lambda x: x.isNotNull()), asc=False), 1, 3)
    merged = rows.groupBy("id", "month", "adoption_month").agg(top.alias("_top"), F.min("ord").alias("ord"))
    mean = F.when(F.size("_top") > 0,
                  F.aggregate("_top", F.lit(0.0), lambda acc, x: acc + x) / F.size("_top"))
    return merged.select("id", "month", "adoption_month", mean.alias("v"), "ord")


def adopters(rows: DataFrame) -> DataFrame:
    """Distinct (id, adoption_month) of households with an adoption date."""
    return rows.where(F.col("adoption_month").isNotNull()).select("id", "adoption_month").distinct()


def adoption_months(rows: DataFrame) -> DataFrame:
    """Distinct adoption months (bounded by the calendar span of the data)."""
    return rows.where(F.col("adoption_month").isNotNull()).select(
        F.col("adoption_month").alias("Ti")).distinct()


def window_rows(rows: DataFrame, tis: DataFrame, lookback_months: int) -> DataFrame:
    """Rows with ``Ti - L months <= month < Ti`` for every adoption month Ti:
    ``Ti, id, month, ord, v``."""
    keys = tis.select(
        "Ti", F.explode(F.sequence(F.trunc(F.add_months("Ti", -lookback_months), "month"),
                                   F.trunc("Ti", "month"), F.expr("INTERVAL 1 MONTH"))).alias("_mkey"))
    r = rows.select("id", "month", "ord", "v", F.trunc("month", "month").alias("_rkey"))
    j = r.join(F.broadcast(keys), F.col("_rkey") == F.col("_mkey"), "inner")
    return j.where((F.col("month") >= F.add_months("Ti", -lookback_months)) & (F.col("month") < F.col("Ti"))) \
        .select("Ti", "id", "month", "ord", "v")


def month_vectors(rows: DataFrame) -> DataFrame:
    """One row per household: ``id``, ``_rows`` (its rows by month and tariff
    status), ``_own`` (its adoption months), ``_never`` (1 if some row has no
    adoption), ``_latest`` adoption month. Rows without an id are left out."""
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("month", "ord", "v"))).alias("_rows"),
        F.sort_array(F.collect_set("adoption_month")).alias("_own"),
        F.max(F.col("adoption_month").isNull().cast("int")).alias("_never"),
        F.max("adoption_month").alias("_latest"))


def _features(feature_mode: str, lookback_months: int) -> list[Column]:
    if feature_mode == "time_series":
        return [F.get("_window", F.lit(i))["v"].alias(f"peak_{i + 1}") for i in range(lookback_months)]

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    def known(values: Column) -> Column:
        return F.filter(values, lambda x: x.isNotNull())

    v = F.transform("_window", lambda x: x["v"])
    n = F.size(known(v))
    mean = F.when(n > 0, total(known(v)) / n)
    squares = total(F.transform(known(v), lambda x: (x - mean) * (x - mean)))
    steps = known(F.zip_with(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, F.size(v) - 1), lambda x, y: F.abs(x - y)))
    return [mean.alias("peak_mean"), F.when(n > 1, F.sqrt(squares / (n - 1))).alias("peak_sd"),
            F.when(F.size(steps) > 0, total(steps) / F.size(steps)).alias("peak_volatility")]


def profiles_of(vectors: DataFrame, months: Column, feature_mode: str, lookback_months: int, keep: list[str] = []) -> DataFrame:
    """One profile per household of ``month_vectors`` and adoption month Ti of
    the array ``months`` whose window holds at least L rows: ``Ti, id, <keep>,
    <features>``.

    time_series: ``peak_1..peak_L`` = the first L rows by (month, tariff
    status); summary: mean, sample sd and mean absolute successive change of
    all window rows (missing values skipped)."""
    check_mode(feature_mode)
    at = vectors.select("id", *keep, "_rows", F.explode(months).alias("Ti"))
    within = F.filter("_rows", lambda x: (x["month"] >= F.add_months("Ti", -lookback_months)) & (x["month"] < F.col("Ti")))
    return (at.select("Ti", "id", *keep, within.alias("_window")).where(F.size("_window") >= lookback_months)
            .select("Ti", "id", *keep, *_features(feature_mode, lookback_months)))


def build_profiles(data: DataFrame, id_col: str = S.ID, month_col: str = S.TS,
                   adoption_col: str = S.START, lookback_months: int = 12,
                   price_filter: str | None = "all", feature_mode: str = "time_series",
                   value_col: str = "top3_mean_consumption", collapse_months: bool = False) -> DataFrame:
    """Profiles of the adopters at their own adoption month:
    ``id, <features>, adoption_month``."""
    check_mode(feature_mode)
    rows = clean(data, id_col, month_col, adoption_col, value_col, price_filter, collapse_months)
    prof = profiles_of(month_vectors(rows), F.col("_own"), feature_mode, lookback_months)
    feats = feature_names(feature_mode, lookback_months)
    return prof.select("id", *feats, F.col("Ti").alias("adoption_month"))
