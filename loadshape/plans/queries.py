"""Registered queries: each takes ``(spark, sf_dir)`` and returns a lazy
DataFrame over the driver's test tables (whole tables, stand-in mapping of
``loadshape.sources.driver_views``). Computed doubles are canonicalised to
9 significant digits for the oracle comparison (same rule as the DuckDB
side, see ``loadshape.plans.oracle``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadshape import schemas as S
from loadshape.functions.holidays import holiday_calendar, holiday_name
from loadshape.functions.stats import selected_quantiles
from loadshape.operators import aggregate as A
from loadshape.operators import adoption as AD
from loadshape.operators import balance as BL
from loadshape.operators import curves as CV
from loadshape.operators import matching as MT
from loadshape.operators import peaks as PK
from loadshape.operators import profiles as PR
from loadshape.operators.tariff import join_tariff, normalize_tariff, tariff_info
from loadshape.operators.usage import usage_groups
from loadshape.plans.pipeline import enrich, run
from loadshape.sources import driver_views as dv
from loadshape.session import materialize, shared_path
from loadshape.sources.files import (dataset_profile, scan_aggregate, scan_meter, scan_tariff_csv,
                                     write_aggregate, write_parquet)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SIG_DIGITS = 9
# Rounding boundary offset: values are floored after adding this, so the cut
# falls at fraction 0.6817 rather than at exact halves, where means and
# variances of 2-decimal readings often land.
ROUND_OFFSET = 0.3183


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def canon(c: F.Column) -> F.Column:
    """``c`` to 9 significant digits using only exact operations (powers of
    ten are exact, IEEE multiply/divide/floor are identical in both
    engines), so Spark and DuckDB give bit-identical doubles."""
    k = F.least(F.lit(SIG_DIGITS - 1) - F.floor(F.log10(F.abs(c))), F.lit(15))
    up = F.floor(c * F.pow(F.lit(10.0), k) + ROUND_OFFSET) / F.pow(F.lit(10.0), k)
    down = F.floor(c / F.pow(F.lit(10.0), -k) + ROUND_OFFSET) * F.pow(F.lit(10.0), -k)
    return (F.when(c.isNull(), F.lit(None).cast("double"))
            .when(c == 0, F.lit(0.0))
            .when(k >= 0, up.cast("double")).otherwise(down.cast("double")))


def rounded(df: DataFrame) -> DataFrame:
    """Canonicalise every double column (see :func:`canon`)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append(canon(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ------------------------------------------------------------ inputs
def meter_l(spark: SparkSession, sf: str) -> DataFrame:
    return dv.lineitem_meter(spark, sf)


def tariff_l(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_tariff(dv.lineitem_tariff_raw(spark, sf))


def meter_e(spark: SparkSession, sf: str) -> DataFrame:
    return dv.events_meter(spark, sf)


def tariff_e(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_tariff(dv.events_tariff_raw(spark, sf))


def monthly_l(spark: SparkSession, sf: str) -> DataFrame:
    """The notebook's monthly aggregate on the multi-year stand-in."""
    return run(meter_l(spark, sf), tariff_l(spark, sf), "month",
               ["top3_mean", "variance", "mean"], True, [0.25, 0.75])


def monthly_peaks_l(spark: SparkSession, sf: str) -> DataFrame:
    """The part of the monthly aggregate that profiles and matching read
    (top-3 mean per household-month, price part and tariff status); lazy,
    so Catalyst prunes everything else."""
    return run(meter_l(spark, sf), tariff_l(spark, sf), "month", ["top3_mean"], True)


def monthly_e(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly top-3 aggregate on the hourly stand-in (peak-hour tables)."""
    return run(meter_e(spark, sf), tariff_e(spark, sf), "month",
               ["top3_mean", "mean"], True, [0.25, 0.75])


def _agg(spark, sf, src, freq, methods, use_price=True, holidays=False, strategy="auto"):
    meter, tariff = (meter_l, tariff_l) if src == "l" else (meter_e, tariff_e)
    rows = join_tariff(meter(spark, sf), tariff(spark, sf))
    hol = dv.holidays(spark) if holidays else None
    out = A.aggregate(rows, freq, methods, use_price, hol, strategy)
    return rounded(out.withColumnRenamed(S.PERIOD, S.TS))


# ------------------------------------------------------------ scans
@register("scan_meter")
def q_scan_meter(spark, sf):
    """The meter as the study's Parquet file, written to the shared folder and
    read by the reader."""
    path = shared_path(spark, "meter")
    write_parquet(meter_l(spark, sf), path)
    return rounded(scan_meter(spark, path))


@register("scan_tariff")
def q_scan_tariff(spark, sf):
    """The tariff list as the study's CSV file, read by the reader."""
    path = shared_path(spark, "tariff")
    dv.lineitem_tariff_raw(spark, sf).write.option("header", True).csv(path)
    return normalize_tariff(scan_tariff_csv(spark, path))


@register("scan_aggregate")
def q_scan_aggregate(spark, sf):
    """The monthly table written by price, one price read back (one folder)."""
    path = shared_path(spark, "aggregate")
    write_aggregate(monthly_l(spark, sf), path)
    return rounded(scan_aggregate(spark, path).where("price = 'all'").drop("price"))


@register("dataset_profile")
def q_dataset_profile(spark, sf):
    return dataset_profile(meter_l(spark, sf))


@register("enriched_rows")
def q_enriched_rows(spark, sf):
    return rounded(enrich(meter_e(spark, sf), tariff_e(spark, sf), [0.25, 0.75]))


# ------------------------------------------------------------ tariff
@register("tariff_join")
def q_tariff_join(spark, sf):
    return rounded(join_tariff(meter_e(spark, sf), tariff_e(spark, sf)))


@register("tariff_flags")
def q_tariff_flags(spark, sf):
    rows = join_tariff(meter_e(spark, sf), tariff_e(spark, sf))
    return rows.groupBy(S.ID).agg(
        F.max(S.HAS).alias(S.HAS),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(S.ACTIVE).cast("bigint").alias("n_active"),
    )


@register("plan_extract")
def q_plan_extract(spark, sf):
    return tariff_info(tariff_l(spark, sf))


@register("attach_tariff")
def q_attach_tariff(spark, sf):
    return rounded(run(meter_l(spark, sf), tariff_l(spark, sf), "quarter", ["mean"], True))


@register("usage_group")
def q_usage_group(spark, sf):
    return rounded(usage_groups(meter_l(spark, sf), [0.25, 0.75]))


@register("attach_usage_group")
def q_attach_usage_group(spark, sf):
    return rounded(run(meter_l(spark, sf), None, "year", ["sum"], False, [0.25, 0.75]))


# ------------------------------------------------------------ price
@register("price_period")
def q_price_period(spark, sf):
    hl = A.with_price_part(meter_e(spark, sf))
    return rounded(hl.groupBy(F.col("_hl").alias(S.PRICE),
                              F.weekday(S.TS).cast("int").alias("weekday"),
                              F.hour(S.TS).cast("int").alias("hour"))
                   .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(S.VALUE).alias("sum_consumption")))


@register("price_period_holidays")
def q_price_period_holidays(spark, sf):
    hl = A.with_price_part(meter_e(spark, sf), dv.holidays(spark))
    return rounded(hl.groupBy(F.to_date(S.TS).alias("day"), F.col("_hl").alias(S.PRICE))
                   .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(S.VALUE).alias("sum_consumption")))


@register("holiday_calendar")
def q_holiday_calendar(spark, sf):
    """The holidays of every year that either stand-in meter has readings in."""
    years = meter_l(spark, sf).select(S.TS).unionByName(meter_e(spark, sf).select(S.TS))
    first, last = years.agg(F.min(F.year(S.TS)), F.max(F.year(S.TS))).first()
    return holiday_calendar(spark, first, last)


@register("price_period_country")
def q_price_period_country(spark, sf):
    hl = A.with_price_part(meter_e(spark, sf), "SE")
    return rounded(hl.groupBy(F.to_date(S.TS).alias("day"), F.col("_hl").alias(S.PRICE))
                   .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(S.VALUE).alias("sum_consumption")))


@register("consumption_on_holidays")
def q_consumption_on_holidays(spark, sf):
    day = F.to_date(S.TS)
    return rounded(meter_l(spark, sf).select(F.year(day).cast("int").alias("year"), holiday_name(day).alias("holiday"), S.VALUE)
                   .where(F.col("holiday").isNotNull()).groupBy("year", "holiday")
                   .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(S.VALUE).alias("sum_consumption")))


@register("price_mode")
def q_price_mode(spark, sf):
    p = A.price_mode(meter_e(spark, sf), True)
    return rounded(p.groupBy(S.PRICE).agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.sum(S.VALUE).alias("sum_consumption")))


@register("agg_price_grouping_sets")
def q_agg_price_grouping_sets(spark, sf):
    return _agg(spark, sf, "e", "week", ["sum", "median"], strategy="grouping_sets")


# ------------------------------------------------------------ periods
for _freq, _src in (("day", "l"), ("week", "l"), ("month", "l"), ("quarter", "l"), ("year", "l"),
                    ("hour", "e"), ("weekday", "e"), ("week_part", "e")):
    def _mk(freq=_freq, src=_src):
        return lambda spark, sf: _agg(spark, sf, src, freq, ["sum", "mean", "max"])
    register(f"period_{_freq}")(_mk())


# ------------------------------------------------------------ methods
for _m in ("sum", "mean", "variance", "median", "max", "q90"):
    def _mk_m(m=_m):
        return lambda spark, sf: _agg(spark, sf, "e", "week", [m])
    register(f"agg_{_m}")(_mk_m())


@register("agg_top3_mean")
def q_agg_top3_mean(spark, sf):
    return _agg(spark, sf, "l", "month", ["top3_mean"])


@register("agg_multi")
def q_agg_multi(spark, sf):
    return _agg(spark, sf, "l", "month", ["top3_mean", "variance", "mean"])


@register("monthly_aggregate")
def q_monthly_aggregate(spark, sf):
    return rounded(monthly_l(spark, sf))


@register("daily_peak")
def q_daily_peak(spark, sf):
    rows = join_tariff(meter_e(spark, sf), tariff_e(spark, sf))
    d = A.daily_peaks(rows, "week", True)
    return rounded(d.withColumnRenamed(S.PERIOD, S.TS))


@register("top3_days")
def q_top3_days(spark, sf):
    rows = join_tariff(meter_e(spark, sf), tariff_e(spark, sf))
    d = A.top3_days(A.daily_peaks(rows, "week", True))
    return rounded(d.withColumnRenamed(S.PERIOD, S.TS))


# ------------------------------------------------------------ adoption


@register("monthly_adoption")
def q_monthly_adoption(spark, sf):
    return AD.monthly_adoption(tariff_l(spark, sf))


@register("adoption_share")
def q_adoption_share(spark, sf):
    households = meter_l(spark, sf).agg(F.countDistinct(S.ID).alias("total_households"))
    return rounded(AD.adoption_share(tariff_l(spark, sf), households))


@register("plan_counts")
def q_plan_counts(spark, sf):
    return AD.plan_counts(tariff_l(spark, sf))


@register("plan_cumulative")
def q_plan_cumulative(spark, sf):
    return AD.plan_cumulative(tariff_l(spark, sf))


@register("rows_by_active")
def q_rows_by_active(spark, sf):
    hour_result = run(meter_e(spark, sf), tariff_e(spark, sf), "hour", ["mean"], True, [0.25, 0.75])
    return AD.rows_by_active(hour_result)


@register("distinct_adopters")
def q_distinct_adopters(spark, sf):
    return AD.distinct_adopters(monthly_peaks_l(spark, sf).where(F.col(S.PRICE) == "all"))


@register("filter_price")
def q_filter_price(spark, sf):
    return rounded(monthly_e(spark, sf).where(F.col(S.PRICE) == "high"))


@register("adopters_only")
def q_adopters_only(spark, sf):
    return rounded(monthly_l(spark, sf).where(F.col(S.START).isNotNull()))


# ------------------------------------------------------------ curves
@register("consumption_curve")
def q_consumption_curve(spark, sf):
    return rounded(CV.consumption_curve(monthly_peaks_l(spark, sf), "top3_mean_consumption", price="all"))


@register("consumption_curve_median")
def q_consumption_curve_median(spark, sf):
    return rounded(CV.consumption_curve(
        monthly_peaks_l(spark, sf), "top3_mean_consumption", "median", splits=[S.PRICE, S.ACTIVE],
        split_values=[["high", "low"], [0, 1]]))


@register("reading_quantiles")
def q_reading_quantiles(spark, sf):
    """Quantiles of all readings of a year, selected without a sort."""
    rows = meter_l(spark, sf).select(F.year(S.TS).cast("int").alias("year"), S.VALUE)
    q = selected_quantiles(rows, ["year"], S.VALUE, [0.05, 0.5, 0.95])
    return rounded(q.toDF("year", "q05", "median", "q95"))


@register("consumption_by_price_tariff")
def q_consumption_by_price_tariff(spark, sf):
    return rounded(CV.consumption_curve(
        monthly_peaks_l(spark, sf), "top3_mean_consumption", splits=[S.PRICE, S.ACTIVE],
        split_values=[["high", "low"], [0, 1]]))


@register("consumption_by_usage_tariff")
def q_consumption_by_usage_tariff(spark, sf):
    return rounded(CV.consumption_curve(
        monthly_l(spark, sf), "top3_mean_consumption", splits=["usage_group", S.ACTIVE],
        split_values=[["low", "medium", "high"], [0, 1]], price="all"))


@register("consumption_by_usage")
def q_consumption_by_usage(spark, sf):
    return rounded(CV.consumption_curve(
        monthly_l(spark, sf), "top3_mean_consumption", splits=["usage_group"],
        split_values=[["low", "medium", "high"]], price="all"))


@register("adoption_by_usage")
def q_adoption_by_usage(spark, sf):
    return rounded(CV.adoption_by_usage(monthly_l(spark, sf)))


@register("event_study")
def q_event_study(spark, sf):
    return rounded(CV.event_study(monthly_l(spark, sf), "top3_mean_consumption", "usage_group", 12,
                                  line_values=["low", "medium", "high"]))


@register("event_study_by_plan")
def q_event_study_by_plan(spark, sf):
    return rounded(CV.event_study(monthly_peaks_l(spark, sf), "top3_mean_consumption", "tariff_plan", 12))


# ------------------------------------------------------------ peaks


def high_peaks(spark, sf, price="high"):
    """Monthly top-3 of the hourly stand-in, rows of one price part (the
    study's main call takes the high price). The peak tables read only the
    peak columns, tariff status and price, so the aggregate is built lazily
    with just the top-3 method and Catalyst prunes the rest."""
    agg = run(meter_e(spark, sf), tariff_e(spark, sf), "month", ["top3_mean"], True)
    return agg.where(F.col(S.PRICE) == price)


@register("peaks_long")
def q_peaks_long(spark, sf):
    return rounded(PK.peaks_long(high_peaks(spark, sf)))


@register("peak_hour_count")
def q_peak_hour_count(spark, sf):
    return PK.peak_hour_distribution(high_peaks(spark, sf), "count")


@register("peak_hour_consumption")
def q_peak_hour_consumption(spark, sf):
    return rounded(PK.peak_hour_distribution(high_peaks(spark, sf), "consumption"))


@register("peak_heatmap_count")
def q_peak_heatmap_count(spark, sf):
    return PK.peak_heatmap(high_peaks(spark, sf), "count")


@register("peak_hour_count_all")
def q_peak_hour_count_all(spark, sf):
    return PK.peak_hour_distribution(high_peaks(spark, sf, "all"), "count")


@register("peak_hour_count_low")
def q_peak_hour_count_low(spark, sf):
    return PK.peak_hour_distribution(high_peaks(spark, sf, "low"), "count")


@register("peak_heatmap_consumption")
def q_peak_heatmap_consumption(spark, sf):
    return rounded(PK.peak_heatmap(high_peaks(spark, sf), "consumption"))


@register("peak_histogram")
def q_peak_histogram(spark, sf):
    return rounded(PK.peak_histogram(high_peaks(spark, sf)))


@register("peak_rank_box")
def q_peak_rank_box(spark, sf):
    return rounded(PK.peak_rank_box(high_peaks(spark, sf)))


@register("tariff_peak_heatmap_count")
def q_tariff_peak_heatmap_count(spark, sf):
    return PK.tariff_peak_heatmap(high_peaks(spark, sf), "count")


@register("tariff_peak_heatmap_consumption")
def q_tariff_peak_heatmap_consumption(spark, sf):
    return rounded(PK.tariff_peak_heatmap(high_peaks(spark, sf), "consumption"))


@register("tariff_peak_max")
def q_tariff_peak_max(spark, sf):
    return PK.tariff_peak_max(PK.tariff_peak_heatmap(high_peaks(spark, sf), "count"))


# ------------------------------------------------------------ matching

LOOKBACK = 12
K = 5


@register("lookback_window")
def q_lookback_window(spark, sf):
    rows = materialize(PR.clean(monthly_peaks_l(spark, sf)))
    win = PR.window_rows(rows, PR.adoption_months(rows), LOOKBACK)
    return win.groupBy(F.col("Ti").alias("adoption_month"), "id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("month").alias("first_month"),
        F.max("month").alias("last_month"))


@register("risk_set")
def q_risk_set(spark, sf):
    return MT.risk_set(materialize(PR.clean(monthly_peaks_l(spark, sf))))


@register("profile_timeseries")
def q_profile_timeseries(spark, sf):
    return rounded(PR.build_profiles(monthly_peaks_l(spark, sf), feature_mode="time_series"))


@register("profile_summary")
def q_profile_summary(spark, sf):
    return rounded(PR.build_profiles(monthly_peaks_l(spark, sf), feature_mode="summary"))


@register("knn_match")
def q_knn_match(spark, sf):
    return rounded(MT.knn_match(monthly_peaks_l(spark, sf), LOOKBACK, K, "time_series"))


@register("match_timeseries")
def q_match_timeseries(spark, sf):
    return rounded(MT.risk_set_matching(monthly_peaks_l(spark, sf), lookback_months=LOOKBACK,
                                        k_neighbors=K, feature_mode="time_series"))


@register("match_summary")
def q_match_summary(spark, sf):
    return rounded(MT.risk_set_matching(monthly_peaks_l(spark, sf), lookback_months=LOOKBACK,
                                        k_neighbors=K, feature_mode="summary"))


def _balance(spark, sf, mode):
    agg = materialize(monthly_peaks_l(spark, sf))
    matches = MT.risk_set_matching(agg, lookback_months=LOOKBACK, k_neighbors=K, feature_mode=mode)
    profiles = PR.build_profiles(agg, feature_mode=mode)
    return BL.balance_table(profiles, matches)


@register("balance_timeseries")
def q_balance_timeseries(spark, sf):
    return rounded(_balance(spark, sf, "time_series"))


@register("balance_summary")
def q_balance_summary(spark, sf):
    return rounded(_balance(spark, sf, "summary"))


@register("love_table")
def q_love_table(spark, sf):
    return rounded(BL.love_table(_balance(spark, sf, "time_series")))
