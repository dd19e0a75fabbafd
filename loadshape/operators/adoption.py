"""Tariff-adoption tables: monthly adoptions, cumulative share, plan counts,
cumulative adoption per plan, row counts by tariff status.

All month axes are densified from the data's own min..max month with
``sequence`` on a one-row aggregate, so no month list is hard-coded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadshape import schemas as S
from loadshape.functions.calendar import month_label
from loadshape.functions.text import PLAN_PATTERN, plan_token


def _month(col: str = S.START) -> F.Column:
    return F.trunc(F.to_date(F.col(col)), "month")


def monthly_adoption(tariff: DataFrame) -> DataFrame:
    """Distinct households per start month, by month: ``month`` (yyyy-MM), ``households``.
    No gap filling (months without adoptions are absent)."""
    return (tariff.where(F.col(S.START).isNotNull())
            .groupBy(_month().alias("_m")).agg(F.countDistinct(S.ID).alias("households"))
            .select(month_label("_m").alias("month"), "households").orderBy("month"))


def _month_axis(months: DataFrame, col: str = "month") -> DataFrame:
    """Every month from the minimum to the maximum of ``col`` (one-row
    aggregate exploded with ``sequence``; bounded by the months spanned)."""
    bounds = months.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    return bounds.select(F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias(col))


def adoption_share(tariff: DataFrame, total_households) -> DataFrame:
    """Cumulative adoption share per month, gap-filled with 0.

    ``total_households`` is a number or a one-row DataFrame with a single
    count column (e.g. distinct meter households). Columns: ``month`` (date),
    ``households``, ``cumulative``, ``share``.
    """
    counts = (tariff.where(F.col(S.START).isNotNull())
              .groupBy(_month().alias("month")).agg(F.countDistinct(S.ID).alias("households")))
    axis = _month_axis(counts)
    dense = axis.join(counts, "month", "left").select(
        "month", F.coalesce("households", F.lit(0)).cast("bigint").alias("households"))
    # The axis has one row per month spanned: a window without partitioning is bounded.
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dense = dense.withColumn("cumulative", F.sum("households").over(w))
    if isinstance(total_households, DataFrame):  # one-row count: bring back the number
        total_households = total_households.first()[0]
    total = F.lit(None if total_households is None else float(total_households)).cast("double")
    return dense.select("month", "households", "cumulative",
                        F.try_divide(F.col("cumulative").cast("double"), total).alias("share"))


def plan_counts(tariff: DataFrame, plan_col: str = S.PLAN) -> DataFrame:
    """Rows per full plan name, nulls dropped, most frequent first."""
    return (tariff.where(F.col(plan_col).isNotNull())
            .groupBy(F.col(plan_col).alias("tariff_group")).agg(F.count(F.lit(1)).alias("households"))
            .orderBy(F.col("households").desc(), "tariff_group"))


def plan_cumulative(tariff: DataFrame, pattern: str = PLAN_PATTERN) -> DataFrame:
    """Cumulative distinct adopters per plan token and month (long form).

    Rows whose plan has no token are dropped. The month axis spans the
    min..max start month over all plans; each plan gets every month (0 when
    nobody adopted). Columns: ``month``, ``tariff_plan``, ``households``,
    ``cumulative``.
    """
    t = (tariff.select(S.ID, _month().alias("month"), plan_token(S.PLAN, pattern).alias(S.PLAN))
         .where(F.col(S.PLAN).isNotNull() & F.col("month").isNotNull()))
    counts = t.groupBy("month", S.PLAN).agg(F.countDistinct(S.ID).alias("households"))
    lo, hi = counts.agg(F.min("month"), F.max("month")).first()
    if lo is None:
        return tariff.sparkSession.createDataFrame(
            [], "month date, tariff_plan string, households bigint, cumulative bigint")
    plans = counts.select(S.PLAN).distinct()
    grid = plans.select(S.PLAN, F.explode(F.sequence(F.lit(lo), F.lit(hi),
                                                     F.expr("INTERVAL 1 MONTH"))).alias("month"))
    dense = grid.join(counts, ["month", S.PLAN], "left").select(
        "month", S.PLAN, F.coalesce("households", F.lit(0)).cast("bigint").alias("households"))
    w = Window.partitionBy(S.PLAN).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumn("cumulative", F.sum("households").over(w))


def rows_by_active(result: DataFrame) -> DataFrame:
    """Row counts of an aggregate by ``tariff_active``."""
    return result.groupBy(S.ACTIVE).agg(F.count(F.lit(1)).alias("n_rows"))


def distinct_adopters(result: DataFrame, id_col: str = S.ID, adoption_col: str = S.START) -> DataFrame:
    """Distinct (household, adoption month) pairs of an aggregate."""
    return (result.where(F.col(adoption_col).isNotNull())
            .select(F.col(id_col).alias("id"), F.to_date(adoption_col).alias("adoption_month"))
            .distinct())
