"""Household usage groups from total consumption over the whole data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadshape import schemas as S
from loadshape.functions.stats import exact_quantiles

TOTAL = "total_consumption"
GROUP = "usage_group"
# Usage-group labels in their natural order.
GROUP_ORDER = ("low", "medium", "high")


def household_totals(rows: DataFrame) -> DataFrame:
    """Total kWh per household; a household with only missing readings totals 0."""
    return rows.groupBy(S.ID).agg(F.coalesce(F.sum(S.VALUE), F.lit(0.0)).alias(TOTAL))


def usage_thresholds(totals: DataFrame, probs: Sequence[float]) -> DataFrame:
    """One row ``q1, q2``: exact linear quantiles of the household totals."""
    if len(probs) != 2:
        raise ValueError("usage groups need exactly two quantiles, e.g. [0.25, 0.75]")
    q = exact_quantiles(totals, TOTAL, probs)
    return q.agg(
        F.max(F.when(F.col("q_index") == 0, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("q_index") == 1, F.col("quantile"))).alias("q2"),
    )


def usage_label(total: F.Column, q1: F.Column, q2: F.Column) -> F.Column:
    """Right-closed bins (-inf,q1] low, (q1,q2] medium, (q2,inf) high;
    when q2 <= q1 only low / high remain."""
    return (F.when(total <= q1, F.lit("low"))
            .when((q2 > q1) & (total <= q2), F.lit("medium"))
            .otherwise(F.lit("high")))


def usage_groups(rows: DataFrame, probs: Sequence[float] = (0.25, 0.75)) -> DataFrame:
    """``aID, total_consumption, usage_group`` for every household in ``rows``."""
    return usage_from_totals(household_totals(rows), probs)


def usage_from_totals(totals: DataFrame, probs: Sequence[float] = (0.25, 0.75)) -> DataFrame:
    """Usage groups from a ``aID, total_consumption`` table.

    The two thresholds are computed (exactly, distributed) and brought back
    as two numbers, then applied as literals."""
    th = usage_thresholds(totals, probs).first()
    q1, q2 = (th["q1"], th["q2"]) if th is not None else (None, None)
    return totals.select(
        S.ID, TOTAL,
        usage_label(F.col(TOTAL), F.lit(q1).cast("double"), F.lit(q2).cast("double")).alias(GROUP))


def attach_usage_group(result: DataFrame, usage: DataFrame | None) -> DataFrame:
    """Aggregate LEFT JOIN usage groups on ``aID`` (sized by households: shuffle
    join unless AQE sees it small)."""
    if usage is None:
        return result
    return result.join(usage, S.ID, "left")
