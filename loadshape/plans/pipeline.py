"""The aggregation pipeline ``run(...)``: tariff join + flags, usage groups,
period keys, price split, every method in one wide table, then the tariff
info and usage group attached per household. Stateless: every call honours
its own options (no cached object state between runs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadshape import schemas as S
from loadshape.functions.calendar import ALL
from loadshape.operators.aggregate import TOTAL, aggregate
from loadshape.operators.tariff import attach_tariff, join_tariff, normalize_tariff, tariff_side
from loadshape.operators.usage import TOTAL as USAGE_TOTAL
from loadshape.operators.usage import attach_usage_group, usage_from_totals, usage_groups
from loadshape.session import materialize
from loadshape.sources.files import write_aggregate


def _canonical_tariff(tariff: DataFrame | None) -> DataFrame | None:
    if tariff is None:
        return None
    return normalize_tariff(tariff) if "GS1-nr." in tariff.columns else tariff


def enrich(meter: DataFrame, tariff: DataFrame | None = None,
           usage_probs: Sequence[float] | None = None) -> DataFrame:
    """Reading-level table: meter + tariff start/plan + ``has_tariff`` /
    ``tariff_active`` (+ ``total_consumption`` / ``usage_group``)."""
    rows = join_tariff(meter, _canonical_tariff(tariff))
    if usage_probs is not None:
        rows = rows.join(usage_groups(meter, usage_probs), S.ID, "left")
    return rows


def run(meter: DataFrame, tariff: DataFrame | None = None, freq: str = "month",
        agg_method: str | Sequence[str] = "top3_mean", use_price: bool = True,
        add_user_group_col: Sequence[float] | None = None, output_path: str | None = None,
        holidays: DataFrame | str | None = None, strategy: str = "auto") -> DataFrame:
    """Household-period aggregate, period column renamed to ``TIDPUNKT``.

    Output columns: ``aID, TIDPUNKT, price, tariff_active, <method columns>``
    then ``tariff_start, tariff_plan`` (if a tariff is given) and
    ``total_consumption, usage_group`` (if quantiles are given).

    The meter table is scanned once for everything except exact medians /
    quantiles. With usage groups the household-period table is checkpointed
    (to ``spark.checkpoint.dir``) so the totals, their quantiles and the
    final join read it instead of rescanning the readings.
    """
    t = _canonical_tariff(tariff)
    side = tariff_side(t) if t is not None else None
    rows = join_tariff(meter, t, side)
    want_usage = add_user_group_col is not None
    result = aggregate(rows, freq, agg_method, use_price, holidays, strategy, keep_total=want_usage)
    result = result.withColumnRenamed(S.PERIOD, S.TS)
    if want_usage:
        result = materialize(result)
        # 'all' rows partition every reading by (period, tariff status).
        totals = result.where(F.col(S.PRICE) == ALL).groupBy(S.ID).agg(
            F.coalesce(F.sum(TOTAL), F.lit(0.0)).alias(USAGE_TOTAL))
        usage = usage_from_totals(totals, add_user_group_col)
        result = result.drop(TOTAL)
    result = attach_tariff(result, t, side=side)
    if want_usage:
        result = attach_usage_group(result, usage)
    if output_path is not None:
        write_aggregate(result, output_path)
    return result


__all__ = ["run", "enrich", "MeterAggregator"]


class MeterAggregator:
    """Object form of :func:`run` / :func:`enrich` for code written against a
    stateful aggregator: it holds the meter, tariff and holiday tables, and
    every call honours its own options (nothing is cached between calls)."""

    def __init__(self, meter: DataFrame, tariff: DataFrame | None = None,
                 holidays: DataFrame | str | None = None) -> None:
        self.meter = meter
        self.tariff = tariff
        self.holidays = holidays

    def run(self, freq: str = "month", agg_method: str | Sequence[str] = "top3_mean",
            use_price: bool = True, add_user_group_col: Sequence[float] | None = None,
            output_path: str | None = None) -> DataFrame:
        return run(self.meter, self.tariff, freq, agg_method, use_price, add_user_group_col,
                   output_path, self.holidays)

    def get_data(self, add_user_group_col: Sequence[float] | None = None) -> DataFrame:
        """Reading-level table with tariff columns, flags (and usage group)."""
        return enrich(self.meter, self.tariff, add_user_group_col)
