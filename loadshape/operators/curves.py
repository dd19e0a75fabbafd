"""Period curves, adoption share by usage group and the event study."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadshape import schemas as S
from loadshape.functions.calendar import ALL, event_time
from loadshape.functions.stats import SINGLE_TASK_MAX, grouped_quantiles
from loadshape.operators.usage import GROUP, GROUP_ORDER

_AGGS = {
    "mean": F.avg, "sum": F.sum, "median": F.median, "max": F.max, "min": F.min,
    "std": F.stddev_samp, "var": F.var_samp, "count": F.count,
}


def _fn(agg: str):
    try:
        return _AGGS[agg]
    except KeyError:
        raise ValueError(f"unsupported agg: {agg}") from None


def _is(cols: Sequence[str], values: Sequence) -> Column:
    """The row has these values in these columns (compared one by one, so
    values that hold the label's separator never meet)."""
    out = F.lit(True)
    for c, v in zip(cols, values):
        out = out & (F.col(c).cast("string") == F.lit(str(v)))
    return out


def consumption_curve(df: DataFrame, value_col: str, agg: str = "mean",
                      splits: Sequence[str] | None = None,
                      split_values: Sequence[Sequence] | None = None,
                      price: str | None = None, period_col: str = S.TS,
                      single_task_max: int | None = None) -> DataFrame:
    """Aggregate ``value_col`` by period (and ``splits``).

    Without splits: ``period, <value_col>``. With splits the split keys are
    unstacked into one column per combination named ``v1_v2`` when
    ``split_values`` lists the values of every split column; without it the
    result is long: ``period, <splits>, <value_col>``, rows with a missing
    split value left out.
    When ``price`` is a split, its 'all' rows are dropped first. ``price``
    filters the input to one price part (None keeps them mixed).

    A median holds a period's values in one task up to ``single_task_max`` of
    them; larger periods are selected by bit prefixes.
    """
    fn = _fn(agg)
    if single_task_max is None:
        single_task_max = SINGLE_TASK_MAX
    if price is not None:
        df = df.where(F.col(S.PRICE) == price)
    def median(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
        return grouped_quantiles(frame, keys, value_col, [0.5], single_task_max)

    if not splits:
        if agg == "median":
            return median(df, [period_col]).withColumnRenamed("_q0", value_col)
        return df.groupBy(period_col).agg(fn(value_col).alias(value_col))
    if S.PRICE in splits:
        df = df.where(F.col(S.PRICE) != ALL)
    if split_values is None:
        if agg == "median":
            return median(df.dropna(subset=list(splits)), [period_col, *splits]).withColumnRenamed("_q0", value_col)
        return df.dropna(subset=list(splits)).groupBy(period_col, *splits).agg(fn(value_col).alias(value_col))
    if len(split_values) != len(splits):
        raise ValueError("split_values must list the values of every split column")
    combos = [[]]
    for vals in split_values:
        combos = [c + [v] for c in combos for v in vals]
    if agg == "median":
        which = F.coalesce(*[F.when(_is(splits, c), F.lit(i)) for i, c in enumerate(combos)])
        by_line = median(df.withColumn("_line", which), [period_col, "_line"])
        return by_line.groupBy(period_col).agg(
            *[F.max(F.when(F.col("_line") == i, F.col("_q0"))).alias("_".join(str(v) for v in c)) for i, c in enumerate(combos)])
    return df.groupBy(period_col).agg(
        *[fn(F.when(_is(splits, c), F.col(value_col))).alias("_".join(str(v) for v in c)) for c in combos])


def adoption_by_usage(df: DataFrame, per_household: bool = False) -> DataFrame:
    """Mean of ``tariff_active`` per usage group, always the three groups in
    order low, medium, high (absent group -> NULL share). By default this
    averages rows of the given table, as the study does; ``per_household``
    first reduces to one row per household (active in any row)."""
    if per_household:
        df = df.groupBy(S.ID, GROUP).agg(F.max(S.ACTIVE).alias(S.ACTIVE))
    one = df.agg(*[F.avg(F.when(F.col(GROUP) == g, F.col(S.ACTIVE).cast("double"))).alias(g)
                   for g in GROUP_ORDER])
    pairs = ", ".join(f"'{g}', `{g}`" for g in GROUP_ORDER)
    return one.selectExpr(f"stack({len(GROUP_ORDER)}, {pairs}) AS ({GROUP}, share)")


def event_study(df: DataFrame, value_col: str = "mean_consumption",
                line_cols: str | Sequence[str] = GROUP, window: int = 6,
                line_values: Sequence | None = None,
                period_col: str = S.TS, adoption_col: str = S.START) -> DataFrame:
    """Mean ``value_col`` by months relative to adoption, adopters only,
    ``-window <= event_time <= window``.

    Long form ``event_time, <line columns>, mean_value`` by default, rows with
    a missing line value left out. With ``line_values`` (values, or tuples of
    one value per line column) one column per line, named ``v1_v2``.
    """
    cols = [line_cols] if isinstance(line_cols, str) else list(line_cols)
    data = df.where(F.col(adoption_col).isNotNull()).withColumn(
        "event_time", event_time(F.col(period_col), F.col(adoption_col)))
    data = data.where(F.col("event_time").between(-window, window)).dropna(subset=cols)
    if line_values is None:
        return data.groupBy("event_time", *cols).agg(F.avg(value_col).alias("mean_value"))
    lines = [v if isinstance(v, (list, tuple)) else (v,) for v in line_values]
    return data.groupBy("event_time").agg(
        *[F.avg(F.when(_is(cols, v), F.col(value_col))).alias("_".join(str(x) for x in v)) for v in lines])
