"""Household-period aggregation: the study's central table.

Group key ``G = (aID, period, price, tariff_active)``. Methods: ``sum``
(all-missing -> 0), ``mean``, ``variance`` (n-1), ``max``, ``median`` and
``qNN`` (exact, linear interpolation), and ``top3_mean`` -- per group the
daily maximum reading (earliest on ties), the three largest days (earlier
date on ties), their times and values, and the mean of the peaks present.

Plan shape. One scan reduces the readings to a household-day table
(partial aggregation before the first shuffle, 24 hourly rows -> 1 row per
price part): count, sum, max, M2 (sum of squared deviations) and the day's
peak record per price part, 'all' merged from the parts. Sum, mean, max,
variance (day partials merged exactly with Chan's formula around the group
mean), the top-3 days and the household totals for the usage groups are all
derived from it after a second shuffle on ``G``. Exact ``median`` / ``qNN``
need raw readings (a second scan, only when asked for); ordinary groups
are finalised by ``percentile`` in one task (a group is one meter in one
period), oversized groups are split off and ranked distributed
(:func:`loadshape.functions.stats.grouped_quantiles`). When top-3 is the
only daily method, ranking uses ``row_number() <= 3``, which Catalyst turns
into a map-side ``WindowGroupLimit`` so at most three rows per group and
task cross the second shuffle.

The day's peak (largest reading, earliest time) is the maximum of one fixed-width
number that holds both, so every aggregate over the readings is a hash
aggregate and no reading is sorted.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadshape import schemas as S
from loadshape.functions.bits import bits_of, exponent_guess, exponent_of, from_ordered_bits, power_of_two
from loadshape.functions.calendar import ALL, HIGH, LOW, period_key, price_label
from loadshape.functions.holidays import is_holiday
from loadshape.functions.stats import SINGLE_TASK_MAX, grouped_quantiles
from loadshape.plans.hints import broadcast_if_small

BASIC_METHODS = ("sum", "mean", "variance", "median", "max")
TOP3 = "top3_mean"
GROUP_COLS = (S.ID, S.PERIOD, S.PRICE, S.ACTIVE)
PEAK_COLS = (
    "peak1_consumption", "peak2_consumption", "peak3_consumption",
    "peak1_time", "peak2_time", "peak3_time", "top3_mean_consumption",
)


def normalize_methods(agg_method: str | Sequence[str]) -> list[str]:
    methods = [agg_method] if isinstance(agg_method, str) else list(agg_method)
    if not methods:
        raise ValueError("at least one aggregation method is required")
    for m in methods:
        if m != TOP3:
            method_column(m)  # raises ValueError for unknown / malformed methods
    return methods


def quantile_of(method: str) -> float:
    m = re.fullmatch(r"q(\d+(?:\.\d+)?)", method)
    percent = float(m[1]) if m else -1.0
    if not 0.0 <= percent <= 100.0:
        raise ValueError(f"{method!r} is no quantile: expected q0 to q100")
    return percent / 100.0


def method_column(method: str, value: str | Column = S.VALUE) -> Column:
    """Aggregate expression for one basic / quantile method, aliased
    ``<method>_consumption``."""
    v = F.col(value) if isinstance(value, str) else value
    if method == "sum":
        c = F.coalesce(F.sum(v), F.lit(0.0))
    elif method == "mean":
        c = F.avg(v)
    elif method == "variance":
        c = F.var_samp(v)
    elif method == "median":
        c = F.median(v)
    elif method == "max":
        c = F.max(v)
    elif method.startswith("q"):
        c = F.percentile(v, F.lit(quantile_of(method)))
    else:
        raise ValueError(f"no such method: {method!r}")
    return c.alias(f"{method}_consumption")


def holiday_flagged(rows: DataFrame, holidays: DataFrame | str | None) -> DataFrame:
    """Add boolean ``_holiday``: the reading's date is a holiday of the country
    (a code such as ``'SE'``, computed from the date without any join) or is in
    the holiday table. A table is broadcast after a check of its size."""
    if holidays is None:
        return rows.withColumn("_holiday", F.lit(False))
    if isinstance(holidays, str):
        return rows.withColumn("_holiday", is_holiday(F.to_date(F.col(S.TS)), holidays))
    days = broadcast_if_small(holidays.select(F.col("date").cast("date").alias("_hday")).distinct())
    return rows.join(days, F.to_date(F.col(S.TS)) == F.col("_hday"), "left") \
        .withColumn("_holiday", F.col("_hday").isNotNull()).drop("_hday")


def with_period(rows: DataFrame, freq: str) -> DataFrame:
    return rows.withColumn(S.PERIOD, period_key(S.TS, freq))


def with_price_part(rows: DataFrame, holidays: DataFrame | str | None = None) -> DataFrame:
    """Add ``_hl`` = 'high' / 'low' price part of each reading."""
    flagged = holiday_flagged(rows, holidays)
    return flagged.withColumn("_hl", price_label(S.TS, F.col("_holiday"))).drop("_holiday")


def price_mode(rows: DataFrame, use_price: bool, holidays: DataFrame | str | None = None) -> DataFrame:
    """``use_price=False``: price='all'. ``True``: every reading once as
    'all' and once as its high/low part (a generator in the same stage)."""
    if not use_price:
        return rows.withColumn(S.PRICE, F.lit(ALL))
    hl = with_price_part(rows, holidays)
    return hl.withColumn(S.PRICE, F.explode(F.array(F.lit(ALL), F.col("_hl")))).drop("_hl")


def _ensure_active(rows: DataFrame) -> DataFrame:
    """Readings with an id and a time (grouping drops missing keys, as the
    study's grouping does), with ``tariff_active`` = 0 when absent."""
    rows = rows.where(F.col(S.ID).isNotNull() & F.col(S.TS).isNotNull())
    return rows if S.ACTIVE in rows.columns else rows.withColumn(S.ACTIVE, F.lit(0))


def aggregate_basic(rows: DataFrame, freq: str, methods: Sequence[str], use_price: bool,
                    holidays: DataFrame | str | None = None,
                    strategy: str = "explode",
                    single_task_max: int = SINGLE_TASK_MAX) -> DataFrame:
    """Basic / quantile methods from raw readings, one ``groupBy(G)``.

    ``strategy='explode'``: every reading once as 'all' and once as its
    price part. ``strategy='grouping_sets'`` computes the 'all' rows of the
    other methods as a second grouping set over the high/low rows. Exact
    median / qNN go through :func:`grouped_quantiles` either way, which splits
    off oversized (hot) groups.
    """
    keyed = with_period(_ensure_active(rows), freq)
    if strategy not in ("explode", "grouping_sets"):
        raise ValueError(f"unknown strategy: {strategy}")
    priced = price_mode(keyed, use_price, holidays)
    pct = [(m, 0.5 if m == "median" else quantile_of(m)) for m in methods
           if m == "median" or m.startswith("q")]
    plain = [m for m in methods if m not in dict(pct)]
    parts = []
    if plain and strategy == "grouping_sets" and use_price:
        hl = with_price_part(keyed, holidays)
        g = hl.groupingSets(
            [[S.ID, S.PERIOD, "_hl", S.ACTIVE], [S.ID, S.PERIOD, S.ACTIVE]],
            S.ID, S.PERIOD, "_hl", S.ACTIVE).agg(*[method_column(m) for m in plain])
        parts.append(g.select(S.ID, S.PERIOD, F.coalesce(F.col("_hl"), F.lit(ALL)).alias(S.PRICE),
                              S.ACTIVE, *[f"{m}_consumption" for m in plain]))
    elif plain:
        parts.append(priced.groupBy(*GROUP_COLS).agg(*[method_column(m) for m in plain]))
    if pct:
        q = grouped_quantiles(priced, GROUP_COLS, S.VALUE, [p for _, p in pct], single_task_max)
        parts.append(q.select(*GROUP_COLS, *[F.col(f"_q{i}").alias(f"{m}_consumption")
                                             for i, (m, _) in enumerate(pct)]))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(GROUP_COLS), "inner")
    return out.select(*GROUP_COLS, *[f"{m}_consumption" for m in methods])


# A day's peak is one number: the value's order-preserving bits, then how much
# of the day is left at its time, so the largest number is the largest value at
# its earliest time. It is a fixed-width decimal, which hash aggregates keep in
# place; a struct of both would make Spark sort the readings.
_DAY_MICROS = 86_400_000_000
_SHIFT = 100_000_000_000


def with_peak_key(rows: DataFrame) -> DataFrame:
    """Add ``_key``; in steps, so that each part is computed once a reading."""
    a, guess, e = F.col("_a"), F.col("_g"), F.col("_e")
    start = F.to_date(F.col(S.TS)).cast("timestamp_ntz")
    left = F.lit(_DAY_MICROS) - F.timestamp_diff("MICROSECOND", start, F.col(S.TS))
    rows = rows.withColumn("_a", F.abs(S.VALUE)).withColumn("_g", exponent_guess(a)).withColumn("_p", power_of_two(guess))
    rows = rows.withColumn("_e", exponent_of(a, guess, F.col("_p"))).withColumn("_b", bits_of(F.col(S.VALUE), a, e))
    key = F.col("_b").cast("decimal(20,0)") * F.lit(_SHIFT).cast("decimal(12,0)") + left.cast("decimal(12,0)")
    return rows.withColumn("_key", key.cast("decimal(38,0)")).drop("_a", "_g", "_p", "_e", "_b")


def _peak_value(key: str) -> Column:
    return from_ordered_bits(F.floor(F.col(key) / F.lit(_SHIFT).cast("decimal(12,0)")).cast("long"))


def _peak_time(key: str) -> Column:
    left = F.pmod(F.col(key), F.lit(_SHIFT).cast("decimal(38,0)")).cast("long")
    return F.timestamp_add("MICROSECOND", F.lit(_DAY_MICROS) - left, F.col("day").cast("timestamp_ntz"))


def daily_peaks(rows: DataFrame, freq: str, use_price: bool,
                holidays: DataFrame | str | None = None, keep_empty: bool = False) -> DataFrame:
    """One row per (G, day): the day's maximum reading and its time.

    Columns: ``aID, period, price, tariff_active, day, peak_consumption, peak_time``.
    Days whose readings are all missing have no peak; with ``keep_empty`` they
    are rows with a NULL peak.
    """
    keyed = with_period(_ensure_active(rows), freq).withColumn("day", F.to_date(S.TS))
    keyed = with_peak_key(keyed)
    keys = (S.ID, S.PERIOD, S.ACTIVE, "day")
    if use_price:
        keyed = with_price_part(keyed, holidays)
        high, low = F.col("_hl") == HIGH, F.col("_hl") == LOW
        daily = keyed.groupBy(*keys).agg(
            *[F.max(F.when(c, F.col("_key"))).alias(f"{n}__k") for n, c in ((HIGH, high), (LOW, low))],
            *[F.count(F.when(c, F.lit(1))).alias(f"{n}__n") for n, c in ((HIGH, high), (LOW, low))])
        daily = daily.select("*", F.greatest(f"{HIGH}__k", f"{LOW}__k").alias(f"{ALL}__k"),
                             (F.col(f"{HIGH}__n") + F.col(f"{LOW}__n")).alias(f"{ALL}__n"))
        parts = F.array(*[F.struct(F.lit(n).alias(S.PRICE), F.col(f"{n}__k").alias("_key"), F.col(f"{n}__n").alias("_n"))
                          for n in (ALL, HIGH, LOW)])
        long = daily.select(*keys, F.inline(parts))
    else:
        long = keyed.groupBy(*keys).agg(F.max("_key").alias("_key"), F.count(F.lit(1)).alias("_n")).withColumn(S.PRICE, F.lit(ALL))
    return long.where((F.col("_n") > 0) & (F.lit(keep_empty) | F.col("_key").isNotNull())).select(
        S.ID, S.PERIOD, S.PRICE, S.ACTIVE, "day",
        _peak_value("_key").alias("peak_consumption"), _peak_time("_key").alias("peak_time"))


def top3_days(daily: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` largest daily peaks per group with their rank (1 = largest,
    earlier day first on equal values)."""
    w = Window.partitionBy(*GROUP_COLS).orderBy(F.col("peak_consumption").desc_nulls_last(), F.col("day"))
    return daily.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def aggregate_top3(rows: DataFrame, freq: str, use_price: bool,
                   holidays: DataFrame | str | None = None) -> DataFrame:
    """G + ``peak1..3_consumption, peak1..3_time, top3_mean_consumption``."""
    top = top3_days(daily_peaks(rows, freq, use_price, holidays, keep_empty=True))
    r, v, t = F.col("rank"), F.col("peak_consumption"), F.col("peak_time")
    return top.groupBy(*GROUP_COLS).agg(
        *[F.max(F.when(r == i, v)).alias(f"peak{i}_consumption") for i in (1, 2, 3)],
        *[F.max(F.when(r == i, t)).alias(f"peak{i}_time") for i in (1, 2, 3)],
        F.avg(v).alias("top3_mean_consumption"),
    )


MERGEABLE = ("sum", "mean", "max", "variance")
TOTAL = "_total"
_STATS = ("rows", "n", "s", "mx", "m2", "pk")


def _part_aggs(name: str, cond: Column | None) -> list[Column]:
    v = F.col(S.VALUE)

    def only(e):
        return e if cond is None else F.when(cond, e)
    return [
        F.count(only(F.lit(1))).alias(f"{name}__rows"),
        F.count(only(v)).alias(f"{name}__n"),
        F.sum(only(v)).alias(f"{name}__s"),
        F.max(only(v)).alias(f"{name}__mx"),
        (F.var_pop(only(v)) * F.count(only(v))).alias(f"{name}__m2"),
        F.max(only(F.col("_key"))).alias(f"{name}__pk"),
    ]


def _merged_all() -> list[Column]:
    """'all' day partials merged from the high and low parts (exact merges;
    M2 by Chan's pairwise formula), so the aggregate computes only the two
    parts."""
    def c(part, stat):
        return F.col(f"{part}__{stat}")
    nh, nl = c(HIGH, "n"), c(LOW, "n")
    n = nh + nl
    mh = F.try_divide(c(HIGH, "s"), nh.cast("double"))
    ml = F.try_divide(c(LOW, "s"), nl.cast("double"))
    cross = F.when((nh > 0) & (nl > 0),
                   (nh * nl).cast("double") / n.cast("double") * (mh - ml) * (mh - ml)).otherwise(F.lit(0.0))
    m2 = F.when(n > 0, F.coalesce(c(HIGH, "m2"), F.lit(0.0)) + F.coalesce(c(LOW, "m2"), F.lit(0.0)) + cross)
    s = F.when(n > 0, F.coalesce(c(HIGH, "s"), F.lit(0.0)) + F.coalesce(c(LOW, "s"), F.lit(0.0)))
    return [
        (c(HIGH, "rows") + c(LOW, "rows")).alias(f"{ALL}__rows"),
        n.alias(f"{ALL}__n"),
        s.alias(f"{ALL}__s"),
        F.greatest(c(HIGH, "mx"), c(LOW, "mx")).alias(f"{ALL}__mx"),
        m2.alias(f"{ALL}__m2"),
        F.greatest(c(HIGH, "pk"), c(LOW, "pk")).alias(f"{ALL}__pk"),
    ]


def daily_table(rows: DataFrame, freq: str, use_price: bool,
                holidays: DataFrame | str | None = None) -> DataFrame:
    """Household-day partials: ``aID, period, tariff_active, day, price,
    rows, n, s, mx, m2, pk`` -- one row per day and price part that has
    readings ('all' always; 'high' / 'low' when ``use_price``)."""
    keyed = with_period(_ensure_active(rows), freq).withColumn("day", F.to_date(S.TS))
    keyed = with_peak_key(keyed)
    keys = (S.ID, S.PERIOD, S.ACTIVE, "day")
    if use_price:
        keyed = with_price_part(keyed, holidays)
        daily = keyed.groupBy(*keys).agg(*_part_aggs(HIGH, F.col("_hl") == HIGH),
                                         *_part_aggs(LOW, F.col("_hl") == LOW))
        daily = daily.select("*", *_merged_all())
        names = (ALL, HIGH, LOW)
    else:
        daily = keyed.groupBy(*keys).agg(*_part_aggs(ALL, None))
        names = (ALL,)
    structs = [F.struct(F.lit(name).alias(S.PRICE),
                        *[F.col(f"{name}__{c}").alias(c) for c in _STATS]) for name in names]
    return daily.select(*keys, F.inline(F.array(*structs))).where(F.col("rows") > 0)


def aggregate_from_daily(daily: DataFrame, methods: Sequence[str], top3: bool,
                         keep_total: bool = False) -> DataFrame:
    """G-level result from household-day partials (one shuffle on ``G``)."""
    # One window spec (partition + order) for every window expression, so a
    # single sort serves the group sums and the day ranking; whole-group
    # sums use an unbounded frame.
    ranked = Window.partitionBy(*GROUP_COLS).orderBy(F.col("_pv").desc_nulls_last(), F.col("day"))
    g = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, s = F.col("n"), F.col("s")
    d = daily.withColumn("_pv", _peak_value("pk")) if top3 else \
        daily.withColumn("_pv", F.lit(None).cast("double"))
    if "variance" in methods:
        group_mean = F.try_divide(F.sum("s").over(g), F.sum("n").over(g).cast("double"))
        day_mean = F.try_divide(s, n.cast("double"))
        dev = F.col("m2") + n * (day_mean - group_mean) * (day_mean - group_mean)
        d = d.withColumn("_dev", F.when(n > 0, dev))
    if top3:
        d = d.withColumn("_pt", _peak_time("pk"))
        d = d.withColumn("_rank", F.when(F.col("_pv").isNotNull(), F.row_number().over(ranked)))
    cols = []
    for m in methods:
        if m == "sum":
            cols.append(F.coalesce(F.sum("s"), F.lit(0.0)).alias("sum_consumption"))
        elif m == "mean":
            cols.append(F.try_divide(F.sum("s"), F.sum("n").cast("double")).alias("mean_consumption"))
        elif m == "max":
            cols.append(F.max("mx").alias("max_consumption"))
        elif m == "variance":
            nn = F.sum("n")
            cols.append(F.when(nn > 1, F.sum("_dev") / (nn - 1).cast("double")).alias("variance_consumption"))
    if top3:
        r, pv, pt = F.col("_rank"), F.col("_pv"), F.col("_pt")
        cols += [F.max(F.when(r == i, pv)).alias(f"peak{i}_consumption") for i in (1, 2, 3)]
        cols += [F.max(F.when(r == i, pt)).alias(f"peak{i}_time") for i in (1, 2, 3)]
        cols.append(F.avg(F.when(r <= 3, pv)).alias("top3_mean_consumption"))
    if keep_total:
        cols.append(F.sum("s").alias(TOTAL))
    return d.groupBy(*GROUP_COLS).agg(*cols)


def aggregate_direct(rows: DataFrame, freq: str, methods: Sequence[str], use_price: bool,
                     holidays: DataFrame | str | None = None, keep_total: bool = False) -> DataFrame:
    """Mergeable methods without top-3: one hash aggregate over the readings
    with conditional columns per price part; the result, not the readings, is
    unpivoted."""
    keyed = with_period(_ensure_active(rows), freq)
    conds = {ALL: None}
    if use_price:
        keyed = with_price_part(keyed, holidays)
        conds.update({HIGH: F.col("_hl") == HIGH, LOW: F.col("_hl") == LOW})
    cols, structs = [], []
    for part, cond in conds.items():
        value = F.col(S.VALUE) if cond is None else F.when(cond, F.col(S.VALUE))
        found = F.count(F.lit(1) if cond is None else F.when(cond, F.lit(1)))
        named = {"_rows": found, **{f"{m}_consumption": method_column(m, value) for m in methods}}
        if keep_total:
            named[TOTAL] = F.sum(value)
        cols += [c.alias(f"{part}__{n}") for n, c in named.items()]
        structs.append(F.struct(F.lit(part).alias(S.PRICE), *[F.col(f"{part}__{n}").alias(n) for n in named]))
    keys = (S.ID, S.PERIOD, S.ACTIVE)
    wide = keyed.groupBy(*keys).agg(*cols)
    return wide.select(*keys, F.inline(F.array(*structs))).where(F.col("_rows") > 0).drop("_rows")


def aggregate(rows: DataFrame, freq: str = "month", agg_method: str | Sequence[str] = TOP3,
              use_price: bool = True, holidays: DataFrame | str | None = None,
              strategy: str = "auto", keep_total: bool = False,
              single_task_max: int = SINGLE_TASK_MAX) -> DataFrame:
    """Wide household-period result for every method, in method order.

    ``rows`` needs ``aID, TIDPUNKT, FORBRUKNING_KWH`` and optionally
    ``tariff_active`` (0 when absent). The period column is called ``period``.
    ``strategy``: ``auto`` (household-day partials for top-3 and what is asked
    with it, one direct aggregate for mergeable methods alone, raw readings for median / quantiles), or ``explode`` /
    ``grouping_sets`` (every basic method from raw readings, with that price
    expansion). ``keep_total`` adds ``_total`` (sum of the group's readings).
    ``single_task_max``: groups with more values are ranked distributed for
    exact median / quantiles.
    """
    methods = normalize_methods(agg_method)
    if strategy not in ("auto", "explode", "grouping_sets"):
        raise ValueError(f"unknown strategy: {strategy}")
    basic = [m for m in methods if m != TOP3]
    want_top3 = TOP3 in methods
    if strategy == "auto":
        merged = [m for m in basic if m in MERGEABLE]
        raw = [m for m in basic if m not in MERGEABLE]
    else:
        merged, raw = [], basic
    parts = []
    if (merged or keep_total) and not want_top3:
        parts.append(aggregate_direct(rows, freq, merged, use_price, holidays, keep_total))
    elif merged or keep_total:
        parts.append(aggregate_from_daily(daily_table(rows, freq, use_price, holidays),
                                          merged, want_top3, keep_total))
    elif want_top3:
        parts.append(aggregate_top3(rows, freq, use_price, holidays))
    if raw:
        raw_part = aggregate_basic(rows, freq, raw, use_price, holidays,
                                   "explode" if strategy == "auto" else strategy, single_task_max)
        parts.insert(0, raw_part)
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(GROUP_COLS), "left")
    ordered = []
    for m in methods:
        ordered += list(PEAK_COLS) if m == TOP3 else [f"{m}_consumption"]
    return out.select(*GROUP_COLS, *ordered, *([TOTAL] if keep_total else []))
