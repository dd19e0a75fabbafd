"""DuckDB SQL oracle for the registered queries.

Each registered query has an independent SQL formulation here, run by the
driver's DuckDB on the same Parquet tables. Both sides build the stand-in
inputs with the same fixed rules (see ``loadshape.sources.driver_views``)
and canonicalise every computed double the same way: 9 significant digits,
floored after adding 0.3183 (so the cut is not at exact halves, where means
of 2-decimal readings land), using only exact powers of ten -- bit-identical
to ``loadshape.plans.queries.canon``.
"""

from __future__ import annotations

SIG_DIGITS = 9
ROUND_OFFSET = 0.3183


def R(expr: str) -> str:  # noqa: N802
    """Canonical double (see module doc)."""
    x = f"CAST({expr} AS DOUBLE)"
    k = f"least({SIG_DIGITS - 1} - CAST(floor(log10(abs({x}))) AS INTEGER), 15)"
    up = f"floor({x} * pow(10, {k}) + {ROUND_OFFSET}) / pow(10, {k})"
    down = f"floor({x} / pow(10, -({k})) + {ROUND_OFFSET}) * pow(10, -({k}))"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN CAST(0 AS DOUBLE) "
            f"WHEN {k} >= 0 THEN {up} ELSE {down} END)")


# ---------------------------------------------------------------- inputs
METER_L = """SELECT CAST(l_suppkey AS VARCHAR) AS aID,
       CAST(l_shipdate AS TIMESTAMP) AS TIDPUNKT,
       CAST(l_shipdate AS DATE) AS TIDPUNKT_DAG,
       CAST(l_extendedprice AS DOUBLE) AS FORBRUKNING_KWH
FROM lineitem"""

METER_E = """SELECT CAST(user_id AS VARCHAR) AS aID,
       CAST(ts AS TIMESTAMP) AS TIDPUNKT,
       CAST(ts AS DATE) AS TIDPUNKT_DAG,
       CAST(value AS DOUBLE) AS FORBRUKNING_KWH
FROM events"""


def _plan(key: str) -> str:
    return f"CASE WHEN {key} % 2 = 0 THEN 'Kvällsplan 5 kW Villa' ELSE 'Kvällsplan 11 kW Normal' END"


TARIFF_RAW_L = f"""SELECT {_plan('s_suppkey')} AS "Produktnamn",
       CAST(date_add(DATE '1998-01-01', to_months(CAST(s_suppkey % 7 AS INTEGER))) AS DATE) AS "Startdatum",
       CAST(s_suppkey AS VARCHAR) AS "GS1-nr."
FROM supplier WHERE s_suppkey % 5 = 0"""

TARIFF_RAW_E = f"""SELECT {_plan('user_id')} AS "Produktnamn",
       CAST(DATE '2024-01-01' + CAST(user_id % 20 AS INTEGER) AS DATE) AS "Startdatum",
       CAST(user_id AS VARCHAR) AS "GS1-nr."
FROM (SELECT DISTINCT user_id FROM events) u WHERE user_id % 5 = 0"""


def tariff_sql(raw: str) -> str:
    """Normalised + deduplicated tariff (earliest start, then smallest plan)."""
    return f"""SELECT aID, tariff_start, tariff_plan FROM (
  SELECT "GS1-nr." AS aID, CAST("Startdatum" AS DATE) AS tariff_start, "Produktnamn" AS tariff_plan,
         row_number() OVER (PARTITION BY "GS1-nr." ORDER BY "Startdatum" IS NULL, "Startdatum", "Produktnamn" NULLS FIRST) AS rn
  FROM ({raw}) r) WHERE rn = 1"""


TARIFF_L = tariff_sql(TARIFF_RAW_L)
TARIFF_E = tariff_sql(TARIFF_RAW_E)

HOLIDAYS = """SELECT * FROM (VALUES (DATE '2024-01-01', 'Nyårsdagen'),
                           (DATE '2024-01-06', 'Trettondedag jul')) h(date, name)"""

PLAN_RX = r"(\d+\s*kW\s*(?:Villa|Normal))"


def rows_sql(meter: str, tariff: str | None) -> str:
    """Meter LEFT JOIN tariff with has_tariff / tariff_active."""
    if tariff is None:
        return f"""SELECT m.*, CAST(NULL AS DATE) AS tariff_start, CAST(NULL AS VARCHAR) AS tariff_plan,
       0 AS has_tariff, 0 AS tariff_active FROM ({meter}) m"""
    return f"""SELECT m.*, t.tariff_start, t.tariff_plan,
       CAST(t.tariff_start IS NOT NULL AS INTEGER) AS has_tariff,
       CASE WHEN t.tariff_start IS NOT NULL AND m.TIDPUNKT >= CAST(t.tariff_start AS TIMESTAMP)
            THEN 1 ELSE 0 END AS tariff_active
FROM ({meter}) m LEFT JOIN ({tariff}) t ON m.aID = t.aID"""


ROWS_L = rows_sql(METER_L, TARIFF_L)
ROWS_E = rows_sql(METER_E, TARIFF_E)


def period_sql(freq: str, ts: str = "TIDPUNKT") -> str:
    d = f"CAST({ts} AS DATE)"
    return {
        "day": f"CAST({d} AS TIMESTAMP)",
        "week": f"CAST({d} - CAST(isodow({ts}) - 1 AS INTEGER) AS TIMESTAMP)",
        "month": f"CAST(date_trunc('month', {d}) AS TIMESTAMP)",
        "quarter": f"CAST(date_trunc('quarter', {d}) AS TIMESTAMP)",
        "year": f"CAST(date_trunc('year', {d}) AS TIMESTAMP)",
        "hour": f"CAST(hour({ts}) AS INTEGER)",
        "weekday": f"CAST(isodow({ts}) - 1 AS INTEGER)",
        "week_part": f"CASE WHEN isodow({ts}) <= 5 THEN 'weekday' ELSE 'weekend' END",
    }[freq]


def price_sql(ts: str = "TIDPUNKT", holidays: str | None = None) -> str:
    cond = (f"month({ts}) IN (11, 12, 1, 2, 3) AND isodow({ts}) <= 5 "
            f"AND hour({ts}) BETWEEN 7 AND 19")
    if holidays is not None:
        cond += f" AND CAST({ts} AS DATE) NOT IN (SELECT date FROM ({holidays}) hh)"
    return f"CASE WHEN {cond} THEN 'high' ELSE 'low' END"


def priced_sql(rows: str, freq: str, use_price: bool = True, holidays: str | None = None) -> str:
    keyed = f"SELECT *, {period_sql(freq)} AS period FROM ({rows}) r0"
    if not use_price:
        return f"SELECT *, 'all' AS price FROM ({keyed}) k"
    return (f"SELECT *, 'all' AS price FROM ({keyed}) k UNION ALL "
            f"SELECT *, {price_sql(holidays=holidays)} AS price FROM ({keyed}) k")


def method_sql(m: str) -> str:
    v = "FORBRUKNING_KWH"
    if m == "sum":
        e = f"coalesce(sum({v}), CAST(0 AS DOUBLE))"
    elif m == "mean":
        e = f"avg({v})"
    elif m == "variance":
        e = f"var_samp({v})"
    elif m == "median":
        e = f"quantile_cont({v}, 0.5)"
    elif m == "max":
        e = f"max({v})"
    else:
        e = f"quantile_cont({v}, {float(m[1:]) / 100.0})"
    return f"{e} AS {m}_consumption"


G = "aID, period, price, tariff_active"


def daily_peaks_sql(priced: str) -> str:
    return f"""SELECT {G}, day, peak_consumption, peak_time FROM (
  SELECT {G}, CAST(TIDPUNKT AS DATE) AS day, FORBRUKNING_KWH AS peak_consumption, TIDPUNKT AS peak_time,
         row_number() OVER (PARTITION BY {G}, CAST(TIDPUNKT AS DATE)
                            ORDER BY FORBRUKNING_KWH DESC NULLS LAST, TIDPUNKT) AS rn
  FROM ({priced}) p) WHERE rn = 1 AND peak_consumption IS NOT NULL"""


def top3_days_sql(priced: str) -> str:
    return f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY peak_consumption DESC, day) AS rank
  FROM ({daily_peaks_sql(priced)}) d) WHERE rank <= 3"""


def top3_sql(priced: str) -> str:
    cons = ", ".join(f"max(peak_consumption) FILTER (WHERE rank = {i}) AS peak{i}_consumption"
                     for i in (1, 2, 3))
    times = ", ".join(f"max(peak_time) FILTER (WHERE rank = {i}) AS peak{i}_time" for i in (1, 2, 3))
    return f"""SELECT {G}, {cons}, {times}, avg(peak_consumption) AS top3_mean_consumption
FROM ({top3_days_sql(priced)}) t GROUP BY {G}"""


PEAK_COLS = ["peak1_consumption", "peak2_consumption", "peak3_consumption",
             "peak1_time", "peak2_time", "peak3_time", "top3_mean_consumption"]


def aggregate_sql(rows: str, freq: str, methods: list[str], use_price: bool = True,
                  holidays: str | None = None) -> str:
    """G (period named ``period``) + method columns, unrounded."""
    priced = priced_sql(rows, freq, use_price, holidays)
    basic = [m for m in methods if m != "top3_mean"]
    cols = []
    for m in methods:
        cols += PEAK_COLS if m == "top3_mean" else [f"{m}_consumption"]
    if basic:
        b = f"SELECT {G}, {', '.join(method_sql(m) for m in basic)} FROM ({priced}) p GROUP BY {G}"
        if "top3_mean" in methods:
            t = top3_sql(priced)
            sel = ", ".join(f"b.{c}" if not c.startswith(("peak", "top3")) else f"t.{c}" for c in cols)
            return f"""SELECT b.aID, b.period, b.price, b.tariff_active, {sel}
FROM ({b}) b LEFT JOIN ({t}) t
  ON b.aID = t.aID AND b.period = t.period AND b.price = t.price AND b.tariff_active = t.tariff_active"""
        return b
    return top3_sql(priced)


def tariff_info_sql(tariff: str) -> str:
    return f"""SELECT aID, tariff_start, nullif(regexp_extract(tariff_plan, '{PLAN_RX}', 1), '') AS tariff_plan
FROM ({tariff}) t"""


def usage_sql(meter: str, q1: float = 0.25, q2: float = 0.75) -> str:
    return f"""WITH tot AS (SELECT aID, coalesce(sum(FORBRUKNING_KWH), CAST(0 AS DOUBLE)) AS total_consumption
                FROM ({meter}) m GROUP BY aID),
     th AS (SELECT quantile_cont(total_consumption, {q1}) AS q1,
                   quantile_cont(total_consumption, {q2}) AS q2 FROM tot)
SELECT aID, total_consumption,
       CASE WHEN total_consumption <= q1 THEN 'low'
            WHEN q2 > q1 AND total_consumption <= q2 THEN 'medium'
            ELSE 'high' END AS usage_group
FROM tot CROSS JOIN th"""


def run_sql(meter: str, tariff: str | None, freq: str, methods: list[str], use_price: bool = True,
            usage: tuple[float, float] | None = None, holidays: str | None = None) -> str:
    """The pipeline: aggregate + tariff info + usage group (unrounded)."""
    agg = aggregate_sql(rows_sql(meter, tariff), freq, methods, use_price, holidays)
    cols = []
    for m in methods:
        cols += PEAK_COLS if m == "top3_mean" else [f"{m}_consumption"]
    sel = ["a.aID", "a.period AS TIDPUNKT", "a.price", "a.tariff_active"] + [f"a.{c}" for c in cols]
    joins = ""
    if tariff is not None:
        sel += ["ti.tariff_start", "ti.tariff_plan"]
        joins += f" LEFT JOIN ({tariff_info_sql(tariff)}) ti ON a.aID = ti.aID"
    if usage is not None:
        sel += ["u.total_consumption", "u.usage_group"]
        joins += f" LEFT JOIN ({usage_sql(meter, *usage)}) u ON a.aID = u.aID"
    return f"SELECT {', '.join(sel)} FROM ({agg}) a{joins}"


# The notebook's monthly call on the multi-year stand-in.
MONTHLY_L = run_sql(METER_L, TARIFF_L, "month", ["top3_mean", "variance", "mean"], True, (0.25, 0.75))
# Monthly top-3 on the hourly stand-in (for the peak-hour tables).
MONTHLY_E = run_sql(METER_E, TARIFF_E, "month", ["top3_mean", "mean"], True, (0.25, 0.75))


# ---------------------------------------------------------------- queries


def _agg_q(rows: str, freq: str, methods: list[str], use_price: bool = True,
           holidays: str | None = None) -> str:
    a = aggregate_sql(rows, freq, methods, use_price, holidays)
    cols = ["aID", "period AS TIDPUNKT", "price", "tariff_active"]
    for m in methods:
        names = PEAK_COLS if m == "top3_mean" else [f"{m}_consumption"]
        cols += [c if "time" in c else f"{R(c)} AS {c}" for c in names]
    return f"SELECT {', '.join(cols)} FROM ({a}) a"


def _run_q(sql: str, methods: list[str], tariff: bool, usage: bool) -> str:
    cols = ["aID", "TIDPUNKT", "price", "tariff_active"]
    for m in methods:
        names = PEAK_COLS if m == "top3_mean" else [f"{m}_consumption"]
        cols += [c if "time" in c else f"{R(c)} AS {c}" for c in names]
    if tariff:
        cols += ["tariff_start", "tariff_plan"]
    if usage:
        cols += [f"{R('total_consumption')} AS total_consumption", "usage_group"]
    return f"SELECT {', '.join(cols)} FROM ({sql}) a"


ORACLE: dict[str, str] = {}

ORACLE["scan_meter"] = f"SELECT aID, TIDPUNKT, TIDPUNKT_DAG, {R('FORBRUKNING_KWH')} AS FORBRUKNING_KWH FROM ({METER_L}) m"
ORACLE["scan_tariff"] = f"""SELECT "GS1-nr." AS aID, CAST("Startdatum" AS DATE) AS tariff_start,
       "Produktnamn" AS tariff_plan FROM ({TARIFF_RAW_L}) t"""
ORACLE["dataset_profile"] = f"""SELECT count(*) AS n_rows, count(DISTINCT aID) AS n_households,
       count(DISTINCT TIDPUNKT_DAG) AS n_days FROM ({METER_L}) m"""
ORACLE["enriched_rows"] = f"""SELECT r.aID, r.TIDPUNKT, r.TIDPUNKT_DAG, {R('r.FORBRUKNING_KWH')} AS FORBRUKNING_KWH,
       r.tariff_start, r.tariff_plan, r.has_tariff, r.tariff_active,
       {R('u.total_consumption')} AS total_consumption, u.usage_group
FROM ({ROWS_E}) r LEFT JOIN ({usage_sql(METER_E)}) u ON r.aID = u.aID"""
ORACLE["tariff_join"] = f"""SELECT aID, TIDPUNKT, TIDPUNKT_DAG, {R('FORBRUKNING_KWH')} AS FORBRUKNING_KWH,
       tariff_start, tariff_plan, has_tariff, tariff_active FROM ({ROWS_E}) r"""
ORACLE["tariff_flags"] = f"""SELECT aID, max(has_tariff) AS has_tariff, count(*) AS n_rows,
       CAST(sum(tariff_active) AS BIGINT) AS n_active FROM ({ROWS_E}) r GROUP BY aID"""
ORACLE["plan_extract"] = tariff_info_sql(TARIFF_L)
ORACLE["attach_tariff"] = _run_q(run_sql(METER_L, TARIFF_L, "quarter", ["mean"], True), ["mean"], True, False)
ORACLE["usage_group"] = f"""SELECT aID, {R('total_consumption')} AS total_consumption, usage_group
FROM ({usage_sql(METER_L)}) u"""
ORACLE["attach_usage_group"] = _run_q(run_sql(METER_L, None, "year", ["sum"], False, (0.25, 0.75)),
                                      ["sum"], False, True)
ORACLE["price_period"] = f"""SELECT {price_sql()} AS price, CAST(isodow(TIDPUNKT) - 1 AS INTEGER) AS weekday,
       CAST(hour(TIDPUNKT) AS INTEGER) AS hour, count(*) AS n_rows,
       {R('sum(FORBRUKNING_KWH)')} AS sum_consumption
FROM ({METER_E}) m GROUP BY ALL"""
# Independent of the engine's rules: Easter by the 1900-2099 century rule, and
# weekday-bound days by listing every day of the year.
_SWEDISH = """WITH y AS (SELECT unnest(range({first}, {last} + 1)) AS y),
m AS (SELECT y, 225 - 11 * (y % 19) AS d0 FROM y),
m2 AS (SELECT y, d0 - 30 * greatest(0, CAST(ceil((d0 - 50) / 30.0) AS BIGINT)) AS d1 FROM m),
m3 AS (SELECT y, CASE WHEN d1 > 48 THEN d1 - 1 ELSE d1 END AS d FROM m2),
e AS (SELECT y, CAST(DATE '2000-03-01' + INTERVAL (d + 7 - ((y + y // 4 + d + 1) % 7) - 1) DAY AS DATE) AS in_2000 FROM m3),
easter AS (SELECT y, make_date(y, month(in_2000), day(in_2000)) AS easter FROM e),
fixed AS (SELECT make_date(y, mm, dd) AS date, name, mm AS ord FROM y, (VALUES (1, 1, 'Nyårsdagen', 0), (1, 6, 'Trettondedag jul', 0),
    (5, 1, 'Första maj', 0), (6, 6, 'Sveriges nationaldag', 2005), (12, 24, 'Julafton', 0), (12, 25, 'Juldagen', 0),
    (12, 26, 'Annandag jul', 0), (12, 31, 'Nyårsafton', 0)) f(mm, dd, name, since) WHERE y >= since),
moving AS (SELECT CAST(easter + INTERVAL (n) DAY AS DATE) AS date, name, 20 AS ord FROM easter, (VALUES (-2, 'Långfredagen', 9999), (0, 'Påskdagen', 9999),
    (1, 'Annandag påsk', 9999), (39, 'Kristi himmelsfärdsdag', 9999), (49, 'Pingstdagen', 9999), (50, 'Annandag pingst', 2004)) f(n, name, until)
    WHERE y <= until),
days AS (SELECT CAST(unnest(generate_series(make_date({first}, 1, 1), make_date({last}, 12, 31), INTERVAL 1 DAY)) AS DATE) AS date),
bound AS (SELECT date, CASE WHEN month(date) = 6 AND day(date) BETWEEN 19 AND 25 AND isodow(date) = 5 THEN 'Midsommarafton'
    WHEN month(date) = 6 AND day(date) BETWEEN 20 AND 26 AND isodow(date) = 6 THEN 'Midsommardagen'
    WHEN isodow(date) = 6 AND (month(date) = 11 AND day(date) <= 6 OR month(date) = 10 AND day(date) = 31) THEN 'Alla helgons dag' END AS name, 30 AS ord FROM days)
SELECT date, string_agg(name, '; ' ORDER BY ord) AS name
FROM (SELECT * FROM fixed UNION ALL SELECT * FROM moving UNION ALL SELECT * FROM bound WHERE name IS NOT NULL) GROUP BY date"""
_YEARS = f"(SELECT {{which}}(year(TIDPUNKT)) FROM (SELECT TIDPUNKT FROM ({METER_L}) UNION ALL SELECT TIDPUNKT FROM ({METER_E})))"
SWEDISH = _SWEDISH.format(first=_YEARS.format(which="min"), last=_YEARS.format(which="max"))
ORACLE["holiday_calendar"] = SWEDISH
ORACLE["price_period_country"] = f"""SELECT CAST(TIDPUNKT AS DATE) AS day, {price_sql(holidays=SWEDISH)} AS price,
       count(*) AS n_rows, {R("sum(FORBRUKNING_KWH)")} AS sum_consumption
FROM ({METER_E}) m GROUP BY 1, 2"""
ORACLE["consumption_on_holidays"] = f"""SELECT CAST(year(h.date) AS INTEGER) AS year, h.name AS holiday,
       count(*) AS n_rows, {R("sum(FORBRUKNING_KWH)")} AS sum_consumption
FROM ({METER_L}) m JOIN ({SWEDISH}) h ON CAST(m.TIDPUNKT AS DATE) = h.date GROUP BY 1, 2"""

ORACLE["price_period_holidays"] = f"""SELECT CAST(TIDPUNKT AS DATE) AS day, {price_sql(holidays=HOLIDAYS)} AS price,
       count(*) AS n_rows, {R('sum(FORBRUKNING_KWH)')} AS sum_consumption
FROM ({METER_E}) m GROUP BY ALL"""
ORACLE["price_mode"] = f"""SELECT price, count(*) AS n_rows, {R('sum(FORBRUKNING_KWH)')} AS sum_consumption
FROM ({priced_sql(METER_E, 'day')}) p GROUP BY price"""
ORACLE["agg_price_grouping_sets"] = _agg_q(ROWS_E, "week", ["sum", "median"])
for _freq, _rows in (("day", ROWS_L), ("week", ROWS_L), ("month", ROWS_L), ("quarter", ROWS_L),
                     ("year", ROWS_L), ("hour", ROWS_E), ("weekday", ROWS_E), ("week_part", ROWS_E)):
    ORACLE[f"period_{_freq}"] = _agg_q(_rows, _freq, ["sum", "mean", "max"])
for _m in ("sum", "mean", "variance", "median", "max", "q90"):
    ORACLE[f"agg_{_m}"] = _agg_q(ROWS_E, "week", [_m])
ORACLE["agg_top3_mean"] = _agg_q(ROWS_L, "month", ["top3_mean"])
ORACLE["agg_multi"] = _agg_q(ROWS_L, "month", ["top3_mean", "variance", "mean"])
ORACLE["monthly_aggregate"] = _run_q(MONTHLY_L, ["top3_mean", "variance", "mean"], True, True)
ORACLE["scan_aggregate"] = f"SELECT * EXCLUDE (price) FROM ({ORACLE['monthly_aggregate']}) m WHERE price = 'all'"
ORACLE["daily_peak"] = f"""SELECT aID, period AS TIDPUNKT, price, tariff_active, day,
       {R('peak_consumption')} AS peak_consumption, peak_time
FROM ({daily_peaks_sql(priced_sql(ROWS_E, 'week'))}) d"""
ORACLE["top3_days"] = f"""SELECT aID, period AS TIDPUNKT, price, tariff_active, day,
       {R('peak_consumption')} AS peak_consumption, peak_time, CAST(rank AS INTEGER) AS rank
FROM ({top3_days_sql(priced_sql(ROWS_E, 'week'))}) d"""


# ---------------------------------------------------------------- adoption / curves
TARIFF_N_L = f"""SELECT "GS1-nr." AS aID, CAST("Startdatum" AS DATE) AS tariff_start,
       "Produktnamn" AS tariff_plan FROM ({TARIFF_RAW_L}) t"""
_MONTH = "CAST(date_trunc('month', tariff_start) AS DATE)"

ORACLE["monthly_adoption"] = f"""SELECT strftime({_MONTH}, '%Y-%m') AS month, count(DISTINCT aID) AS households
FROM ({TARIFF_N_L}) t WHERE tariff_start IS NOT NULL GROUP BY 1"""
ORACLE["adoption_share"] = f"""WITH c AS (SELECT {_MONTH} AS month, count(DISTINCT aID) AS households
           FROM ({TARIFF_N_L}) t WHERE tariff_start IS NOT NULL GROUP BY 1),
     ax AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM c),
     tot AS (SELECT count(DISTINCT aID) AS total FROM ({METER_L}) m),
     d AS (SELECT ax.month, CAST(coalesce(c.households, 0) AS BIGINT) AS households
           FROM ax LEFT JOIN c ON ax.month = c.month)
SELECT month, households, CAST(sum(households) OVER (ORDER BY month) AS BIGINT) AS cumulative,
       {R('CAST(sum(households) OVER (ORDER BY month) AS DOUBLE) / CAST(total AS DOUBLE)')} AS share
FROM d CROSS JOIN tot"""
ORACLE["plan_counts"] = f"""SELECT tariff_plan AS tariff_group, count(*) AS households
FROM ({TARIFF_N_L}) t WHERE tariff_plan IS NOT NULL GROUP BY 1"""
ORACLE["plan_cumulative"] = f"""WITH t AS (SELECT aID, {_MONTH} AS month,
                  nullif(regexp_extract(tariff_plan, '{PLAN_RX}', 1), '') AS tariff_plan FROM ({TARIFF_N_L}) x),
     c AS (SELECT month, tariff_plan, count(DISTINCT aID) AS households FROM t
           WHERE tariff_plan IS NOT NULL AND month IS NOT NULL GROUP BY 1, 2),
     ax AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM c),
     g AS (SELECT ax.month, p.tariff_plan FROM ax, (SELECT DISTINCT tariff_plan FROM c) p),
     d AS (SELECT g.month, g.tariff_plan, CAST(coalesce(c.households, 0) AS BIGINT) AS households
           FROM g LEFT JOIN c ON g.month = c.month AND g.tariff_plan = c.tariff_plan)
SELECT month, tariff_plan, households,
       CAST(sum(households) OVER (PARTITION BY tariff_plan ORDER BY month) AS BIGINT) AS cumulative FROM d"""
ORACLE["rows_by_active"] = f"""SELECT tariff_active, count(*) AS n_rows
FROM ({run_sql(METER_E, TARIFF_E, 'hour', ['mean'], True, (0.25, 0.75))}) h GROUP BY 1"""
ORACLE["distinct_adopters"] = f"""SELECT DISTINCT aID AS id, CAST(tariff_start AS DATE) AS adoption_month
FROM ({MONTHLY_L}) m WHERE price = 'all' AND tariff_start IS NOT NULL"""
_MONTHLY_COLS = ["top3_mean", "variance", "mean"]
ORACLE["filter_price"] = _run_q(f"SELECT * FROM ({MONTHLY_E}) m WHERE price = 'high'",
                                ["top3_mean", "mean"], True, True)
ORACLE["adopters_only"] = _run_q(f"SELECT * FROM ({MONTHLY_L}) m WHERE tariff_start IS NOT NULL",
                                 _MONTHLY_COLS, True, True)
ORACLE["consumption_curve"] = f"""SELECT TIDPUNKT, {R('avg(top3_mean_consumption)')} AS top3_mean_consumption
FROM ({MONTHLY_L}) m WHERE price = 'all' GROUP BY TIDPUNKT"""


def _wide_avg(keys: list[str], expr_key: str, value: str = "top3_mean_consumption") -> str:
    return ", ".join(f"{R(f'avg({value}) FILTER (WHERE {expr_key} = {chr(39)}{k}{chr(39)})')} AS {k}"
                     for k in keys)


_PT = "price || '_' || CAST(tariff_active AS VARCHAR)"
ORACLE["consumption_by_price_tariff"] = f"""SELECT TIDPUNKT, {_wide_avg(['high_0', 'high_1', 'low_0', 'low_1'], _PT)}
FROM ({MONTHLY_L}) m WHERE price <> 'all' GROUP BY TIDPUNKT"""
ORACLE["consumption_curve_median"] = f"""SELECT TIDPUNKT, {_wide_avg(['high_0', 'high_1', 'low_0', 'low_1'], _PT).replace('avg(', 'median(')}
FROM ({MONTHLY_L}) m WHERE price <> 'all' GROUP BY TIDPUNKT"""
ORACLE["reading_quantiles"] = f"""SELECT CAST(year(TIDPUNKT) AS INTEGER) AS year, {R('quantile_cont(FORBRUKNING_KWH, 0.05)')} AS q05,
       {R('quantile_cont(FORBRUKNING_KWH, 0.5)')} AS median, {R('quantile_cont(FORBRUKNING_KWH, 0.95)')} AS q95
FROM ({METER_L}) m GROUP BY 1"""
_UT = "usage_group || '_' || CAST(tariff_active AS VARCHAR)"
ORACLE["consumption_by_usage_tariff"] = f"""SELECT TIDPUNKT,
       {_wide_avg(['low_0', 'low_1', 'medium_0', 'medium_1', 'high_0', 'high_1'], _UT)}
FROM ({MONTHLY_L}) m WHERE price = 'all' GROUP BY TIDPUNKT"""
ORACLE["consumption_by_usage"] = f"""SELECT TIDPUNKT, {_wide_avg(['low', 'medium', 'high'], 'usage_group')}
FROM ({MONTHLY_L}) m WHERE price = 'all' GROUP BY TIDPUNKT"""
ORACLE["adoption_by_usage"] = f"""SELECT g.usage_group, {R('s.share')} AS share
FROM (VALUES ('low'), ('medium'), ('high')) g(usage_group)
LEFT JOIN (SELECT usage_group, avg(CAST(tariff_active AS DOUBLE)) AS share
           FROM ({MONTHLY_L}) m GROUP BY usage_group) s ON g.usage_group = s.usage_group"""
_EVT = ("CAST((year(TIDPUNKT) - year(tariff_start)) * 12 + (month(TIDPUNKT) - month(tariff_start))"
        " AS INTEGER)")
_EV_BASE = f"""SELECT *, {_EVT} AS event_time FROM ({MONTHLY_L}) m WHERE tariff_start IS NOT NULL"""
ORACLE["event_study"] = f"""SELECT event_time, {_wide_avg(['low', 'medium', 'high'], 'usage_group')}
FROM ({_EV_BASE}) e WHERE event_time BETWEEN -12 AND 12 GROUP BY event_time"""
ORACLE["event_study_by_plan"] = f"""SELECT event_time, tariff_plan, {R('avg(top3_mean_consumption)')} AS mean_value
FROM ({_EV_BASE}) e WHERE event_time BETWEEN -12 AND 12 AND tariff_plan IS NOT NULL GROUP BY 1, 2"""


# ---------------------------------------------------------------- peaks
HIGH_E = f"SELECT * FROM ({MONTHLY_E}) m WHERE price = 'high'"
LONG_E = " UNION ALL ".join(
    f"""SELECT aID, TIDPUNKT, price, tariff_active, {i} AS rank, peak{i}_time AS peak_time,
       peak{i}_consumption AS peak_consumption FROM ({HIGH_E}) h{i}
       WHERE peak{i}_time IS NOT NULL AND peak{i}_consumption IS NOT NULL""" for i in (1, 2, 3))
_LM = f"SELECT *, CAST(month(peak_time) AS INTEGER) AS month, CAST(hour(peak_time) AS INTEGER) AS hour FROM ({LONG_E}) l"

ORACLE["peaks_long"] = f"""SELECT aID, TIDPUNKT, price, tariff_active, CAST(rank AS INTEGER) AS rank, peak_time,
       {R('peak_consumption')} AS peak_consumption FROM ({LONG_E}) l"""
ORACLE["peak_hour_count"] = f"SELECT hour, count(*) AS n_peaks FROM ({_LM}) l GROUP BY hour"
for _price in ("all", "low"):
    _of_price = _LM.replace("price = 'high'", f"price = '{_price}'")
    ORACLE[f"peak_hour_count_{_price}"] = f"SELECT hour, count(*) AS n_peaks FROM ({_of_price}) l GROUP BY hour"
ORACLE["peak_hour_consumption"] = f"""SELECT hour, {R('sum(peak_consumption)')} AS peak_consumption
FROM ({_LM}) l GROUP BY hour"""


def _heat_sql(mode: str) -> str:
    agg = "count(*)" if mode == "count" else "sum(peak_consumption)"
    zero = "0" if mode == "count" else "CAST(0 AS DOUBLE)"
    val = f"coalesce(c.value, {zero})"
    return f"""WITH c AS (SELECT month, hour, {agg} AS value FROM ({_LM}) l GROUP BY month, hour),
     g AS (SELECT m.month, CAST(r.range AS INTEGER) AS hour
           FROM (SELECT DISTINCT month FROM ({_LM}) l) m, range(24) r)
SELECT g.month, g.hour, {val if mode == 'count' else R(val)} AS value
FROM g LEFT JOIN c ON g.month = c.month AND g.hour = c.hour"""


def _tariff_heat_sql(mode: str) -> str:
    agg = "count(*)" if mode == "count" else "sum(peak_consumption)"
    zero = "0" if mode == "count" else "CAST(0 AS DOUBLE)"
    b = f"coalesce(b.value, {zero})"
    a = f"coalesce(a.value, {zero})"
    cols = (f"{b} AS before, {a} AS after, {a} - {b} AS diff" if mode == "count" else
            f"{R(b)} AS before, {R(a)} AS after, {R(f'{a} - {b}')} AS diff")
    return f"""WITH c AS (SELECT tariff_active, month, hour, {agg} AS value FROM ({_LM}) l GROUP BY ALL),
     g AS (SELECT m.month, CAST(r.range AS INTEGER) AS hour
           FROM (SELECT DISTINCT month FROM ({_LM}) l) m, range(24) r)
SELECT g.month, g.hour, {cols}
FROM g LEFT JOIN c b ON b.tariff_active = 0 AND g.month = b.month AND g.hour = b.hour
       LEFT JOIN c a ON a.tariff_active = 1 AND g.month = a.month AND g.hour = a.hour"""


ORACLE["peak_heatmap_count"] = _heat_sql("count")
ORACLE["peak_heatmap_consumption"] = _heat_sql("consumption")
ORACLE["tariff_peak_heatmap_count"] = _tariff_heat_sql("count")
ORACLE["tariff_peak_heatmap_consumption"] = _tariff_heat_sql("consumption")
ORACLE["tariff_peak_max"] = f"SELECT max(greatest(before, after)) AS vmax FROM ({_tariff_heat_sql('count')}) t"

_VALS = " UNION ALL ".join(
    f"SELECT peak{i}_consumption AS v FROM ({HIGH_E}) h WHERE peak{i}_consumption IS NOT NULL" for i in (1, 2, 3))
_B = "CAST(30 AS DOUBLE)"


def _edge(i: str) -> str:
    return f"(CASE WHEN {i} >= 30 THEN hi ELSE CAST({i} AS DOUBLE) * step + lo END)"


ORACLE["peak_histogram"] = f"""WITH v AS ({_VALS}),
     b AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
                  CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v),
     s AS (SELECT lo, hi, (hi - lo) / {_B} AS step FROM b),
     i0 AS (SELECT v.v, s.*, floor((v.v - lo) * ({_B} / (hi - lo))) AS i FROM v, s),
     i1 AS (SELECT v, lo, hi, step, CASE WHEN i >= 30 THEN 29 ELSE i END AS i FROM i0),
     i2 AS (SELECT v, lo, hi, step, CASE WHEN v < {_edge('i')} THEN i - 1 ELSE i END AS i FROM i1),
     i3 AS (SELECT CASE WHEN v >= {_edge('(i + 1)')} AND i <> 29 THEN i + 1 ELSE i END AS i FROM i2),
     c AS (SELECT CAST(i AS INTEGER) AS bin, count(*) AS n FROM i3 GROUP BY 1),
     ax AS (SELECT CAST(r.range AS INTEGER) AS bin, s.* FROM range(30) r, s)
SELECT ax.bin, {R(_edge('ax.bin'))} AS bin_start, {R(_edge('(ax.bin + 1)'))} AS bin_end,
       coalesce(c.n, 0) AS n
FROM ax LEFT JOIN c ON ax.bin = c.bin"""

ORACLE["peak_rank_box"] = f"""WITH p AS (SELECT rank, peak_consumption AS v FROM ({LONG_E}) l),
     q AS (SELECT rank, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
                  quantile_cont(v, 0.75) AS q3 FROM p GROUP BY rank),
     f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT CAST(f.rank AS INTEGER) AS rank, count(*) AS n, {R('f.q1')} AS q1, {R('f.median')} AS median,
       {R('f.q3')} AS q3, {R('f.iqr')} AS iqr,
       {R('min(p.v) FILTER (WHERE p.v >= f.lf AND p.v <= f.uf)')} AS whisker_low,
       {R('max(p.v) FILTER (WHERE p.v >= f.lf AND p.v <= f.uf)')} AS whisker_high,
       count(*) FILTER (WHERE NOT (p.v >= f.lf AND p.v <= f.uf)) AS n_outliers
FROM p JOIN f ON p.rank = f.rank GROUP BY f.rank, f.q1, f.median, f.q3, f.iqr"""


# ---------------------------------------------------------------- matching
_L = 12
_K = 5
MROWS = f"""SELECT CAST(aID AS VARCHAR) AS id, CAST(TIDPUNKT AS DATE) AS month,
       CAST(tariff_start AS DATE) AS adoption_month, CAST(top3_mean_consumption AS DOUBLE) AS v,
       CAST(tariff_active AS INTEGER) AS ord
FROM ({MONTHLY_L}) m WHERE price = 'all'"""
TIS = f"SELECT DISTINCT adoption_month AS Ti FROM ({MROWS}) r WHERE adoption_month IS NOT NULL"
WIN = f"""SELECT t.Ti, r.id, r.month, r.ord, r.v FROM ({MROWS}) r JOIN ({TIS}) t
  ON r.month >= CAST(t.Ti - INTERVAL {_L} MONTH AS DATE) AND r.month < t.Ti"""
TS_FEATS = [f"peak_{i}" for i in range(1, _L + 1)]
SUM_FEATS = ["peak_mean", "peak_sd", "peak_volatility"]


def prof_sql(mode: str) -> str:
    if mode == "time_series":
        cols = ", ".join(f"max(v) FILTER (WHERE pos = {i}) AS peak_{i}" for i in range(1, _L + 1))
        return f"""SELECT Ti, id, {cols} FROM (
  SELECT *, row_number() OVER (PARTITION BY Ti, id ORDER BY month, ord) AS pos,
         count(*) OVER (PARTITION BY Ti, id) AS n FROM ({WIN}) w) x
WHERE n >= {_L} GROUP BY Ti, id"""
    return f"""SELECT Ti, id, avg(v) AS peak_mean, stddev_samp(v) AS peak_sd, avg(step) AS peak_volatility FROM (
  SELECT *, abs(v - lag(v) OVER (PARTITION BY Ti, id ORDER BY month, ord)) AS step FROM ({WIN}) w) x
GROUP BY Ti, id HAVING count(*) >= {_L}"""


ADOPTERS = f"SELECT DISTINCT id, adoption_month FROM ({MROWS}) r WHERE adoption_month IS NOT NULL"
INFO = f"""SELECT id, max(CAST(adoption_month IS NULL AS INTEGER)) AS never, max(adoption_month) AS latest
FROM ({MROWS}) r GROUP BY id"""


def build_profiles_sql(mode: str) -> str:
    feats = TS_FEATS if mode == "time_series" else SUM_FEATS
    return f"""SELECT p.id, {', '.join('p.' + f for f in feats)}, p.Ti AS adoption_month
FROM ({prof_sql(mode)}) p JOIN ({ADOPTERS}) a ON p.id = a.id AND p.Ti = a.adoption_month"""


def matches_sql(mode: str, with_rank: bool = False) -> str:
    feats = TS_FEATS if mode == "time_series" else SUM_FEATS
    stats = ", ".join(f"avg({f}) AS mu_{f}, stddev_samp({f}) AS sd_{f}" for f in feats)

    def z(f: str) -> str:
        return (f"coalesce(CASE WHEN sd_{f} IS NOT NULL AND sd_{f} > 0 AND NOT isnan(sd_{f}) "
                f"THEN ({f} - mu_{f}) / sd_{f} END, CAST(0 AS DOUBLE))")
    cz = ", ".join(f"{z(f)} AS c_{f}" for f in feats)
    tz = ", ".join(f"{z(f)} AS t_{f}" for f in feats)
    dist = " + ".join(f"(c_{f} - t_{f}) * (c_{f} - t_{f})" for f in feats)
    return f"""WITH prof AS ({prof_sql(mode)}),
     controls AS (SELECT p.* FROM prof p JOIN ({INFO}) i ON p.id = i.id WHERE i.never = 1 OR i.latest > p.Ti),
     treated AS (SELECT p.* FROM prof p JOIN ({ADOPTERS}) a ON p.id = a.id AND p.Ti = a.adoption_month),
     st AS (SELECT Ti, {stats} FROM controls GROUP BY Ti),
     cz AS (SELECT c.Ti, c.id AS control_id, {cz} FROM controls c JOIN st ON c.Ti = st.Ti),
     tz AS (SELECT t.Ti, t.id AS treated_id, {tz} FROM treated t JOIN st ON t.Ti = st.Ti),
     pairs AS (SELECT tz.Ti, tz.treated_id, cz.control_id, sqrt({dist}) AS distance
               FROM tz JOIN cz ON tz.Ti = cz.Ti AND cz.control_id <> tz.treated_id),
     nn AS (SELECT *, row_number() OVER (PARTITION BY Ti, treated_id ORDER BY distance, control_id) AS neighbor
            FROM pairs)
SELECT c.id, {', '.join('c.' + f for f in feats)}, nn.control_id, nn.treated_id, nn.Ti AS adoption_month,
       nn.distance{', CAST(nn.neighbor AS INTEGER) AS neighbor' if with_rank else ''}
FROM nn JOIN controls c ON c.Ti = nn.Ti AND c.id = nn.control_id WHERE nn.neighbor <= {_K}"""


def balance_sql(mode: str) -> str:
    feats = TS_FEATS if mode == "time_series" else SUM_FEATS
    prof = build_profiles_sql(mode)
    m = matches_sql(mode)
    union = " UNION ALL ".join(
        f"SELECT g, '{f}' AS covariate, CAST({f} AS DOUBLE) AS value FROM both_rows" for f in feats)
    return f"""WITH prof AS ({prof}), m AS ({m}),
     both_rows AS (SELECT 1 AS g, p.* FROM prof p WHERE p.id IN (SELECT treated_id FROM m)
                   UNION ALL
                   SELECT 0 AS g, p.* FROM (SELECT control_id FROM m) mm LEFT JOIN prof p ON mm.control_id = p.id),
     l AS ({union}),
     s AS (SELECT covariate, avg(value) FILTER (WHERE g = 1) AS tm, avg(value) FILTER (WHERE g = 0) AS cm,
                  var_samp(value) FILTER (WHERE g = 1) AS vt, var_samp(value) FILTER (WHERE g = 0) AS vc
           FROM l GROUP BY covariate)
SELECT covariate, tm AS treated_mean, cm AS control_mean,
       CASE WHEN (vt + vc) / 2 > 0 THEN (tm - cm) / sqrt((vt + vc) / 2) END AS SMD FROM s"""


def _r_all(sql: str, doubles: list[str], others: list[str]) -> str:
    cols = others + [f"{R(c)} AS {c}" for c in doubles]
    return f"SELECT {', '.join(cols)} FROM ({sql}) q"


ORACLE["lookback_window"] = f"""SELECT Ti AS adoption_month, id, count(*) AS n_rows, min(month) AS first_month,
       max(month) AS last_month FROM ({WIN}) w GROUP BY Ti, id"""
ORACLE["risk_set"] = f"""SELECT t.Ti AS adoption_month, i.id AS control_id FROM ({INFO}) i JOIN ({TIS}) t
  ON i.never = 1 OR i.latest > t.Ti"""
ORACLE["profile_timeseries"] = _r_all(build_profiles_sql("time_series"), TS_FEATS, ["id", "adoption_month"])
ORACLE["profile_summary"] = _r_all(build_profiles_sql("summary"), SUM_FEATS, ["id", "adoption_month"])
ORACLE["match_timeseries"] = _r_all(matches_sql("time_series"), TS_FEATS + ["distance"],
                                    ["id", "control_id", "treated_id", "adoption_month"])
ORACLE["match_summary"] = _r_all(matches_sql("summary"), SUM_FEATS + ["distance"],
                                 ["id", "control_id", "treated_id", "adoption_month"])
ORACLE["knn_match"] = _r_all(f"SELECT * FROM ({matches_sql('time_series', True)}) x", ["distance"],
                             ["treated_id", "adoption_month", "control_id", "neighbor"])
ORACLE["balance_timeseries"] = _r_all(balance_sql("time_series"), ["treated_mean", "control_mean", "SMD"],
                                      ["covariate"])
ORACLE["balance_summary"] = _r_all(balance_sql("summary"), ["treated_mean", "control_mean", "SMD"],
                                   ["covariate"])
ORACLE["love_table"] = f"""SELECT covariate, {R('abs(SMD)')} AS abs_smd, abs(SMD) > 0.1 AS imbalanced
FROM ({balance_sql('time_series')}) b"""
