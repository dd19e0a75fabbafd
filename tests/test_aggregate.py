import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from study_values import ts
from loadshape.operators import aggregate as A


def _rows(df):
    return {(r["aID"], r["price"], r["tariff_active"]): r for r in df.collect()}


def _rows_p(df):
    return {(r["aID"], r["period"], r["price"], r["tariff_active"]): r for r in df.collect()}


def test_top3_ties_and_missing_peaks(meter_df):
    m = meter_df([
        # day 1: two hours share the maximum -> the earlier hour is the peak
        ("a", "2025-04-01 08:00", 5.0), ("a", "2025-04-01 09:00", 5.0), ("a", "2025-04-01 10:00", 1.0),
        # day 2 and 3 share a peak value -> the earlier date ranks first
        ("a", "2025-04-02 12:00", 7.0), ("a", "2025-04-03 13:00", 7.0),
        ("a", "2025-04-04 13:00", 2.0),
        # household b has only two days -> peak3 is missing
        ("b", "2025-04-01 10:00", 3.0), ("b", "2025-04-02 11:00", 4.0),
    ])
    out = _rows(A.aggregate(m, "month", ["top3_mean"], use_price=False))
    a = out[("a", "all", 0)]
    assert (a.peak1_consumption, a.peak2_consumption, a.peak3_consumption) == (7.0, 7.0, 5.0)
    assert a.peak1_time == ts("2025-04-02 12:00") and a.peak2_time == ts("2025-04-03 13:00")
    assert a.peak3_time == ts("2025-04-01 08:00")
    assert a.top3_mean_consumption == pytest.approx(19.0 / 3)
    b = out[("b", "all", 0)]
    assert b.peak3_consumption is None and b.peak3_time is None
    assert b.top3_mean_consumption == pytest.approx(3.5)


def test_single_reading_variance_null_and_all_null_sum_zero(meter_df):
    m = meter_df([("a", "2025-04-01 08:00", 2.0), ("n", "2025-04-01 08:00", None),
                  ("n", "2025-04-01 09:00", None)])
    for strategy in ("auto", "explode"):
        out = _rows(A.aggregate(m, "month", ["sum", "mean", "variance", "max"], False, strategy=strategy))
        assert out[("a", "all", 0)].variance_consumption is None
        n = out[("n", "all", 0)]
        assert n.sum_consumption == 0.0 and n.mean_consumption is None and n.max_consumption is None


def test_nan_becomes_null_on_scan(spark, tmp_path):
    from loadshape.sources.files import scan_meter
    pdf = pd.DataFrame({"aID": ["a", "a"], "TIDPUNKT": pd.to_datetime(["2025-01-01 01:00", "2025-01-01 02:00"],
                                                                       utc=True),
                        "TIDPUNKT_DAG": [pd.Timestamp("2025-01-01").date()] * 2,
                        "FORBRUKNING_KWH": [float("nan"), 2.0]})
    path = str(tmp_path / "meter.parquet")
    pdf.to_parquet(path)  # pandas writes nanosecond timestamps
    m = scan_meter(spark, path)
    assert m.schema["TIDPUNKT"].dataType.typeName() == "timestamp_ntz"
    rows = sorted(m.collect(), key=lambda r: r.TIDPUNKT)
    assert rows[0].TIDPUNKT == ts("2025-01-01 01:00") and rows[0].FORBRUKNING_KWH is None
    out = _rows(A.aggregate(m, "day", ["mean", "sum"], False))
    assert out[("a", "all", 0)].mean_consumption == 2.0


def _random_meter(meter_df, seed=7, households=5, days=40):
    rnd = random.Random(seed)
    rows = []
    for h in range(households):
        for dd in range(days):
            for hour in range(0, 24, 3):
                t = f"2024-{1 + dd // 28:02d}-{1 + dd % 28:02d} {hour:02d}:00"
                v = None if rnd.random() < 0.03 else round(rnd.uniform(0, 9), 2)
                rows.append((f"h{h}", t, v))
    return meter_df(rows)


@pytest.mark.parametrize("freq", ["week", "month", "hour", "week_part"])
def test_strategies_agree(meter_df, freq):
    m = _random_meter(meter_df).withColumn("tariff_active", (F.dayofmonth("TIDPUNKT") > 14).cast("int"))
    methods = ["sum", "mean", "variance", "max", "median", "q90", "top3_mean"]
    results = [_rows_p(A.aggregate(m, freq, methods, True, strategy=s))
               for s in ("auto", "explode", "grouping_sets")]
    assert results[0].keys() == results[1].keys() == results[2].keys()
    for key, r0 in results[0].items():
        for other in results[1:]:
            r1 = other[key]
            for c in ("sum_consumption", "mean_consumption", "variance_consumption", "max_consumption",
                      "median_consumption", "q90_consumption", "top3_mean_consumption"):
                a, b = r0[c], r1[c]
                assert (a is None and b is None) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), (key, c)


def test_price_parts_partition_all(meter_df):
    m = _random_meter(meter_df, seed=3)
    out = A.aggregate(m, "month", ["sum"], True).groupBy("aID", "period").pivot(
        "price", ["all", "high", "low"]).agg(F.first("sum_consumption"))
    for r in out.collect():
        assert r["all"] == pytest.approx((r["high"] or 0.0) + (r["low"] or 0.0))


def test_peaks_are_ordered(meter_df):
    m = _random_meter(meter_df, seed=11)
    for r in A.aggregate(m, "month", ["top3_mean"], True).collect():
        vals = [v for v in (r.peak1_consumption, r.peak2_consumption, r.peak3_consumption) if v is not None]
        assert vals == sorted(vals, reverse=True)


def test_matches_direct_pandas_computation(meter_df):
    """Month / top-3 and median against a direct pandas computation."""
    m = _random_meter(meter_df, seed=5)
    pdf = m.toPandas().dropna(subset=["FORBRUKNING_KWH"])
    pdf["month"] = pdf["TIDPUNKT"].dt.to_period("M").dt.to_timestamp()
    pdf["date"] = pdf["TIDPUNKT"].dt.date
    idx = pdf.groupby(["aID", "month", "date"])["FORBRUKNING_KWH"].idxmax()
    daily = pdf.loc[idx].sort_values(["aID", "month", "FORBRUKNING_KWH"], ascending=[True, True, False],
                                     kind="stable")
    top = daily.groupby(["aID", "month"]).head(3).groupby(["aID", "month"])["FORBRUKNING_KWH"].mean()
    med = pdf.groupby(["aID", "month"])["FORBRUKNING_KWH"].median()
    out = A.aggregate(m, "month", ["top3_mean", "median"], False).collect()
    assert len(out) == len(top)
    for r in out:
        key = (r.aID, pd.Timestamp(r.period))
        assert r.top3_mean_consumption == pytest.approx(top[key])
        assert r.median_consumption == pytest.approx(med[key])


@pytest.mark.parametrize("method", ["qx", "q200", "mode"])
def test_bad_methods(method):
    with pytest.raises(ValueError):
        A.normalize_methods([method])


def test_missing_keys_are_dropped(spark):
    from loadshape import schemas as S
    m = spark.createDataFrame([("a", ts("2025-04-01 08:00"), None, 1.0), ("a", None, None, 5.0),
                               (None, ts("2025-04-01 09:00"), None, 7.0)], S.METER_SCHEMA)
    for strategy in ("auto", "explode"):
        out = A.aggregate(m, "hour", ["sum", "median", "top3_mean"], False, strategy=strategy).collect()
        assert [(r.aID, r.period, r.sum_consumption, r.median_consumption) for r in out] == [("a", 8, 1.0, 1.0)]


def test_local_time_option(spark, tmp_path):
    from loadshape.sources.files import scan_meter
    pdf = pd.DataFrame({"aID": ["a", "a"],
                        "TIDPUNKT": pd.to_datetime(["2025-01-15 06:00", "2025-07-15 06:00"], utc=True),
                        "TIDPUNKT_DAG": [pd.Timestamp("2025-01-15").date(), pd.Timestamp("2025-07-15").date()],
                        "FORBRUKNING_KWH": [1.0, 2.0]})
    path = str(tmp_path / "m.parquet")
    pdf.to_parquet(path)
    utc = sorted(r.TIDPUNKT for r in scan_meter(spark, path).collect())
    local = sorted(r.TIDPUNKT for r in scan_meter(spark, path, "Europe/Stockholm").collect())
    assert [t.hour for t in utc] == [6, 6]
    assert [t.hour for t in local] == [7, 8]           # CET in winter, CEST in summer


def test_hot_groups_take_the_distributed_path(meter_df):
    m = _random_meter(meter_df, seed=13, households=3, days=30)
    normal = {(r.aID, r.period, r.price): (r.median_consumption, r.q90_consumption, r.sum_consumption)
              for r in A.aggregate(m, "week", ["median", "q90", "sum"], True).collect()}
    hot = {(r.aID, r.period, r.price): (r.median_consumption, r.q90_consumption, r.sum_consumption)
           for r in A.aggregate(m, "week", ["median", "q90", "sum"], True, single_task_max=20).collect()}
    assert normal.keys() == hot.keys()
    for k, v in normal.items():
        assert hot[k] == pytest.approx(v, rel=1e-12)


def test_quantiles_agree_on_both_sides_of_the_limit(spark):
    from loadshape.functions.stats import exact_quantiles, grouped_quantiles
    nan = float("nan")
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0, nan, None)] + [("z", 0.0)] * 200 + [("z", float(i)) for i in range(1, 101)] + [("n", nan)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.5, 0.1, 0.731]
    plain = sorted(map(str, grouped_quantiles(df, ["k"], "v", probs).where("_q0 is not null").collect()))
    split = sorted(map(str, grouped_quantiles(df, ["k"], "v", probs, single_task_max=1).where("_q0 is not null").collect()))
    assert plain == split and "_q0=2.5" in plain[0]
    one = [r.quantile for r in exact_quantiles(df, "v", probs).orderBy("q_index").collect()]
    two = [r.quantile for r in exact_quantiles(df, "v", probs, single_task_max=None).orderBy("q_index").collect()]
    assert one == two


def test_groups_do_not_depend_on_the_method_list(meter_df):
    rows = meter_df([("h1", "2025-01-01 10:00", None), ("h2", "2025-01-01 10:00", 2.0)])
    for methods in (["top3_mean"], ["mean"], ["top3_mean", "mean"], ["sum", "max", "variance"]):
        got = A.aggregate(rows, "month", methods, use_price=False).collect()
        assert sorted(r.aID for r in got) == ["h1", "h2"], methods


def test_direct_and_exploded_aggregates_agree(meter_df):
    rows = meter_df([(f"h{i % 3}", f"2025-0{1 + i % 2}-{1 + i % 28:02d} {i % 24:02d}:00", None if i % 11 == 0 else i * 0.5) for i in range(200)])
    methods = ["sum", "mean", "max", "variance"]
    for price in (True, False):
        key = lambda r: (r.aID, str(r.period), r.price, r.tariff_active)
        a = sorted(A.aggregate(rows, "month", methods, price).collect(), key=key)
        b = sorted(A.aggregate(rows, "month", methods, price, strategy="explode").collect(), key=key)
        assert [key(r) for r in a] == [key(r) for r in b]
        for x, y in zip(a, b):
            assert [x[f"{m}_consumption"] for m in methods] == pytest.approx([y[f"{m}_consumption"] for m in methods])


@pytest.mark.parametrize("zone", ["UTC", "Europe/Stockholm", "America/New_York"])
def test_zoned_times_keep_every_hour(spark, tmp_path, zone):
    import datetime as dt

    from loadshape.sources.files import scan_meter
    start = [dt.datetime(2025, 10, 25, 22), dt.datetime(2025, 3, 29, 22), dt.datetime(1969, 12, 31, 22)]   # repeated, skipped hour, before 1970
    want = [s + dt.timedelta(hours=i, microseconds=7) for s in start for i in range(8)]
    path = str(tmp_path / "zoned")
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        micros = [int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) for t in want]
        (spark.createDataFrame([(m,) for m in micros], "m long")
         .select(F.lit("h").alias("aID"), F.timestamp_micros("m").alias("TIDPUNKT"), F.lit(1.0).alias("FORBRUKNING_KWH"))
         .write.parquet(path))
        assert sorted(r.TIDPUNKT for r in scan_meter(spark, path).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_peaks_are_hash_aggregated_and_keep_ties(spark, meter_df):
    m = meter_df([("a", "2025-01-07 09:30", -2.5), ("a", "2025-01-07 08:00", -2.5), ("a", "2025-01-07 20:00", -3.0),
                  ("a", "2025-01-08 00:00", 0.1), ("a", "2025-01-08 23:59", 0.1), ("b", "2025-01-08 10:00", None), ("b", "2025-01-09 10:00", 0.0)])
    got = {(r.aID, r.price, r.day.day): (r.peak_consumption, r.peak_time) for r in A.daily_peaks(m, "month", True, keep_empty=True).collect()}
    assert got[("a", "high", 7)] == (-2.5, ts("2025-01-07 08:00")) == got[("a", "all", 7)]
    assert got[("a", "low", 7)] == (-3.0, ts("2025-01-07 20:00"))
    assert got[("a", "all", 8)] == (0.1, ts("2025-01-08 00:00")) == got[("a", "low", 8)]
    assert got[("b", "all", 8)] == (None, None) and got[("b", "all", 9)] == (0.0, ts("2025-01-09 10:00"))
    for df in (A.daily_peaks(m, "month", True), A.daily_table(m, "month", True), A.aggregate(m, "month", ["top3_mean", "variance", "mean"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
