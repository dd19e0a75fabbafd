import pytest
from pyspark.sql import functions as F

from study_values import d
from loadshape.operators import adoption as AD
from loadshape.operators import curves as CV


def test_adoption_gap_filled_running_share(tariff_df):
    t = tariff_df([("a", "2025-03-01", "Kvällsplan 6 kW Villa"),
                   ("b", "2025-03-20", "Kvällsplan 14 kW Villa"),
                   ("c", "2025-06-02", "Kvällsplan 6 kW Villa"),
                   ("d", "2025-06-03", "Fast pris")])
    monthly = {r.month: r.households for r in AD.monthly_adoption(t).collect()}
    assert monthly == {"2025-03": 2, "2025-06": 2}                 # no gap filling
    share = AD.adoption_share(t, 10).orderBy("month").collect()
    assert [r.month for r in share] == [d("2025-03-01"), d("2025-04-01"), d("2025-05-01"), d("2025-06-01")]
    assert [r.cumulative for r in share] == [2, 2, 2, 4]
    assert [r.share for r in share] == [0.2, 0.2, 0.2, 0.4]
    cum = {(r.month, r.tariff_plan): r.cumulative for r in AD.plan_cumulative(t).collect()}
    assert cum[(d("2025-04-01"), "14 kW Villa")] == 1 and cum[(d("2025-06-01"), "6 kW Villa")] == 2
    assert len(cum) == 8                                            # 4 months x 2 plans, 0-filled
    counts = [(r.tariff_group, r.households) for r in AD.plan_counts(t).collect()]
    assert counts[0] == ("Kvällsplan 6 kW Villa", 2)


def test_adoption_by_usage_keeps_all_groups(spark):
    df = spark.createDataFrame([("a", "low", 1), ("a", "low", 0), ("b", "low", 0), ("c", "high", 1)],
                               "aID string, usage_group string, tariff_active int")
    got = {r.usage_group: r.share for r in CV.adoption_by_usage(df).collect()}
    assert got == {"low": pytest.approx(1 / 3), "medium": None, "high": 1.0}
    per_hh = {r.usage_group: r.share for r in CV.adoption_by_usage(df, per_household=True).collect()}
    assert per_hh == {"low": 0.5, "medium": None, "high": 1.0}


def test_curve_split_drops_all_price(spark):
    df = spark.createDataFrame([(1, "all", 0, 9.0), (1, "high", 0, 2.0), (1, "low", 1, 4.0)],
                               "TIDPUNKT int, price string, tariff_active int, v double")
    r = CV.consumption_curve(df, "v", splits=["price", "tariff_active"],
                             split_values=[["high", "low"], [0, 1]]).first()
    assert (r.high_0, r.high_1, r.low_0, r.low_1) == (2.0, None, None, 4.0)
    with pytest.raises(ValueError):
        CV.consumption_curve(df, "v", agg="mode")


def test_event_study_window(spark):
    df = spark.createDataFrame(
        [(d("2024-01-01"), d("2025-01-10"), "low", 1.0), (d("2025-02-01"), d("2025-01-10"), "low", 3.0),
         (d("2023-12-01"), d("2025-01-10"), "low", 5.0), (d("2025-02-01"), None, "low", 7.0)],
        "TIDPUNKT date, tariff_start date, usage_group string, v double")
    got = {(r.event_time, r.usage_group): r.mean_value for r in CV.event_study(df, "v", window=12).collect()}
    assert got == {(-12, "low"): 1.0, (1, "low"): 3.0}


def test_curve_without_split_values_is_long(spark):
    df = spark.createDataFrame([(1, "all", 0, 9.0), (1, "high", 0, 2.0), (1, "low", 1, 4.0), (2, "low", 0, 6.0), (2, None, 0, 1.0)],
                               "TIDPUNKT int, price string, tariff_active int, v double")
    out = CV.consumption_curve(df, "v", splits=["price", "tariff_active"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, "high", 0, 2.0), (1, "low", 1, 4.0), (2, "low", 0, 6.0)]


def test_event_study_several_lines(spark):
    rows = [("a_b", "c", 3.0), ("a", "b_c", 5.0), ("low", None, 7.0), (None, "c", 9.0)]
    df = spark.createDataFrame([(d("2025-02-01"), d("2025-01-10"), *r) for r in rows],
                               "TIDPUNKT date, tariff_start date, usage_group string, tariff_plan string, v double")
    cols = ["usage_group", "tariff_plan"]
    long = CV.event_study(df, "v", cols, 12).collect()
    assert sorted(tuple(r) for r in long) == [(1, "a", "b_c", 5.0), (1, "a_b", "c", 3.0)]
    wide = CV.event_study(df, "v", cols, 12, line_values=[("a_b", "c"), ("x", "y")]).first()
    assert (wide.event_time, wide["a_b_c"], wide["x_y"]) == (1, 3.0, None)
