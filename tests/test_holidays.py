"""The computed calendar against dates known from printed ones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loadshape.functions.holidays import easter_sunday, holiday_calendar, holiday_name
from loadshape.operators.aggregate import with_price_part
from study_values import d


def test_easter_sundays(spark):
    known = {1818: "1818-03-22", 1943: "1943-04-25", 1954: "1954-04-18", 1961: "1961-04-02", 1981: "1981-04-19", 2000: "2000-04-23",
             2008: "2008-03-23", 2011: "2011-04-24", 2016: "2016-03-27", 2019: "2019-04-21", 2024: "2024-03-31", 2025: "2025-04-20",
             2026: "2026-04-05", 2038: "2038-04-25", 2049: "2049-04-18", 2076: "2076-04-19", 2100: "2100-03-28", 2285: "2285-03-22"}
    rows = spark.createDataFrame([(y,) for y in known], "y int").select("y", easter_sunday(F.col("y")).alias("e")).collect()
    assert {r.y: r.e.isoformat() for r in rows} == known


def test_every_easter_is_the_first_sunday_after_its_full_moon(spark):
    rows = spark.range(1900, 2100).select(F.col("id").cast("int").alias("y")).select("y", easter_sunday(F.col("y")).alias("e")).collect()
    for y, e in rows:                           # the century rule for 1900 to 2099
        n = 225 - 11 * (y % 19)
        while n > 50:
            n -= 30
        n -= n > 48
        q = n + 7 - (y + y // 4 + n + 1) % 7
        assert e == dt.date(y, 3, 1) + dt.timedelta(q - 1) and e.weekday() == 6, y


def test_a_year_of_sweden(spark):
    got = {r.date.isoformat(): r.name for r in holiday_calendar(spark, 2025, 2025).collect()}
    assert got == {
        "2025-01-01": "Nyårsdagen", "2025-01-06": "Trettondedag jul", "2025-04-18": "Långfredagen", "2025-04-20": "Påskdagen",
        "2025-04-21": "Annandag påsk", "2025-05-01": "Första maj", "2025-05-29": "Kristi himmelsfärdsdag",
        "2025-06-06": "Sveriges nationaldag", "2025-06-08": "Pingstdagen", "2025-06-20": "Midsommarafton", "2025-06-21": "Midsommardagen",
        "2025-11-01": "Alla helgons dag", "2025-12-24": "Julafton", "2025-12-25": "Juldagen", "2025-12-26": "Annandag jul",
        "2025-12-31": "Nyårsafton"}


def test_rules_change_with_the_years_and_names_may_meet(spark):
    got = {r.date.isoformat(): r.name for r in holiday_calendar(spark, 2004, 2008).collect()}
    assert got["2004-05-31"] == "Annandag pingst" and "2005-05-16" not in got
    assert "2004-06-06" not in got and got["2005-06-06"] == "Sveriges nationaldag"
    assert got["2008-05-01"] == "Första maj; Kristi himmelsfärdsdag"
    assert got["2006-11-04"] == "Alla helgons dag"


def test_null_day_and_unknown_country(spark):
    assert spark.createDataFrame([(None,)], "day date").select(holiday_name(F.col("day"))).first()[0] is None
    with pytest.raises(ValueError):
        holiday_name(F.col("day"), "XX")


def test_price_parts_follow_the_country(spark, meter_df):
    m = meter_df([("a", "2025-01-06 10:00", 1.0), ("a", "2025-01-07 10:00", 1.0), ("a", "2025-12-24 10:00", 1.0), ("a", "2025-06-20 10:00", 1.0)])
    got = {r[0].date(): r[1] for r in with_price_part(m, "SE").select("TIDPUNKT", "_hl").collect()}
    assert got == {d("2025-01-06"): "low", d("2025-01-07"): "high", d("2025-12-24"): "low", d("2025-06-20"): "low"}
    plan = with_price_part(m, "SE")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
