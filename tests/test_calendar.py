import pytest
from pyspark.sql import functions as F

from study_values import d, ts
from loadshape.functions.calendar import event_time, period_key, price_label


def _one(spark, expr, t):
    return spark.createDataFrame([(ts(t),)], "t timestamp_ntz").select(expr(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize("freq,t,expected", [
    ("day", "2025-01-05 13:00", ts("2025-01-05 00:00")),
    ("week", "2025-01-05 13:00", ts("2024-12-30 00:00")),   # Sunday -> previous Monday
    ("week", "2025-01-06 00:00", ts("2025-01-06 00:00")),   # Monday starts the week
    ("month", "2025-03-31 23:00", ts("2025-03-01 00:00")),
    ("quarter", "2025-05-17 08:00", ts("2025-04-01 00:00")),
    ("year", "2025-12-31 23:00", ts("2025-01-01 00:00")),
    ("hour", "2025-01-05 13:00", 13),
    ("weekday", "2025-01-05 13:00", 6),                    # Sunday
    ("weekday", "2025-01-06 13:00", 0),                    # Monday
    ("week_part", "2025-01-04 10:00", "weekend"),
    ("week_part", "2025-01-03 10:00", "weekday"),
])
def test_period_key(spark, freq, t, expected):
    assert _one(spark, lambda c: period_key(c, freq), t) == expected


def test_unknown_freq_raises():
    with pytest.raises(ValueError, match="Invalid freq"):
        period_key("TIDPUNKT", "fortnight")


@pytest.mark.parametrize("t,expected", [
    ("2025-01-08 06:00", "low"), ("2025-01-08 07:00", "high"),
    ("2025-01-08 19:00", "high"), ("2025-01-08 20:00", "low"),
    ("2025-01-10 12:00", "high"),   # Friday
    ("2025-01-11 12:00", "low"),    # Saturday
    ("2025-03-31 12:00", "high"),   # Monday, last winter day
    ("2025-04-01 12:00", "low"),    # Tuesday, April
    ("2024-10-31 12:00", "low"),    # Thursday, October
    ("2024-11-01 12:00", "high"),   # Friday, November
])
def test_price_boundaries(spark, t, expected):
    assert _one(spark, lambda c: price_label(c), t) == expected


def test_holiday_switch(spark, meter_df):
    from loadshape.operators.aggregate import with_price_part
    from loadshape.sources.driver_views import holidays
    m = meter_df([("a", "2024-01-01 10:00", 1.0), ("a", "2024-01-06 10:00", 1.0),
                  ("a", "2024-01-02 10:00", 1.0)])
    without = {r[0]: r[1] for r in with_price_part(m).select(F.to_date("TIDPUNKT"), "_hl").collect()}
    with_h = {r[0]: r[1] for r in with_price_part(m, holidays(spark))
              .select(F.to_date("TIDPUNKT"), "_hl").collect()}
    assert without[d("2024-01-01")] == "high" and with_h[d("2024-01-01")] == "low"
    assert without[d("2024-01-06")] == with_h[d("2024-01-06")] == "low"   # Saturday anyway
    assert with_h[d("2024-01-02")] == "high"


def test_event_time(spark):
    df = spark.createDataFrame([(ts("2024-03-01 00:00"), d("2025-01-15"))], "t timestamp_ntz, s date")
    assert df.select(event_time("t", "s")).first()[0] == -10


def test_holiday_csv_source(spark, tmp_path):
    from loadshape.sources.files import scan_holidays_csv
    p = tmp_path / "holidays.csv"
    p.write_text("date,name\n2024-01-01,Nyarsdagen\n2024-12-25,Juldagen\n")
    got = sorted(r.date for r in scan_holidays_csv(spark, str(p)).collect())
    assert got == [d("2024-01-01"), d("2024-12-25")]
