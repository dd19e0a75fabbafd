"""Stand-in meter / tariff / holiday inputs built from the driver's test tables.

The test tables have no meter or tariff files, so the study's inputs are
mapped onto them with plain expressions (the DuckDB oracle builds the same
views with the same rules):

* hourly-grain meter (hour, weekday, price periods): ``events`` -- id =
  ``user_id``, time = ``ts``, value = ``value``;
* multi-year meter (month/quarter/year, top-3 peaks, profiles, matching):
  ``lineitem`` -- id = ``l_suppkey``, time = ``l_shipdate``, value =
  ``l_extendedprice``;
* tariff lists: the adopters are the households whose id is a multiple of 5
  (this defines *who adopts*; every meter row is still processed); start
  dates and plan names follow fixed rules;
* holidays: two literal dates in January 2024.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadshape import schemas as S

# Fixed values of the stand-in mapping (shared with the oracle SQL).
ADOPTER_EVERY = 5
LINEITEM_FIRST_START = "1998-01-01"
LINEITEM_START_MONTHS = 7      # start = first start + (id % 7) months
EVENTS_FIRST_START = "2024-01-01"
EVENTS_START_DAYS = 20         # start = first start + (id % 20) days
# Invented plan names that fit the plan pattern.
PLAN_EVEN = "Kvällsplan 5 kW Villa"
PLAN_ODD = "Kvällsplan 11 kW Normal"
HOLIDAYS = (("2024-01-01", "Nyårsdagen"), ("2024-01-06", "Trettondedag jul"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _meter(df: DataFrame, id_col: str, ts_col: str, value_col: str) -> DataFrame:
    ts = F.col(ts_col).cast("timestamp_ntz")
    return df.select(
        F.col(id_col).cast("string").alias(S.ID),
        ts.alias(S.TS),
        F.to_date(ts).alias(S.DAY),
        F.col(value_col).cast("double").alias(S.VALUE),
    )


def lineitem_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meter(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate", "l_extendedprice")


def events_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meter(table(spark, sf_dir, "events"), "user_id", "ts", "value")


def _plan_name(key: F.Column) -> F.Column:
    return F.when(key % 2 == 0, F.lit(PLAN_EVEN)).otherwise(F.lit(PLAN_ODD))


def _raw_tariff(keys: DataFrame, key: str, start: F.Column) -> DataFrame:
    k = F.col(key)
    return keys.where(k % ADOPTER_EVERY == 0).select(
        _plan_name(k).alias("Produktnamn"),
        start.alias("Startdatum"),
        k.cast("string").alias("GS1-nr."),
    )


def lineitem_tariff_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tariff list (raw CSV column names) for the ``lineitem`` meter."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey")
    start = F.add_months(F.lit(LINEITEM_FIRST_START).cast("date"),
                         (F.col("s_suppkey") % LINEITEM_START_MONTHS).cast("int"))
    return _raw_tariff(sup, "s_suppkey", start)


def events_tariff_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tariff list (raw CSV column names) for the ``events`` meter."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    start = F.date_add(F.lit(EVENTS_FIRST_START).cast("date"),
                       (F.col("user_id") % EVENTS_START_DAYS).cast("int"))
    return _raw_tariff(users, "user_id", start)


def holidays(spark: SparkSession) -> DataFrame:
    """Holiday dimension (date, name); a calendar, so bounded by days in the data."""
    return spark.createDataFrame(
        [(dt.date.fromisoformat(d), n) for d, n in HOLIDAYS], schema=S.HOLIDAY_SCHEMA)
