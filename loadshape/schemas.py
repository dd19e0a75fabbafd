"""Input / intermediate schemas and canonical column names."""

from __future__ import annotations


from pyspark.sql import types as T

# Canonical column names used by every operator (the meter file's own names).
ID = "aID"
TS = "TIDPUNKT"
DAY = "TIDPUNKT_DAG"
VALUE = "FORBRUKNING_KWH"
START = "tariff_start"
PLAN = "tariff_plan"
ACTIVE = "tariff_active"
HAS = "has_tariff"
PRICE = "price"
PERIOD = "period"

METER_SCHEMA = T.StructType(
    [
        T.StructField(ID, T.StringType()),
        T.StructField(TS, T.TimestampNTZType()),
        T.StructField(DAY, T.DateType()),
        T.StructField(VALUE, T.DoubleType()),
    ]
)

# Raw tariff CSV: the id column has a dot in its name and must never be inferred
# (inference turns the 18-digit id into a number).
TARIFF_RAW_SCHEMA = T.StructType(
    [
        T.StructField("Produktnamn", T.StringType()),
        T.StructField("Startdatum", T.DateType()),
        T.StructField("GS1-nr.", T.StringType()),
    ]
)

TARIFF_SCHEMA = T.StructType(
    [
        T.StructField(ID, T.StringType()),
        T.StructField(START, T.DateType()),
        T.StructField(PLAN, T.StringType()),
    ]
)

SURVEY_SCHEMA = T.StructType(
    [
        T.StructField("Respondent", T.StringType()),
        T.StructField("Respondent_ID", T.LongType()),
        T.StructField("Answer_created", T.TimestampType()),
        T.StructField("Answer_completed", T.TimestampType()),
        T.StructField("Vilket_kön", T.StringType()),
        T.StructField("Id", T.StringType()),
    ]
)

HOLIDAY_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("name", T.StringType())]
)

FREQUENCIES = ("day", "week", "month", "quarter", "year", "hour", "week_part", "weekday")
