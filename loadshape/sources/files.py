"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from loadshape import schemas as S

_NANOS_CONF = "spark.sql.legacy.parquet.nanosAsLong"


def _utc_wall_clock(col: F.Column, dtype: T.DataType) -> F.Column:
    """Any timestamp representation -> UTC wall clock as timestamp_ntz. Zoned
    instants and nanoseconds go through microseconds since the epoch, so the
    session's zone plays no part and no hour repeats or is skipped."""
    if isinstance(dtype, T.TimestampNTZType):
        return col
    if isinstance(dtype, T.StringType):
        return F.to_timestamp_ntz(col)
    if isinstance(dtype, T.LongType):  # nanoseconds since epoch (pandas writer)
        micros = F.call_function("div", col - F.pmod(col, F.lit(1000)), F.lit(1000))
    else:
        micros = F.unix_micros(col.cast("timestamp"))
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)


def scan_meter(spark: SparkSession, path: str, local_tz: str | None = None) -> DataFrame:
    """Meter readings with the 4 columns of the study, times as UTC wall clock
    (the study's behaviour), or as the wall clock of ``local_tz`` (e.g.
    ``'Europe/Stockholm'``) so hour-based price periods follow local time.

    Parquet written by pandas stores nanosecond timestamps, which Spark
    rejects; such files are re-read with nanoseconds as long and converted.
    NaN readings become NULL (pandas skips NaN, Spark would propagate it).
    """
    try:
        raw = spark.read.parquet(path)
        raw.schema  # noqa: B018  (forces footer read)
    except AnalysisException as err:
        if "PARQUET_TYPE_ILLEGAL" not in str(err) and "NANOS" not in str(err).upper():
            raise
        spark.conf.set(_NANOS_CONF, "true")
        raw = spark.read.parquet(path)
    fields = {f.name: f.dataType for f in raw.schema.fields}
    ts = _utc_wall_clock(F.col(S.TS), fields[S.TS])
    if local_tz is not None:
        ts = F.convert_timezone(F.lit("UTC"), F.lit(local_tz), ts)
    day = F.col(S.DAY).cast("date") if S.DAY in fields and local_tz is None else F.to_date(ts)
    v = F.col(S.VALUE).cast("double")
    return raw.select(
        F.col(S.ID).cast("string").alias(S.ID),
        ts.alias(S.TS),
        day.alias(S.DAY),
        F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v).alias(S.VALUE),
    )


def scan_tariff_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw tariff CSV (header, comma) with an explicit all-string-id schema."""
    return (spark.read.schema(S.TARIFF_RAW_SCHEMA).option("header", True)
            .option("dateFormat", "yyyy-MM-dd").csv(path))


def scan_survey_csv(spark: SparkSession, path: str) -> DataFrame:
    """Survey CSV; read for completeness, no operator consumes it."""
    return spark.read.schema(S.SURVEY_SCHEMA).option("header", True).csv(path)


def scan_holidays_csv(spark: SparkSession, path: str) -> DataFrame:
    """Holiday calendar CSV with header ``date,name`` (dates ``yyyy-MM-dd``)."""
    return (spark.read.schema(S.HOLIDAY_SCHEMA).option("header", True)
            .option("dateFormat", "yyyy-MM-dd").csv(path))


def scan_aggregate(spark: SparkSession, path: str) -> DataFrame:
    """Household-period aggregate written by :func:`write_aggregate`."""
    return spark.read.parquet(path)


def write_aggregate(df: DataFrame, path: str, partition_by_price: bool = True) -> None:
    """Parquet sink. Partitioned by ``price`` because every consumer filters
    on it, so those reads prune to one directory."""
    w = df.write.mode("overwrite")
    if partition_by_price and S.PRICE in df.columns:
        w = w.partitionBy(S.PRICE)
    w.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_small_csv(df: DataFrame, path: str) -> None:
    """CSV sink for small diagnostic tables (a handful of rows): one file, header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def dataset_profile(meter: DataFrame) -> DataFrame:
    """Row count, distinct households, distinct days (one row)."""
    return meter.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(S.ID).alias("n_households"),
        F.countDistinct(S.DAY).alias("n_days"),
    )


def preview(df: DataFrame, n: int, *order_cols: str) -> DataFrame:
    """Deterministic head(n)."""
    return df.orderBy(*order_cols).limit(n) if order_cols else df.limit(n)
