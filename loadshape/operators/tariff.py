"""Tariff normalisation, the meter/tariff join and the adoption flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadshape import schemas as S
from loadshape.functions.text import PLAN_PATTERN, plan_token
from loadshape.plans.hints import broadcast_if_small


def normalize_tariff(raw: DataFrame) -> DataFrame:
    """Raw tariff columns -> ``aID`` (string), ``tariff_start`` (date), ``tariff_plan``."""
    return raw.select(
        F.col("`GS1-nr.`").cast("string").alias(S.ID),
        F.to_date(F.col("Startdatum")).alias(S.START),
        F.col("Produktnamn").cast("string").alias(S.PLAN),
    )


def dedup_tariff(tariff: DataFrame) -> DataFrame:
    """One tariff row per household: the earliest start (ties: smallest plan).

    Done as an aggregate (``min`` of a struct) rather than a window so a
    household with many rows is pre-reduced map-side.
    """
    best = F.min(F.struct(
        F.col(S.START).isNull().alias("_no_start"), F.col(S.START).alias(S.START),
        F.col(S.PLAN).alias(S.PLAN)))
    return tariff.groupBy(S.ID).agg(best.alias("_t")).select(
        S.ID, F.col(f"_t.{S.START}").alias(S.START), F.col(f"_t.{S.PLAN}").alias(S.PLAN))


def tariff_side(tariff: DataFrame) -> DataFrame:
    """Deduplicated tariff, broadcast-hinted only after a row-count check
    (one small job); reuse the result for every join of one plan."""
    return broadcast_if_small(dedup_tariff(tariff))


def join_tariff(meter: DataFrame, tariff: DataFrame | None,
                side: DataFrame | None = None) -> DataFrame:
    """Meter LEFT JOIN (deduplicated) tariff on ``aID`` plus the two flags.

    ``has_tariff`` = a start date exists; ``tariff_active`` = has tariff and
    the reading time is at or after the start. No tariff table -> both 0.
    The tariff side is broadcast only after a row-count check; pass a
    prepared ``side`` (:func:`tariff_side`) to skip repeating it.
    """
    if tariff is None and side is None:
        return meter.withColumn(S.START, F.lit(None).cast("date")) \
            .withColumn(S.PLAN, F.lit(None).cast("string")) \
            .withColumn(S.HAS, F.lit(0)).withColumn(S.ACTIVE, F.lit(0))
    t = side if side is not None else tariff_side(tariff)
    joined = meter.join(t, S.ID, "left")
    has = F.col(S.START).isNotNull()
    active = has & (F.col(S.TS) >= F.col(S.START).cast("timestamp_ntz"))
    return joined.withColumn(S.HAS, has.cast("int")) \
        .withColumn(S.ACTIVE, F.when(active, F.lit(1)).otherwise(F.lit(0)))


def tariff_info(tariff: DataFrame, pattern: str = PLAN_PATTERN) -> DataFrame:
    """Per-household ``tariff_start`` and plan token (for attaching to aggregates)."""
    return dedup_tariff(tariff).select(
        S.ID, S.START, plan_token(S.PLAN, pattern).alias(S.PLAN))


def attach_tariff(result: DataFrame, tariff: DataFrame | None,
                  pattern: str = PLAN_PATTERN, side: DataFrame | None = None) -> DataFrame:
    """Aggregate LEFT JOIN tariff info (start date, extracted plan token)."""
    if tariff is None and side is None:
        return result
    t = side if side is not None else tariff_side(tariff)
    info = t.select(S.ID, S.START, plan_token(S.PLAN, pattern).alias(S.PLAN))
    return result.join(info, S.ID, "left")
