"""Calendar expressions: period keys, price periods, event time.

All expressions work on ``timestamp_ntz`` wall-clock values and never go
through the session time zone (date arithmetic only), so results do not
depend on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadshape.schemas import FREQUENCIES

# Fixed values of the tariff rules (must equal the study's definitions):
# high price = winter month, Monday-Friday, hour 07 through 19 inclusive,
# and not a public holiday; everything else is low price.
WINTER_MONTHS = (11, 12, 1, 2, 3)
PEAK_FIRST_HOUR = 7
PEAK_LAST_HOUR = 19
HIGH = "high"
LOW = "low"
ALL = "all"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period_key(ts, freq: str) -> Column:
    """Period key of a reading for ``freq``.

    day/week/month/quarter/year -> period start as timestamp_ntz (weeks start
    on Monday); hour -> int 0..23; weekday -> int 0=Monday..6; week_part ->
    'weekday' / 'weekend'. Unknown frequencies raise ``ValueError``.
    """
    if freq not in FREQUENCIES:
        raise ValueError(f"Invalid freq: {freq}")
    t = _col(ts)
    d = F.to_date(t)
    if freq == "hour":
        return F.hour(t).cast("int")
    if freq == "weekday":
        return F.weekday(t).cast("int")
    if freq == "week_part":
        return F.when(F.weekday(t) < 5, F.lit("weekday")).otherwise(F.lit("weekend"))
    if freq == "day":
        start = d
    elif freq == "week":
        start = F.date_sub(d, F.weekday(d))
    else:
        start = F.trunc(d, freq)
    return start.cast("timestamp_ntz")


def is_high_price(ts, holiday_flag: Column | None = None) -> Column:
    """True iff the reading falls in the high-price window.

    ``holiday_flag`` is a boolean column (reading date is a public holiday);
    ``None`` means no holiday calendar is applied.
    """
    t = _col(ts)
    high = (
        F.month(t).isin(*WINTER_MONTHS)
        & (F.weekday(t) < 5)
        & F.hour(t).between(PEAK_FIRST_HOUR, PEAK_LAST_HOUR)
    )
    if holiday_flag is not None:
        high = high & ~F.coalesce(holiday_flag, F.lit(False))
    return high


def price_label(ts, holiday_flag: Column | None = None) -> Column:
    return F.when(is_high_price(ts, holiday_flag), F.lit(HIGH)).otherwise(F.lit(LOW))


def event_time(ts, start) -> Column:
    """Whole calendar months from ``start`` to ``ts`` (year diff * 12 + month diff)."""
    t, s = _col(ts), _col(start)
    return ((F.year(t) - F.year(s)) * 12 + (F.month(t) - F.month(s))).cast("int")


def month_label(d) -> Column:
    """``yyyy-MM`` label of a date/timestamp."""
    return F.date_format(_col(d), "yyyy-MM")
