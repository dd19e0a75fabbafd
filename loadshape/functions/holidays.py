"""Public holidays by country, computed from a date with column arithmetic.

No table and no join: a day's holiday name is an expression of the day alone, so
it can be evaluated on every reading, in any year of the Gregorian calendar.
Movable feasts hang on Easter Sunday, weekday-bound days on the first such
weekday of a span. ``SE`` has the public holidays of Sweden and the eves that
are days off there (midsummer, Christmas, New Year).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadshape.schemas import HOLIDAY_SCHEMA

# Fixed values of the Swedish calendar: month, day, name, first and last year.
SE_FIXED = (
    (1, 1, "Nyårsdagen", None, None),
    (1, 6, "Trettondedag jul", None, None),
    (5, 1, "Första maj", 1939, None),
    (6, 6, "Sveriges nationaldag", 2005, None),
    (12, 24, "Julafton", None, None),
    (12, 25, "Juldagen", None, None),
    (12, 26, "Annandag jul", None, None),
    (12, 31, "Nyårsafton", None, None),
)
# Days after Easter Sunday, name, first and last year.
SE_EASTER = (
    (-2, "Långfredagen", None, None),
    (0, "Påskdagen", None, None),
    (1, "Annandag påsk", None, None),
    (39, "Kristi himmelsfärdsdag", None, None),
    (49, "Pingstdagen", None, None),
    (50, "Annandag pingst", None, 2004),
)
# Month and day from which the first such weekday (0 = Monday) counts, name, years.
SE_WEEKDAY = (
    (6, 19, 4, "Midsommarafton", 1953, None),
    (6, 20, 5, "Midsommardagen", 1953, None),
    (10, 31, 5, "Alla helgons dag", 1953, None),
)
COUNTRIES = {"SE": (SE_FIXED, SE_EASTER, SE_WEEKDAY)}


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def easter_sunday(year: Column) -> Column:
    """Easter Sunday of a Gregorian year: the Sunday after the paschal full
    moon, from the year's place in the 19-year lunar cycle, with the solar and
    lunar corrections of its century."""
    century = _div(year, 100)
    golden = F.pmod(year, F.lit(19))
    moon = F.pmod(golden * 19 + century - _div(century, 4) - _div(century * 8 + 13, 25) + 15, F.lit(30))
    # the full moon never falls on the last day of the cycle, nor twice on the one before it
    moon = moon - F.when((moon == 29) | ((moon == 28) & (golden > 10)), F.lit(1)).otherwise(F.lit(0))
    full_moon = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), moon.cast("int"))
    return F.date_add(full_moon, F.lit(7) - F.pmod(F.weekday(full_moon) + 1, F.lit(7)))


def _in_years(condition: Column, year: Column, first: int | None, last: int | None) -> Column:
    if first is not None:
        condition = condition & (year >= first)
    return condition if last is None else condition & (year <= last)


def holiday_name(day: Column, country: str = "SE") -> Column:
    """Name of the holiday on this date, NULL on other days; several names of
    one day are joined by ``"; "``."""
    try:
        fixed, easter_days, weekdays = COUNTRIES[country]
    except KeyError:
        raise ValueError(f"no holiday calendar for country {country!r}") from None
    year, month, of_month = F.year(day), F.month(day), F.dayofmonth(day)
    names = [F.when(_in_years((month == m) & (of_month == d), year, first, last), F.lit(name)) for m, d, name, first, last in fixed]
    # Easter is from March 22 to April 25: no feast hangs on it outside March to June
    after = F.when(month.between(3, 6), F.datediff(day, easter_sunday(year)))
    names += [F.when(_in_years(after == n, year, first, last), F.lit(name)) for n, name, first, last in easter_days]
    for m, d, weekday, name, first, last in weekdays:
        # the span of seven days from month m, day d on
        since = F.datediff(day, F.make_date(year, F.lit(m), F.lit(d)))
        names.append(F.when(_in_years(since.between(0, 6) & (F.weekday(day) == weekday), year, first, last), F.lit(name)))
    joined = F.concat_ws("; ", *names)
    return F.when(joined != "", joined)


def is_holiday(day: Column, country: str = "SE") -> Column:
    return F.coalesce(holiday_name(day, country).isNotNull(), F.lit(False))


def holiday_calendar(spark: SparkSession, first_year: int, last_year: int, country: str = "SE") -> DataFrame:
    """``date, name`` of every holiday of these years, by date (at most 366 rows a year)."""
    days = spark.sql(f"SELECT explode(sequence(make_date({int(first_year)}, 1, 1), make_date({int(last_year)}, 12, 31))) AS date")
    named = days.select("date", holiday_name(F.col("date"), country).alias("name")).where(F.col("name").isNotNull())
    return named.select(*[F.col(f.name).cast(f.dataType) for f in HOLIDAY_SCHEMA]).orderBy("date")
