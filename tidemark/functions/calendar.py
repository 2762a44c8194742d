"""Calendar columns derived from an observation time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import (
    DEFAULTS,
    EVENING_RUSH_HOURS,
    MONTH_ABBREVIATIONS,
    MORNING_RUSH_HOURS,
    WEEKDAY_NAMES,
    Settings,
)

# Accepted spellings of a time, the day-first ones before ISO.
DAY_FIRST_FORMATS = (
    "dd-MM-yyyy HH:mm:ss",
    "dd-MM-yyyy HH:mm",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "dd-MM-yyyy",
    "dd/MM/yyyy",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
)


def parse_time(
    text: Column, formats: tuple[str, ...] = DAY_FIRST_FORMATS, strict: bool = False
) -> Column:
    """Day-first parse into a zone-free timestamp. Where no format fits, null or, if ``strict``, an
    error that names the text; a null text is a null time."""
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    if strict:
        message = F.concat(F.lit("unreadable time: "), text)
        tries.append(F.when(text.isNotNull(), F.raise_error(message).cast("timestamp_ntz")))
    return F.coalesce(*tries)


def hour_start(time: Column) -> Column:
    """The full hour a time falls in, without passing through a time zone."""
    midnight = F.to_date(time).cast("timestamp_ntz")
    return midnight + F.make_dt_interval(F.lit(0), F.hour(time))


def weekday_name(weekday: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAY_NAMES)), weekday + 1)


def month_abbreviation(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTH_ABBREVIATIONS)), month)


def is_rush(hour: Column, settings: Settings = DEFAULTS) -> Column:
    return hour.isin(*settings.rush_hours).cast("int")


def is_weekday(weekday: Column) -> Column:
    return (weekday < 5).cast("int")


def day_type(weekday: Column) -> Column:
    return F.when(weekday.isin(5, 6), "Weekend").otherwise("Weekday")


def rush_status(rush: Column) -> Column:
    return F.when(rush == 1, "Rush Hour").otherwise("Non-Rush Hour")


def time_of_day_period(hour: Column) -> Column:
    return (
        F.when(hour.isin(*MORNING_RUSH_HOURS), "Morning Rush")
        .when(hour.isin(*EVENING_RUSH_HOURS), "Evening Rush")
        .when(hour.between(10, 16), "Midday Off-Peak")
        .when(hour >= 20, "Late Evening")
        .otherwise("Overnight Low")
    )


def time_label(hour: Column) -> Column:
    return F.format_string("%02d:00", hour)


def year_month(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM")


def iso_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def celsius(kelvin: Column) -> Column:
    return F.round(kelvin - 273.15, 2)


def with_calendar(df: DataFrame, settings: Settings = DEFAULTS, time: str = "date_time") -> DataFrame:
    """The five model features every job needs: hour, day, month, weekday (0 = Monday), rush."""
    t = F.col(time)
    return df.withColumns(
        {
            "hour": F.hour(t),
            "day": F.dayofmonth(t),
            "month": F.month(t),
            "weekday": F.weekday(t),
            "is_rush": is_rush(F.hour(t), settings),
        }
    )


def with_calendar_names(df: DataFrame, time: str = "date_time") -> DataFrame:
    """Year, date and the labels used by the star schema; needs :func:`with_calendar` first."""
    return df.withColumns(
        {
            "date": F.to_date(time),
            "year": F.year(time),
            "month_name": month_abbreviation(F.col("month")),
            "weekday_name": weekday_name(F.col("weekday")),
            "is_weekday": is_weekday(F.col("weekday")),
        }
    )
