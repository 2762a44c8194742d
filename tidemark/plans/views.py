"""The summary views, as DataFrame functions and as named temporary views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions import calendar
from tidemark.operators import aggregates, windows

MEASURES = ["record_count", "avg_traffic_volume", "min_traffic_volume", "max_traffic_volume"]


def daily_traffic_summary(df: DataFrame, digits: int | None = 2) -> DataFrame:
    parts = ["record_count", "avg_traffic_volume", "total_traffic_volume", *MEASURES[2:]]
    keys = {"date_val": F.to_date("date_time")}
    return aggregates.volume_summary(df, keys, parts, digits).orderBy("date_val")


def hourly_traffic_summary(df: DataFrame, digits: int | None = 2) -> DataFrame:
    return aggregates.volume_summary(df, {"hour": F.col("hour")}, MEASURES, digits).orderBy("hour")


def day_type_comparison(df: DataFrame, digits: int | None = 2) -> DataFrame:
    keys = {"day_type": calendar.day_type(F.col("weekday"))}
    return aggregates.volume_summary(df, keys, MEASURES, digits)


def rush_hour_summary(df: DataFrame, digits: int | None = 2) -> DataFrame:
    keys = {"rush_status": calendar.rush_status(F.col("is_rush"))}
    return aggregates.volume_summary(df, keys, MEASURES, digits)


def monthly_traffic_trends(df: DataFrame, digits: int | None = 2) -> DataFrame:
    parts = ["record_count", "avg_traffic_volume", "total_traffic_volume"]
    return aggregates.volume_summary(df, {"month": F.col("month")}, parts, digits).orderBy("month")


def rolling_24h_traffic(df: DataFrame, digits: int | None = 2) -> DataFrame:
    keys = [k for k in ("date_time", "obs_id") if k in df.columns]
    needed = df.select(*dict.fromkeys([*keys, "hour", "weekday", "traffic_volume"]))
    return windows.rolling_average(needed, keys=keys, digits=digits).select(
        "date_time", "hour", "weekday", "traffic_volume", "rolling_24h_avg"
    )


def peak_traffic_rankings(df: DataFrame) -> DataFrame:
    return windows.volume_rank(
        df.select("date_time", "hour", "weekday", "month", "traffic_volume")
    )


def traffic_volume_buckets(
    df: DataFrame, settings: Settings = DEFAULTS, digits: int | None = 2
) -> DataFrame:
    return aggregates.bucket_shares(df, settings, digits)


def weather_impact_summary(df: DataFrame, digits: int | None = 2, rain_digits: int | None = 4) -> DataFrame:
    def rounded(c, d):
        return c if d is None else F.round(c, d)

    return (
        df.groupBy("weather_main")
        .agg(
            F.count("*").alias("record_count"),
            rounded(F.avg("traffic_volume"), digits).alias("avg_traffic_volume"),
            rounded(F.avg("temp"), digits).alias("avg_temp_kelvin"),
            rounded(F.avg("rain_1h"), rain_digits).alias("avg_rain_mm"),
        )
        .orderBy(F.col("avg_traffic_volume").desc(), "weather_main")
    )


def top_peaks(df: DataFrame, n: int = 10) -> DataFrame:
    """The n highest rows in a fixed order. Every row above them is among them, so ranking the n
    rows alone gives the rank in the whole table."""
    tie = [k for k in ("date_time", "obs_id") if k in df.columns]
    top = df.orderBy(F.col("traffic_volume").desc(), *tie).limit(n)
    rank = F.rank().over(Window.orderBy(F.col("traffic_volume").desc()))
    return top.select("date_time", "hour", "weekday", "month", "traffic_volume", rank.alias("volume_rank"))


def preview(view: DataFrame, n: int = 100) -> DataFrame:
    return view.limit(n)


VIEWS: dict[str, Callable[[DataFrame, Settings], DataFrame]] = {
    "v_daily_traffic_summary": lambda df, s: daily_traffic_summary(df),
    "v_hourly_traffic_summary": lambda df, s: hourly_traffic_summary(df),
    "v_day_type_comparison": lambda df, s: day_type_comparison(df),
    "v_rush_hour_summary": lambda df, s: rush_hour_summary(df),
    "v_monthly_traffic_trends": lambda df, s: monthly_traffic_trends(df),
    "v_rolling_24h_traffic": lambda df, s: rolling_24h_traffic(df),
    "v_peak_traffic_rankings": lambda df, s: peak_traffic_rankings(df),
    "v_traffic_volume_buckets": lambda df, s: traffic_volume_buckets(df, s),
    "v_weather_impact_summary": lambda df, s: weather_impact_summary(df),
}
BASE_TABLE = "traffic_data"


def register_views(
    df: DataFrame, settings: Settings = DEFAULTS, only: list[str] | None = None
) -> None:
    """Publish the base rows and the views by name, replacing earlier ones."""
    df.createOrReplaceTempView(BASE_TABLE)
    for name in only or VIEWS:
        VIEWS[name](df, settings).createOrReplaceTempView(name)


def named_result(spark: SparkSession, query: str) -> DataFrame:
    """A SELECT statement as it is, or all rows of a table or view given by its name."""
    if query.strip().upper().startswith("SELECT"):
        return spark.sql(query)
    if not re.fullmatch(r"\w+(\.\w+)*", query.strip()):
        raise ValueError(f"not a table or view name: {query!r}")
    return spark.table(query.strip())
