"""The published star schema: facts, dimensions and the joins between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions import calendar, labels
from tidemark.operators import aggregates, errors
from tidemark.operators.modeling import regression_metrics

HOURLY_COLUMNS = [
    "date_time", "date", "year", "month", "month_name", "day", "hour", "weekday", "weekday_name",
    "is_weekday", "is_rush", "temp_celsius", "temp", "rain_1h", "snow_1h", "clouds_all",
    "weather_main", "weather_description", "traffic_volume", "volume_bucket",
]
FORECAST_COLUMNS = [
    "date_time", "hour", "weekday", "is_rush", "actual_traffic_volume", "naive_lag1h_pred",
    "naive_lag24h_pred", "ml_rf_forecast_pred", "naive_lag1h_error", "naive_lag1h_abs_error",
    "ml_rf_error", "ml_rf_abs_error", "ml_rf_squared_error",
]


def traffic_hourly(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The hourly fact; absent weather columns are left out."""
    named = calendar.with_calendar_names(df)
    if "temp" in df.columns:
        named = named.withColumn("temp_celsius", calendar.celsius(F.col("temp")))
    bucket = labels.volume_bucket(F.col("traffic_volume"), settings, settings.moderate_export_label)
    full = named.withColumn("volume_bucket", bucket)
    return full.select(*[c for c in HOURLY_COLUMNS if c in full.columns])


def traffic_daily(df: DataFrame, digits: int | None = 2) -> DataFrame:
    return aggregates.daily_fact(df, digits)


def traffic_monthly(df: DataFrame, digits: int | None = 2) -> DataFrame:
    return aggregates.monthly_fact(df, digits)


def demand_forecast(scored: DataFrame) -> DataFrame:
    """Scored tail of the forecasting job with the residuals of model and baseline."""
    actual, ml, naive = F.col("traffic_volume"), F.col("prediction"), F.col("lag_1h")
    model, base = labels.residuals(actual, ml), labels.residuals(actual, naive)
    return scored.select(
        "date_time",
        "hour",
        "weekday",
        "is_rush",
        actual.alias("actual_traffic_volume"),
        naive.alias("naive_lag1h_pred"),
        F.col("lag_24h").alias("naive_lag24h_pred"),
        ml.alias("ml_rf_forecast_pred"),
        base["error"].alias("naive_lag1h_error"),
        base["abs_error"].alias("naive_lag1h_abs_error"),
        model["error"].alias("ml_rf_error"),
        model["abs_error"].alias("ml_rf_abs_error"),
        model["squared_error"].alias("ml_rf_squared_error"),
    )


# The published rows of the model table.
PERFORMANCE_ROWS = {
    "holdout": (
        "Chronological Holdout (5 Calendar Features)",
        "Random Forest Regressor (Production Model)",
        "hour, day, month, weekday, is_rush",
    ),
    "forecast": (
        "Chronological Forecasting (Lags + Rolling)",
        "ML Lag Random Forest Model",
        "lags (1h, 24h), rolling (mean, std, ewma), calendar",
    ),
    "naive": (
        "Chronological Forecasting (Naive Baseline)",
        "Naive Prev-Hour Persistence (Lag 1h)",
        "lag_1h",
    ),
}


def model_performance(
    holdout: DataFrame, forecast: DataFrame, settings: Settings = DEFAULTS, rounded: bool = True
) -> DataFrame:
    """Three rows: calendar model on its holdout, lag model and naive baseline on the forecast."""
    share = round(settings.train_share * 100)

    def part(df: DataFrame, actual: str, predicted: str, row: str) -> DataFrame:
        strategy, model, features = PERFORMANCE_ROWS[row]
        return df.select(
            F.lit(strategy).alias("evaluation_strategy"),
            F.lit(model).alias("model_name"),
            F.lit(features).alias("features_used"),
            F.col(actual).cast("double").alias("actual"),
            F.col(predicted).alias("prediction"),
        )

    long = (
        part(holdout, "traffic_volume", "prediction", "holdout")
        .unionByName(part(forecast, "actual_traffic_volume", "ml_rf_forecast_pred", "forecast"))
        .unionByName(part(forecast, "actual_traffic_volume", "naive_lag1h_pred", "naive"))
    )
    keys = ["evaluation_strategy", "model_name", "features_used"]
    table = regression_metrics(long, "actual", "prediction", keys, rounded=False)

    def shown(c: str, digits: int) -> Column:
        return F.round(c, digits) if rounded else F.col(c)

    return table.select(
        *keys,
        F.lit(f"{share}/{100 - share} Time-Sorted").alias("train_test_split"),
        shown("mae", 2).alias("mae"),
        shown("rmse", 2).alias("rmse"),
        shown("r2", 4).alias("r2_score"),
    )


def error_analysis(
    scored: DataFrame, settings: Settings = DEFAULTS, right_closed: bool = True, digits: int | None = 2
) -> DataFrame:
    """Segment errors by bucket, hour, rush status and weekday, stacked by one grouping-sets aggregate."""
    rows = errors.holdout(scored, settings, right_closed)
    report = errors.full_report(rows, ("volume_bucket", "hour", "is_rush", "weekday"), settings, digits)
    return report.select(
        "segment_type",
        "segment_value",
        F.col("segment_value").alias("segment_label"),
        *report.columns[2:],
    )


def dim_date(df: DataFrame, time: str = "date_time") -> DataFrame:
    """Continuous calendar from the first to the last observed day."""
    span = df.agg(F.to_date(F.min(time)).alias("a"), F.to_date(F.max(time)).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("date"))
    d, weekday = F.col("date"), F.weekday("date")
    return days.select(
        "date",
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.dayofmonth(d).alias("day"),
        weekday.alias("day_of_week"),
        calendar.weekday_name(weekday).alias("weekday_name"),
        calendar.is_weekday(weekday).alias("is_weekday"),
        F.weekofyear(d).alias("week_of_year"),
    )


def dim_time(spark: SparkSession, settings: Settings = DEFAULTS) -> DataFrame:
    hour = F.col("hour")
    return spark.range(24).select(F.col("id").cast("int").alias("hour")).select(
        "hour",
        calendar.time_label(hour).alias("time_label"),
        calendar.time_of_day_period(hour).alias("time_of_day_period"),
        calendar.is_rush(hour, settings).alias("is_rush_hour"),
    )


# Five centuries of days.
MAX_DAYS = 200_000


def star_join(fact: DataFrame, dates: DataFrame, times: DataFrame) -> DataFrame:
    """Fact with its dimensions; dimension columns get a prefix. The hours are broadcast, and so are
    the days unless stray times stretch them over more than ``MAX_DAYS``."""
    d = dates.select(*[F.col(c).alias("date" if c == "date" else f"date_{c}") for c in dates.columns])
    t = times.select(*[F.col(c).alias("hour" if c == "hour" else f"time_{c}") for c in times.columns])
    if d.limit(MAX_DAYS + 1).count() <= MAX_DAYS:
        d = F.broadcast(d)
    return fact.join(d, "date").join(F.broadcast(t), "hour")


def write_table(
    df: DataFrame, folder: str, name: str, partition_by: str | None = None, fmt: str = "parquet"
) -> None:
    """Overwrite a table. A partitioned one is rebalanced first: every partition value gets files of
    the advisory size, with large values split and small ones combined."""
    if partition_by is not None:
        df = df.hint("rebalance", partition_by)
    writer = df.write.mode("overwrite").format(fmt).option("header", True)
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.save(f"{folder}/{name}")
