"""Inputs shared by the registered queries, on the Spark side and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import CALENDAR_FEATURES, WEATHER_FEATURES, Settings
from tidemark.functions import calendar
from tidemark.operators import modeling, windows
from tidemark.session import materialize
from tidemark.sources import observations as obs

# Event values run from 0 to about 500, so the bins and tolerances are scaled to them.
EVENTS = Settings(low=20, heavy=100, bias_tolerance=2.0, rmse_threshold=45.0)
ORDERS = Settings(low=150000, heavy=300000, bias_tolerance=1000.0)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return obs.observations_from_events(spark, folder, EVENTS)


def series(spark: SparkSession, folder: str) -> DataFrame:
    """Only the columns the order-dependent jobs write and shuffle."""
    return events(spark, folder).select("obs_id", "date_time", "traffic_volume", *CALENDAR_FEATURES)


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return obs.observations_from_orders(spark, folder, ORDERS)


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    return obs.hourly_from_events(spark, folder, EVENTS)


def hourly_weather(spark: SparkSession, folder: str) -> DataFrame:
    """The hourly volume with all four weather columns, each an hourly mean over the events."""
    hour = calendar.hour_start(F.col("date_time")).alias("date_time")
    rows = events(spark, folder).withColumn("snow_1h", F.col("rain_1h") * F.col("clouds_all") / 100)
    hourly_rows = rows.groupBy(hour).agg(
        F.count("*").cast("double").alias("traffic_volume"), *[F.avg(c).alias(c) for c in WEATHER_FEATURES]
    )
    return obs.prepare(hourly_rows, EVENTS, deduplicate=False, identified=False)


def event_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return modeling.chronological_split(events(spark, folder), EVENTS)


def scored_events(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Train and test part, both scored by the hourly means of the train part."""
    train, test = event_split(spark, folder)
    return (
        modeling.group_mean_predictor(train, train, ["hour"]),
        modeling.group_mean_predictor(train, test, ["hour"]),
    )


def scored_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Late rows with lag features, scored by the hourly means of the early rows."""
    features = materialize(windows.forecasting_features(series(spark, folder)), "features")
    train, test = modeling.chronological_split(features, EVENTS)
    return modeling.group_mean_predictor(train, test, ["hour"])


_CALENDAR = """
    CAST(hour(date_time) AS INTEGER) AS hour, CAST(day(date_time) AS INTEGER) AS day,
    CAST(month(date_time) AS INTEGER) AS month, CAST(isodow(date_time) - 1 AS INTEGER) AS weekday,
    CASE WHEN hour(date_time) IN (7, 8, 9, 17, 18, 19) THEN 1 ELSE 0 END AS is_rush
"""
EV = f"""
WITH ev0 AS (
  SELECT event_id AS obs_id, ts AS date_time, value AS traffic_volume, event_type AS weather_main,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS clouds_all,
         user_id / 10.0::DOUBLE AS rain_1h
  FROM events),
ev AS (SELECT *, clouds_all + 250.0::DOUBLE AS temp, {_CALENDAR} FROM ev0)
"""
ORD = f"""
WITH od0 AS (
  SELECT o_orderkey AS obs_id, o_orderdate AS date_time, o_totalprice AS traffic_volume,
         o_orderpriority AS weather_main, o_custkey AS custkey
  FROM orders),
od AS (SELECT *, {_CALENDAR} FROM od0)
"""
HR = f"""
WITH hr0 AS (
  SELECT date_trunc('hour', ts) AS date_time, CAST(count(*) AS DOUBLE) AS traffic_volume
  FROM events GROUP BY 1),
hr AS (SELECT *, {_CALENDAR} FROM hr0)
"""
EV_SPLIT = (
    EV
    + """,
numbered AS (SELECT *, row_number() OVER (ORDER BY date_time, obs_id) - 1 AS rn,
                    count(*) OVER () AS n_all FROM ev),
train AS (SELECT * FROM numbered WHERE rn < floor(n_all * 0.85::DOUBLE)),
test AS (SELECT * FROM numbered WHERE rn >= floor(n_all * 0.85::DOUBLE)),
cells AS (SELECT hour, avg(traffic_volume) AS cell FROM train GROUP BY hour)
"""
)
EV_SCORED = (
    EV_SPLIT
    + """,
scored0 AS (SELECT t.*, coalesce(c.cell, (SELECT avg(traffic_volume) FROM train)) AS prediction
            FROM test t LEFT JOIN cells c USING (hour)),
scored AS (SELECT *, traffic_volume - prediction AS error, abs(traffic_volume - prediction) AS abs_error,
                  (traffic_volume - prediction) * (traffic_volume - prediction) AS squared_error FROM scored0),
ref_scored AS (SELECT t.*, c.cell AS prediction FROM train t JOIN cells c USING (hour))
"""
)
# The exponential average is a sum over the previous 480 rows; older ones weigh less than 1e-17.
EV_FEATURES = (
    EV
    + """,
numbered AS (SELECT *, row_number() OVER (ORDER BY date_time, obs_id) - 1 AS rn FROM ev),
ewma AS (
  SELECT a.rn, sum(b.traffic_volume * pow(0.92::DOUBLE, a.rn - 1 - b.rn)) / sum(pow(0.92::DOUBLE, a.rn - 1 - b.rn)) AS ewma_24h
  FROM numbered a JOIN numbered b ON b.rn BETWEEN a.rn - 480 AND a.rn - 1 GROUP BY a.rn),
framed AS (
  SELECT *, lag(traffic_volume, 1) OVER o AS lag_1h, lag(traffic_volume, 24) OVER o AS lag_24h,
         lag(traffic_volume, 168) OVER o AS lag_168h,
         count(traffic_volume) OVER p AS filled,
         avg(traffic_volume) OVER p AS mean_24, stddev_samp(traffic_volume) OVER p AS std_24
  FROM numbered
  WINDOW o AS (ORDER BY rn), p AS (ORDER BY rn ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
features AS (
  SELECT f.*, e.ewma_24h, CASE WHEN filled = 24 THEN mean_24 END AS rolling_mean_24h,
         CASE WHEN filled = 24 THEN std_24 END AS rolling_std_24h
  FROM framed f LEFT JOIN ewma e USING (rn))
"""
)
EV_FORECAST = (
    EV_FEATURES
    + """,
complete AS (SELECT *, row_number() OVER (ORDER BY rn) - 1 AS pos, count(*) OVER () AS n_all
             FROM features WHERE lag_24h IS NOT NULL AND rolling_std_24h IS NOT NULL),
ftrain AS (SELECT * FROM complete WHERE pos < floor(n_all * 0.85::DOUBLE)),
ftest AS (SELECT * FROM complete WHERE pos >= floor(n_all * 0.85::DOUBLE)),
fcells AS (SELECT hour, avg(traffic_volume) AS cell FROM ftrain GROUP BY hour),
forecast AS (
  SELECT date_time, hour, weekday, is_rush, traffic_volume AS actual_traffic_volume,
         lag_1h AS naive_lag1h_pred, lag_24h AS naive_lag24h_pred, cell AS ml_rf_forecast_pred,
         traffic_volume - lag_1h AS naive_lag1h_error, abs(traffic_volume - lag_1h) AS naive_lag1h_abs_error,
         traffic_volume - cell AS ml_rf_error, abs(traffic_volume - cell) AS ml_rf_abs_error,
         (traffic_volume - cell) * (traffic_volume - cell) AS ml_rf_squared_error
  FROM ftest JOIN fcells USING (hour))
"""
)
