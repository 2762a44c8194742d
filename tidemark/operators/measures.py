"""Reusable measures: named aggregate expressions valid under any slicer or grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import (
    ALERT_COLOR,
    BUCKET_SEGMENT,
    CLEAR_COLOR,
    DEFAULTS,
    FEATURE_DRIFT_TYPE,
    PREDICTION_DRIFT_TYPE,
    Settings,
)
from tidemark.functions.labels import divide


def volume_measures() -> dict[str, Column]:
    """Over the hourly fact."""
    v = F.col("traffic_volume")
    rush, non_rush = (F.avg(F.when(F.col("is_rush") == f, v)) for f in (1, 0))
    weekday, weekend = (F.avg(F.when(F.col("is_weekday") == f, v)) for f in (1, 0))
    return {
        "average_volume": F.avg(v),
        "total_volume": F.sum(v),
        "peak_volume": F.max(v),
        "rush_avg_volume": rush,
        "non_rush_avg_volume": non_rush,
        "rush_shift_pct": divide(rush - non_rush, non_rush),
        "weekday_avg_volume": weekday,
        "weekend_avg_volume": weekend,
        "weekday_shift_pct": divide(weekday - weekend, weekend),
    }


def forecast_measures() -> dict[str, Column]:
    """Over the forecast fact."""
    ml, naive = F.avg("ml_rf_abs_error"), F.avg("naive_lag1h_abs_error")
    squared, actual = F.col("ml_rf_squared_error"), F.col("actual_traffic_volume")
    return {
        "actual_volume": F.avg(actual),
        "ml_forecast_volume": F.avg("ml_rf_forecast_pred"),
        "naive_volume": F.avg("naive_lag1h_pred"),
        "mae_ml": ml,
        "mae_naive": naive,
        "rmse_ml": F.sqrt(F.avg(squared)),
        "r2_ml": 1.0 - F.try_divide(F.avg(squared), F.var_pop(actual)),
        "error_reduction_pct": divide(ml - naive, naive),
        "forecast_mean_bias": F.avg("ml_rf_error"),
    }


def error_measures(settings: Settings = DEFAULTS) -> dict[str, Column]:
    """Over the segment error table; the bias is given per segment and weighted by rows."""
    heavy = (F.col("segment_type") == BUCKET_SEGMENT) & (F.col("segment_label") == settings.heavy_label)
    n, bias = F.col("sample_count"), F.col("mean_bias_error")
    return {
        "holdout_mean_bias": F.avg(bias),
        "holdout_weighted_bias": F.try_divide(F.sum(bias * n), F.sum(n)),
        "heavy_mean_bias": F.avg(F.when(heavy, bias)),
        "heavy_mae": F.avg(F.when(heavy, F.col("mae"))),
    }


def monitoring_measures() -> dict[str, Column]:
    """Over the flattened monitoring table."""
    kind, score = F.col("metric_type"), F.col("psi_score")
    alert = F.max(F.col("alert_triggered").cast("int"))
    return {
        "monitored_rmse": F.max("monitored_rmse"),
        "rmse_threshold": F.max("rmse_threshold"),
        "max_feature_psi": F.max(F.when(kind == FEATURE_DRIFT_TYPE, score)),
        "prediction_psi": F.max(F.when(kind == PREDICTION_DRIFT_TYPE, score)),
        "alert_color": F.when(alert == 1, ALERT_COLOR).otherwise(CLEAR_COLOR),
    }


def evaluate(df: DataFrame, measures: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """All measures per group, from one aggregate."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in measures.items()])
