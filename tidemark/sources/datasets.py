"""Named data sets in a folder, and JSON model metadata."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.observations import require_columns

# Columns each published data set must have.
REQUIRED_COLUMNS = {
    "traffic_hourly": ["date_time", "hour", "weekday", "is_weekday", "is_rush", "traffic_volume", "volume_bucket"],
    "traffic_daily": ["date", "year", "month", "total_traffic_volume", "avg_traffic_volume"],
    "traffic_monthly": ["year", "month", "year_month", "avg_traffic_volume", "total_traffic_volume"],
    "demand_forecast": ["date_time", "hour", "actual_traffic_volume", "naive_lag1h_pred", "ml_rf_forecast_pred", "ml_rf_error", "ml_rf_abs_error"],
    "model_performance": ["evaluation_strategy", "model_name", "mae", "rmse", "r2_score"],
    "error_analysis": ["segment_type", "segment_value", "segment_label", "sample_count", "mae", "rmse", "mean_bias_error"],
    "business_kpis": ["kpi_category", "kpi_name", "kpi_value"],
    "monitoring_metrics": ["metric_type", "feature_name", "psi_score", "drift_status", "rmse_threshold", "monitored_rmse"],
    "dim_date": ["date", "year", "month", "day", "is_weekday"],
    "dim_time": ["hour", "time_label", "time_of_day_period", "is_rush_hour"],
}


# Types of all published columns, so that text files are read without an inference pass.
COLUMN_TYPES = {
    "year": "int",
    "quarter": "int",
    "month": "int",
    "day": "int",
    "hour": "int",
    "weekday": "int",
    "day_of_week": "int",
    "is_weekday": "int",
    "is_rush": "int",
    "is_rush_hour": "int",
    "week_of_year": "int",
    "clouds_all": "int",
    "record_count": "bigint",
    "sample_count": "bigint",
    "temp": "double",
    "temp_celsius": "double",
    "rain_1h": "double",
    "snow_1h": "double",
    "traffic_volume": "double",
    "avg_traffic_volume": "double",
    "total_traffic_volume": "double",
    "min_traffic_volume": "double",
    "max_traffic_volume": "double",
    "peak_hourly_volume": "double",
    "actual_traffic_volume": "double",
    "naive_lag1h_pred": "double",
    "naive_lag24h_pred": "double",
    "ml_rf_forecast_pred": "double",
    "naive_lag1h_error": "double",
    "naive_lag1h_abs_error": "double",
    "ml_rf_error": "double",
    "ml_rf_abs_error": "double",
    "ml_rf_squared_error": "double",
    "mae": "double",
    "rmse": "double",
    "r2_score": "double",
    "mean_bias_error": "double",
    "reference_mean": "double",
    "current_mean": "double",
    "psi_score": "double",
    "rmse_threshold": "double",
    "monitored_rmse": "double",
    "alert_triggered": "boolean",
    "date_time": "timestamp_ntz",
    "date": "date",
}


def _typed(df: DataFrame) -> DataFrame:
    """Text columns with a published type, converted to it."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns({c: F.col(c).cast(COLUMN_TYPES[c]) for c in df.columns if c in text and c in COLUMN_TYPES})


def find_dataset(spark: SparkSession, name: str, folder: str, fmt: str = "parquet") -> DataFrame | None:
    """One named data set as it is, typed; None where there is none."""
    try:
        return _typed(spark.read.format(fmt).options(header=True).load(f"{folder.rstrip('/')}/{name}"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_dataset(
    spark: SparkSession, name: str, folder: str, fmt: str = "parquet", check_empty: bool = True
) -> DataFrame:
    """Load one named data set: missing, empty and incomplete ones are errors."""
    df = find_dataset(spark, name, folder, fmt)
    if df is None:
        raise FileNotFoundError(f"no data set {name!r} in {folder}")
    require_columns(df, REQUIRED_COLUMNS.get(name, []), f"data set {name!r}")
    if check_empty and df.isEmpty():
        raise ValueError(f"data set {name!r} in {folder} has no rows")
    return df


def load_all(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """All published data sets by name, lazily read."""
    return {name: load_dataset(spark, name, folder, fmt) for name in REQUIRED_COLUMNS}


class Shelf:
    """The data sets of a folder, each read and checked once and then shared, until ``clear``.

    What is shared is the plan and the cached rows that Spark keeps of it, spilling to disk.
    """

    def __init__(self, spark: SparkSession, folder: str, fmt: str = "parquet"):
        self.spark, self.folder, self.fmt, self.reads = spark, folder, fmt, 0
        self._held: dict[str, DataFrame] = {}

    def get(self, name: str) -> DataFrame:
        if name not in self._held:
            self._held[name] = load_dataset(self.spark, name, self.folder, self.fmt).persist()
            self.reads += 1
        return self._held[name]

    def clear(self) -> None:
        for df in self._held.values():
            df.unpersist()
        self._held.clear()


def read_model_metadata(spark: SparkSession, path: str) -> DataFrame | None:
    """Nested metadata document; ``None`` where there is none."""
    try:
        return spark.read.option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
