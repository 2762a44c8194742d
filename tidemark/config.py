"""Settings shared by every job: thresholds, rush hours, labels and feature lists."""

from __future__ import annotations

from dataclasses import dataclass

# The vocabulary of the published results.
RUSH_HOURS = (7, 8, 9, 17, 18, 19)
MORNING_RUSH_HOURS = (7, 8, 9)
EVENING_RUSH_HOURS = (17, 18, 19)
WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTH_ABBREVIATIONS = (
    "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)
UNDERPREDICTION = "Underprediction (Actual > Pred)"
OVERPREDICTION = "Overprediction (Pred > Actual)"
UNBIASED = "Unbiased (Near Zero)"
NO_DRIFT, MODERATE_SHIFT, SIGNIFICANT_DRIFT = "No Drift", "Moderate Shift", "Significant Drift"
DRIFT_DETECTED, STABLE = "Drift Detected", "Stable"
FEATURE_DRIFT_TYPE, PREDICTION_DRIFT_TYPE = "Feature Drift (PSI)", "Prediction Drift (PSI)"
PREDICTION_FEATURE_NAME = "traffic_volume_prediction"
ALERT_RAISED, ALERT_CLEAR = "Performance Degradation Detected", "Performance Within Threshold"
DEMAND_CATEGORY, MODEL_CATEGORY = "Demand Profile", "Model Performance & Bias"
PASSED, VALID_NOTE = "PASSED", "Valid Schema & Content"
MISSING_FILE, EMPTY_FILE = "FAILED (Missing File)", "FAILED (Empty File)"
ROW_COUNT_MISMATCH, MEAN_MISMATCH = "FAILED (Row Count Mismatch)", "FAILED (Mean Metric Mismatch)"
MISSING_COLUMN, INVALID_TIME_GRAIN = "FAILED (Missing Column)", "FAILED (Invalid Time Grain)"
ALERT_COLOR, CLEAR_COLOR = "#D9534F", "#5CB85C"
BUCKET_SEGMENT = "Traffic Volume Bucket"
SEGMENT_TYPES = {
    "hour": "Hour of Day",
    "weekday": "Day of Week",
    "is_rush": "Rush Hour Status",
    "month": "Month of Year",
    "volume_bucket": BUCKET_SEGMENT,
}

CALENDAR_FEATURES = ("hour", "day", "month", "weekday", "is_rush")
WEATHER_FEATURES = ("temp", "rain_1h", "snow_1h", "clouds_all")
LAG_FEATURES = ("lag_1h", "lag_24h", "rolling_mean_24h", "rolling_std_24h", "ewma_24h")


@dataclass(frozen=True)
class Settings:
    """Parameters that differ between data sets; the defaults are the published ones."""

    low: float = 2000
    heavy: float = 5000
    cut_floor: float = -1
    cut_ceiling: float = 10000
    rush_hours: tuple[int, ...] = RUSH_HOURS
    bias_tolerance: float = 50.0
    psi_moderate: float = 0.10
    psi_significant: float = 0.25
    rmse_threshold: float = 550.0
    train_share: float = 0.85
    seed: int = 42

    @property
    def low_label(self) -> str:
        return f"Low (<{self.low:g})"

    @property
    def moderate_label(self) -> str:
        return f"Moderate ({self.low:g}-{self.heavy:g})"

    @property
    def moderate_export_label(self) -> str:
        return f"Moderate ({self.low:g}-{self.heavy - 1:g})"

    @property
    def heavy_label(self) -> str:
        return f"Heavy (>={self.heavy:g})"


DEFAULTS = Settings()
