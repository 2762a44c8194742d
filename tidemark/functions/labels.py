"""Labels, flags, guarded divisions and texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import config
from tidemark.config import DEFAULTS, Settings


def volume_bucket(volume: Column, settings: Settings = DEFAULTS, moderate: str | None = None) -> Column:
    """Left-closed bins: a volume on an edge belongs to the upper bin."""
    return (
        F.when(volume < settings.low, settings.low_label)
        .when(volume < settings.heavy, moderate or settings.moderate_label)
        .otherwise(settings.heavy_label)
    )


def volume_bucket_right_closed(volume: Column, settings: Settings = DEFAULTS) -> Column:
    """Right-closed bins with an outer range; a volume outside the range has no bin (null)."""
    return (
        F.when(volume <= settings.cut_floor, None)
        .when(volume <= settings.low, settings.low_label)
        .when(volume <= settings.heavy, settings.moderate_label)
        .when(volume <= settings.cut_ceiling, settings.heavy_label)
    )


def flow_class(prediction: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(prediction < settings.low, "Smooth Traffic Flow")
        .when(prediction < settings.heavy, "Moderate Traffic")
        .otherwise("Heavy Traffic")
    )


def bias_direction(bias: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(bias > settings.bias_tolerance, config.UNDERPREDICTION)
        .when(bias < -settings.bias_tolerance, config.OVERPREDICTION)
        .otherwise(config.UNBIASED)
    )


def residuals(actual: Column, predicted: Column) -> dict[str, Column]:
    """Signed, absolute and squared residual, actual minus predicted."""
    error = actual - predicted
    return {"error": error, "abs_error": F.abs(error), "squared_error": error * error}


def drift_status(psi: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(psi < settings.psi_moderate, config.NO_DRIFT)
        .when(psi < settings.psi_significant, config.MODERATE_SHIFT)
        .otherwise(config.SIGNIFICANT_DRIFT)
    )


def drift_threshold_text(psi: Column, settings: Settings = DEFAULTS) -> Column:
    low, high = f"{settings.psi_moderate:.2f}", f"{settings.psi_significant:.2f}"
    return (
        F.when(psi < settings.psi_moderate, f"PSI < {low}")
        .when(psi < settings.psi_significant, f"{low} <= PSI < {high}")
        .otherwise(f"PSI >= {high}")
    )


def drift_detected(psi: Column, settings: Settings = DEFAULTS) -> Column:
    return psi >= settings.psi_moderate


def alert_triggered(rmse: Column, settings: Settings = DEFAULTS) -> Column:
    return rmse > settings.rmse_threshold


def alert_status(rmse: Column, settings: Settings = DEFAULTS) -> Column:
    return F.when(alert_triggered(rmse, settings), config.ALERT_RAISED).otherwise(config.ALERT_CLEAR)


def alert_message(rmse: Column, settings: Settings = DEFAULTS) -> Column:
    verdict = F.when(alert_triggered(rmse, settings), "exceeds performance").otherwise(
        "is within acceptable"
    )
    return F.format_string(
        "Monitored RMSE (%.2f) %s threshold (%.2f).", rmse, verdict, F.lit(float(settings.rmse_threshold))
    )


def divide(numerator: Column, denominator: Column, alternate: float | None = 0.0) -> Column:
    """Division that yields ``alternate`` where the denominator is zero or either side is null."""
    quotient = F.try_divide(numerator, denominator)
    return quotient if alternate is None else F.coalesce(quotient, F.lit(alternate))


def effect_size(d: float) -> str:
    """Conventional reading of a standardised mean difference, from its magnitude."""
    size = abs(d)
    if size < 0.2:
        return "Negligible Effect Size (|d| < 0.2)"
    if size < 0.5:
        return "Small Effect Size (|d| < 0.5)"
    if size < 0.8:
        return "Medium Effect Size (|d| < 0.8)"
    return "Large Effect Size (|d| >= 0.8)"


def shift_text(difference: Column, percent: Column) -> Column:
    return F.format_string("%+.2f veh/hr (%+.2f%%)", difference, percent)


def share_text(count: Column, total: Column) -> Column:
    return F.format_string("%d (%.2f%%)", count, count / total * 100)


def hour_text(hour: Column, volume: Column) -> Column:
    return F.format_string("%02d:00 (%.0f veh/hr)", hour, volume)


def month_text(name: Column, volume: Column) -> Column:
    return F.format_string("%s (%.0f veh/hr)", name, volume)


def hour_error_text(hour: Column, mae: Column) -> Column:
    return F.format_string("%02d:00 (MAE %.1f)", hour, mae)


def signed_text(value: Column) -> Column:
    return F.format_string("%+.2f veh/hr", value)


def p_text(p: Column) -> Column:
    """Four decimals, or scientific notation below 0.0001."""
    return F.when(p < 0.0001, F.format_string("%.4e", p)).otherwise(F.round(p, 4).cast("string"))
