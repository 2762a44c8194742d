"""Residuals of a scored holdout, broken down by segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, SEGMENT_TYPES, Settings
from tidemark.functions import labels
from tidemark.operators.quality import require_rows

TARGET = "traffic_volume"


def with_residuals(scored: DataFrame, actual: str = TARGET, predicted: str = "prediction") -> DataFrame:
    return scored.withColumns(labels.residuals(F.col(actual), F.col(predicted)))


def holdout(scored: DataFrame, settings: Settings = DEFAULTS, right_closed: bool = False) -> DataFrame:
    """A scored holdout with residuals and its volume bucket, for every report below."""
    volume = F.col(TARGET)
    bucket = (
        labels.volume_bucket_right_closed(volume, settings)
        if right_closed
        else labels.volume_bucket(volume, settings)
    )
    return with_residuals(scored).withColumn("volume_bucket", bucket)


def _error_columns(settings: Settings, digits: int | None) -> list[Column]:
    def rounded(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    return [
        "sample_count",
        rounded(F.col("_mae")).alias("mae"),
        rounded(F.sqrt("_mse")).alias("rmse"),
        rounded(F.col("_bias")).alias("mean_bias_error"),
        labels.bias_direction(F.col("_bias"), settings).alias("bias_direction"),
    ]


def _sums() -> list[Column]:
    return [
        F.count("*").alias("sample_count"),
        F.avg("abs_error").alias("_mae"),
        F.avg("squared_error").alias("_mse"),
        F.avg("error").alias("_bias"),
    ]


def segment_report(
    errors: DataFrame,
    segment: str,
    settings: Settings = DEFAULTS,
    segment_type: str | None = None,
    digits: int | None = 2,
) -> DataFrame:
    """Count, MAE, RMSE, bias and its direction per value of one column; null values are no segment."""
    require_rows(errors, "error rows")
    grouped = errors.filter(F.col(segment).isNotNull()).groupBy(segment).agg(*_sums())
    return grouped.select(
        F.lit(segment_type or SEGMENT_TYPES.get(segment, segment)).alias("segment_type"),
        F.col(segment).cast("string").alias("segment_value"),
        *_error_columns(settings, digits),
    )


def bucket_report(
    scored: DataFrame, settings: Settings = DEFAULTS, right_closed: bool = True, digits: int | None = 2
) -> DataFrame:
    errors = holdout(scored, settings, right_closed)
    return segment_report(errors, "volume_bucket", settings, digits=digits)


def full_report(
    errors: DataFrame,
    segments: Sequence[str] = tuple(SEGMENT_TYPES),
    settings: Settings = DEFAULTS,
    digits: int | None = 2,
) -> DataFrame:
    """The segment report over every dimension, from one pass with grouping sets."""
    segments = list(segments)
    grouped = errors.groupingSets([[s] for s in segments], *segments).agg(
        F.grouping_id().alias("_set"), *_sums()
    )
    width = len(segments)
    kind = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, s in enumerate(segments):
        this = F.col("_set") == (1 << width) - 1 - (1 << (width - 1 - i))
        kind = F.when(this, SEGMENT_TYPES.get(s, s)).otherwise(kind)
        value = F.when(this, F.col(s).cast("string")).otherwise(value)
    return (
        grouped.withColumns({"segment_type": kind, "segment_value": value})
        .filter("segment_value IS NOT NULL")
        .select("segment_type", "segment_value", *_error_columns(settings, digits))
    )
