"""Append-only log of scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import CALENDAR_FEATURES
from tidemark.sources.observations import require_columns



def append_predictions(
    scored: DataFrame,
    path: str,
    prediction: str = "prediction",
    actual: str | None = None,
    model_version: str = "v1.0.0",
    batch: int | None = None,
    logged_at: Column | None = None,
) -> None:
    """Append scored rows; one time per call; a missing actual becomes null.

    The order of log rows is (``timestamp``, ``row_id``). With a ``batch`` number the call replaces
    that batch's partition, so a batch that is replayed after a failure is not logged twice; without
    one the batch is null. Both kinds of calls may share a path, as the layout is the same.
    """
    require_columns(scored, [*CALENDAR_FEATURES, prediction], "scored rows")
    actual_column = F.col(actual).cast("double") if actual else F.lit(None).cast("double")
    rows = scored.select(
        F.monotonically_increasing_id().alias("row_id"),
        (logged_at if logged_at is not None else F.localtimestamp()).alias("timestamp"),
        *[F.col(c).cast("int").alias(c) for c in CALENDAR_FEATURES],
        F.col(prediction).cast("double").alias("predicted_traffic_volume"),
        actual_column.alias("actual_traffic_volume"),
        F.lit(model_version).alias("model_version"),
        F.lit(batch).cast("bigint").alias("batch_id"),
    )
    (
        rows.write.mode("append" if batch is None else "overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model_version", "batch_id")
        .parquet(path)
    )


def latest_predictions(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """The last ``limit`` rows, newest first: a per-task top-k, not a full sort."""
    log = spark.read.parquet(path)
    return log.orderBy(F.col("timestamp").desc(), F.col("row_id").desc()).limit(limit)
