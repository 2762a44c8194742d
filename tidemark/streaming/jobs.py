"""The hourly fact and the monitoring log fed by a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.config import DEFAULTS, Settings
from tidemark.operators import drift, modeling
from tidemark.session import scratch_path
from tidemark.sources.prediction_log import append_predictions


def hourly_volume(events: DataFrame, time: str = "ts", lateness: str = "2 hours") -> DataFrame:
    """Events per full hour. Rows later than the watermark are dropped; state is kept only for
    hours that may still change. Watermarks need a zoned time, so the column is cast and the result
    cast back; keep the session zone at UTC, where no hour is skipped or doubled."""
    return (
        events.withColumn("_t", F.col(time).cast("timestamp"))
        .withWatermark("_t", lateness)
        .groupBy(F.window("_t", "1 hour"))
        .agg(F.count("*").alias("traffic_volume"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("date_time"), "traffic_volume")
    )


def replay(rows: DataFrame, arrival: str, arrivals: Sequence[int], folder: str, drain: Callable[[], None]) -> None:
    """Hand a table to a stream over ``folder`` in the order in which its rows arrived.

    ``arrival`` names the step of a row and ``arrivals`` the steps in order. The table is read once and
    written apart by step; then each step is appended to the folder and ``drain`` runs the stream until it has
    taken all of it. A drained stream has also moved its watermark, so rows of a later step that lie before
    it are late, however many files a step has.
    """
    spark = rows.sparkSession
    steps = scratch_path(spark, "replay")
    rows.write.partitionBy(arrival).parquet(steps)
    # Without their column: partition values would be part of the stream's schema.
    kept = rows.drop(arrival).schema
    empty = spark.createDataFrame([], kept)
    for step in arrivals:
        path = f"{steps}/{arrival}={step}"
        try:
            found = spark.read.schema(kept).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = empty
        found.write.mode("append").parquet(folder)
        drain()


def monitor_batch(
    model: PipelineModel,
    log_path: str,
    metrics_path: str,
    actual: str = "traffic_volume",
    model_version: str = "v1.0.0",
    settings: Settings = DEFAULTS,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: score, log, and write performance and alert of the batch.

    Both sinks replace the partition of the batch, so a replay leaves one copy. Actuals may come
    later: a batch without them, or without their column, is logged and has no metrics.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        scored = modeling.score_batch(model, batch, settings).withColumnRenamed("Prediction", "prediction")
        scored.persist()
        try:
            known = actual if actual in scored.columns else None
            append_predictions(scored, log_path, actual=known, model_version=model_version, batch=batch_id)
            if known is None or scored.filter(F.col(actual).isNotNull()).isEmpty():
                return
            performance = modeling.regression_metrics(scored, actual)
            verdict = drift.alert(performance, settings).select(F.struct("*")).scalar()
            (
                performance.withColumn("_a", verdict)
                .select("*", "_a.*")
                .drop("_a")
                .withColumn("batch_id", F.lit(int(batch_id)))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id")
                .parquet(metrics_path)
            )
        finally:
            scored.unpersist()

    return handle


def start_monitoring(
    stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str
) -> DataStreamWriter:
    """A writer whose progress is kept in ``checkpoint``; call ``start`` on it."""
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
