"""Drift, alerts and the monitoring report, on early against late events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import CALENDAR_FEATURES
from tidemark.functions import labels
from tidemark.operators import drift, measures, modeling, selection
from tidemark.plans import reports
from tidemark.session import scratch_path
from tidemark.sources import datasets
from tidemark.workload.inputs import EV_SCORED, EV_SPLIT, EVENTS, event_split, scored_events
from tidemark.workload.registry import query

FEATURES = ", ".join(CALENDAR_FEATURES)


def _long_sql(columns: list[str], reference: str, current: str) -> str:
    def side(table: str) -> str:
        return " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST({e} AS DOUBLE) AS value FROM {table}" for n, e in pairs)

    pairs = [c.split("=") if "=" in c else (c, c) for c in columns]
    return f", refl AS ({side(reference)}), curl AS ({side(current)})"


PSI_SQL = """,
e0 AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e, min(value) AS lo, max(value) AS hi, count(*) AS n FROM refl GROUP BY feature),
ed AS (SELECT feature, n, CASE WHEN len(e) <= 1 THEN [lo - 1, hi + 1] ELSE e END AS e FROM e0),
bins AS (SELECT feature, n, b, e[b] AS lo, e[b + 1] AS hi, b = len(e) - 1 AS final FROM (SELECT feature, n, e, unnest(range(1, len(e))) AS b FROM ed)),
rc AS (SELECT bins.feature, b, count(refl.value) AS c FROM bins LEFT JOIN refl ON refl.feature = bins.feature AND refl.value >= lo AND (refl.value < hi OR (final AND refl.value = hi)) GROUP BY 1, 2),
cc AS (SELECT bins.feature, b, count(curl.value) AS c FROM bins LEFT JOIN curl ON curl.feature = bins.feature AND curl.value >= lo AND (curl.value < hi OR (final AND curl.value = hi)) GROUP BY 1, 2),
cn AS (SELECT feature, count(*) AS n FROM curl GROUP BY 1),
shares AS (SELECT feature, CASE WHEN rc.c = 0 THEN 1e-4::DOUBLE ELSE rc.c / ed.n END AS r, CASE WHEN cc.c = 0 THEN 1e-4::DOUBLE ELSE cc.c / cn.n END AS a
           FROM rc JOIN cc USING (feature, b) JOIN ed USING (feature) JOIN cn USING (feature)),
psi AS (SELECT feature, sum((a - r) * ln(a / r)) AS psi FROM shares GROUP BY 1)"""
DISTANCE_SQL = """,
counts AS (SELECT feature, value, sum(r) AS r, sum(c) AS c FROM (SELECT feature, value, 1 AS r, 0 AS c FROM refl UNION ALL SELECT feature, value, 0, 1 FROM curl) GROUP BY 1, 2),
cdf AS (SELECT feature, value, lead(value) OVER w - value AS gap,
          abs(sum(r) OVER w / sum(r) OVER (PARTITION BY feature) - sum(c) OVER w / sum(c) OVER (PARTITION BY feature)) AS d
        FROM counts WINDOW w AS (PARTITION BY feature ORDER BY value)),
dist AS (SELECT feature, coalesce(sum(d * gap), 0) AS wasserstein FROM cdf GROUP BY 1)"""
STATUS_SQL = """CASE WHEN psi < 0.10 THEN 'No Drift' WHEN psi < 0.25 THEN 'Moderate Shift' ELSE 'Significant Drift' END AS drift_status,
  CASE WHEN psi < 0.10 THEN 'PSI < 0.10' WHEN psi < 0.25 THEN '0.10 <= PSI < 0.25' ELSE 'PSI >= 0.25' END AS threshold, psi >= 0.10 AS drift_detected"""


@query(
    "psi", "D1", "feature:s psi:d",
    EV_SPLIT + _long_sql(["traffic_volume"], "train", "test") + PSI_SQL + " SELECT * FROM psi",
)
def _(spark, folder):
    return drift.single_drift(*event_split(spark, folder), "traffic_volume")


@query(
    "wasserstein", "D2", "feature:s wasserstein:d",
    EV_SPLIT + _long_sql(["traffic_volume"], "train", "test") + DISTANCE_SQL + " SELECT * FROM dist",
)
def _(spark, folder):
    return drift.single_drift(*event_split(spark, folder), "traffic_volume")


DRIFT = "feature:s psi:d wasserstein:d drift_status:s threshold:s drift_detected:b"
CALENDAR = list(CALENDAR_FEATURES)


@query(
    "feature_drift", "D3 P19 J5", f"{DRIFT} reference_mean:d current_mean:d",
    EV_SPLIT + _long_sql(CALENDAR, "train", "test") + PSI_SQL + DISTANCE_SQL
    + f" SELECT feature, psi, wasserstein, {STATUS_SQL}, (SELECT avg(value) FROM refl r WHERE r.feature = psi.feature) AS reference_mean, (SELECT avg(value) FROM curl c WHERE c.feature = psi.feature) AS current_mean FROM psi JOIN dist USING (feature)",
)
def _(spark, folder):
    return drift.feature_drift(*event_split(spark, folder), settings=EVENTS, digits=None, with_means=True)


@query(
    "what_if_drift", "P24 D3", DRIFT,
    EV_SPLIT + _long_sql(["hour=8", "day", "month", "weekday", "is_rush=1"], "test", "test").replace(
        "refl AS (SELECT 'hour' AS feature, CAST(8 AS DOUBLE)", "refl AS (SELECT 'hour' AS feature, CAST(hour AS DOUBLE)"
    ).replace("CAST(1 AS DOUBLE) AS value FROM test), curl", "CAST(is_rush AS DOUBLE) AS value FROM test), curl")
    + PSI_SQL + DISTANCE_SQL + f" SELECT feature, psi, wasserstein, {STATUS_SQL} FROM psi JOIN dist USING (feature)",
)
def _(spark, folder):
    _, test = event_split(spark, folder)
    changed = selection.override(test, {"hour": 8, "is_rush": 1, "not_a_column": 0})
    return drift.feature_drift(test, changed, settings=EVENTS, digits=None)


SUMMARY = "reference_mean:d current_mean:d reference_median:d current_median:d reference_std:d current_std:d reference_q1:d current_q1:d reference_q3:d current_q3:d"
SIDES_SQL = """, sides AS (SELECT (SELECT avg(value) FROM refl) AS reference_mean, (SELECT avg(value) FROM curl) AS current_mean,
  (SELECT median(value) FROM refl) AS reference_median, (SELECT median(value) FROM curl) AS current_median,
  (SELECT stddev_pop(value) FROM refl) AS reference_std, (SELECT stddev_pop(value) FROM curl) AS current_std,
  (SELECT quantile_cont(value, 0.25) FROM refl) AS reference_q1, (SELECT quantile_cont(value, 0.25) FROM curl) AS current_q1,
  (SELECT quantile_cont(value, 0.75) FROM refl) AS reference_q3, (SELECT quantile_cont(value, 0.75) FROM curl) AS current_q3)"""


@query(
    "prediction_drift", "D4", f"{SUMMARY} psi:d wasserstein:d drift_status:s drift_detected:b",
    EV_SCORED + _long_sql(["prediction"], "ref_scored", "scored") + PSI_SQL + DISTANCE_SQL + SIDES_SQL
    + " SELECT sides.*, psi, wasserstein, CASE WHEN psi >= 0.1 THEN 'Drift Detected' ELSE 'Stable' END AS drift_status, psi >= 0.1 AS drift_detected FROM sides, psi, dist",
)
def _(spark, folder):
    return drift.prediction_drift(*scored_events(spark, folder), settings=EVENTS, digits=None)


ALERT_SQL = """ CASE WHEN rmse > 45 THEN 'Performance Degradation Detected' ELSE 'Performance Within Threshold' END AS status, rmse > 45 AS alert_triggered,
  printf(CASE WHEN rmse > 45 THEN 'Monitored RMSE (%.2f) exceeds performance threshold (45.00).' ELSE 'Monitored RMSE (%.2f) is within acceptable threshold (45.00).' END, rmse) AS message """
RMSE_SQL = ", p AS (SELECT sqrt(avg(squared_error)) AS rmse FROM scored)"


@query("alert", "D6 P20", "alert_triggered:b status:s message:s", EV_SCORED + RMSE_SQL + f" SELECT {ALERT_SQL} FROM p")
def _(spark, folder):
    performance = modeling.evaluate_performance(scored_events(spark, folder)[1])
    return drift.alert(performance, EVENTS)


@query(
    "monitoring_summary", "D7 D5", "dataset_label:s monitored_samples:i",
    EV_SCORED + "SELECT 'Late Events' AS dataset_label, count(*) AS monitored_samples FROM scored",
)
def _(spark, folder):
    report = drift.monitoring_report(*scored_events(spark, folder), EVENTS, "Late Events")
    return report["summary"]


FLAT_SQL = (
    EV_SCORED
    + RMSE_SQL
    + _long_sql([*CALENDAR, "traffic_volume_prediction=prediction"], "ref_scored", "scored")
    + PSI_SQL
    + f""", flat AS (SELECT CASE WHEN feature = 'traffic_volume_prediction' THEN 'Prediction Drift (PSI)' ELSE 'Feature Drift (PSI)' END AS metric_type, feature AS feature_name,
    round((SELECT avg(value) FROM refl r WHERE r.feature = psi.feature), 2) AS reference_mean, round((SELECT avg(value) FROM curl c WHERE c.feature = psi.feature), 2) AS current_mean,
    round(psi, 4) AS psi_score, CASE WHEN feature <> 'traffic_volume_prediction' THEN s.drift_status WHEN psi >= 0.1 THEN 'Drift Detected' ELSE 'Stable' END AS drift_status,
    45.0::DOUBLE AS rmse_threshold, round(rmse, 4) AS monitored_rmse, a.alert_triggered, a.message AS alert_message
  FROM (SELECT feature, psi, {STATUS_SQL} FROM psi) s JOIN psi USING (feature, psi), (SELECT rmse, {ALERT_SQL} FROM p) a)"""
)


def _flat(spark, folder):
    report = drift.monitoring_report(*scored_events(spark, folder), EVENTS, "Late Events")
    return drift.flatten_report(report, EVENTS)


@query(
    "monitoring_metrics", "D7 D8 X8 U2",
    "metric_type:s feature_name:s reference_mean:d current_mean:d psi_score:d drift_status:s rmse_threshold:d monitored_rmse:d alert_triggered:b alert_message:s",
    FLAT_SQL + " SELECT * FROM flat",
)
def _(spark, folder):
    return _flat(spark, folder)


@query(
    "monitoring_measures", "B10 B11 B12", "monitored_rmse:d rmse_threshold:d max_feature_psi:d prediction_psi:d alert_color:s",
    FLAT_SQL + """ SELECT max(monitored_rmse) AS monitored_rmse, max(rmse_threshold) AS rmse_threshold, max(psi_score) FILTER (metric_type LIKE 'Feature%') AS max_feature_psi,
      max(psi_score) FILTER (metric_type LIKE 'Prediction%') AS prediction_psi, CASE WHEN bool_or(alert_triggered) THEN '#D9534F' ELSE '#5CB85C' END AS alert_color FROM flat""",
)
def _(spark, folder):
    return measures.evaluate(_flat(spark, folder), measures.monitoring_measures())


@query(
    "drift_labels", "P19 P20", "obs_id:i status:s threshold:s flag:b alert:s",
    EV_SCORED + """SELECT obs_id, CASE WHEN abs_error / 100 < 0.10 THEN 'No Drift' WHEN abs_error / 100 < 0.25 THEN 'Moderate Shift' ELSE 'Significant Drift' END AS status,
      CASE WHEN abs_error / 100 < 0.10 THEN 'PSI < 0.10' WHEN abs_error / 100 < 0.25 THEN '0.10 <= PSI < 0.25' ELSE 'PSI >= 0.25' END AS threshold, abs_error / 100 >= 0.10 AS flag,
      CASE WHEN abs_error > 45 THEN 'Performance Degradation Detected' ELSE 'Performance Within Threshold' END AS alert FROM scored""",
)
def _(spark, folder):
    size = F.col("abs_error") / 100
    return scored_events(spark, folder)[1].withColumns(
        labels.residuals(F.col("traffic_volume"), F.col("prediction"))
    ).select(
        "obs_id",
        labels.drift_status(size, EVENTS).alias("status"),
        labels.drift_threshold_text(size, EVENTS).alias("threshold"),
        labels.drift_detected(size, EVENTS).alias("flag"),
        labels.alert_status(F.col("abs_error"), EVENTS).alias("alert"),
    )


@query(
    "model_metadata", "S10", "reference_dataset_size:i reference_window_start:s reference_window_end:s feature:s rmse:d threshold:d",
    EV_SCORED + """SELECT (SELECT count(*) FROM train) AS reference_dataset_size, (SELECT strftime(min(date_time), '%Y-%m-%d %H:%M:%S') FROM train) AS reference_window_start,
      (SELECT strftime(max(date_time), '%Y-%m-%d %H:%M:%S') FROM train) AS reference_window_end, unnest(['hour', 'day', 'month', 'weekday', 'is_rush']) AS feature,
      (SELECT sqrt(avg(squared_error)) FROM scored) AS rmse, 45.0 AS threshold""",
)
def _(spark, folder):
    """Metadata of the split and its metrics, stored as JSON and read back as nested columns."""
    train, test = scored_events(spark, folder)
    metrics = modeling.regression_metrics(test, rounded=False)
    path = scratch_path(spark, "metadata")
    reports.model_metadata(train, metrics, settings=EVENTS).coalesce(1).write.json(path)
    return datasets.read_model_metadata(spark, path).select(
        "reference_dataset_size",
        "reference_window_start",
        "reference_window_end",
        F.explode("features").alias("feature"),
        F.col("validation_metrics.time_aware_split_85_15.RMSE").alias("rmse"),
        F.col("monitoring_thresholds.rmse_alert_threshold").alias("threshold"),
    )
