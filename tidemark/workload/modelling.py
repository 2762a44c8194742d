"""Splits, models, error analysis and KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import BUCKET_SEGMENT, CALENDAR_FEATURES, SEGMENT_TYPES
from tidemark.operators import aggregates, errors, kpis, modeling, quality, selection, windows
from tidemark.plans import star
from tidemark.session import materialize, scratch_path
from tidemark.sources import prediction_log
from tidemark.workload.inputs import (
    EV,
    EV_FORECAST,
    EV_SCORED,
    EV_SPLIT,
    EVENTS,
    event_split,
    events,
    hourly,
    hourly_weather,
    scored_events,
    scored_forecast,
    series,
)
from tidemark.workload.registry import query

# The documented forest.
TREES = 200


@query(
    "chrono_split_summary", "M1 M2", "split:s row_count:i row_pct:d window_start:t window_end:t",
    EV_SPLIT + """SELECT 'train' AS split, count(*) AS row_count, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ev) AS row_pct, min(date_time) AS window_start, max(date_time) AS window_end FROM train
    UNION ALL SELECT 'test', count(*), count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ev), min(date_time), max(date_time) FROM test""",
)
def _(spark, folder):
    return modeling.split_summary(events(spark, folder), EVENTS)


@query("chrono_split_rows", "M1", "obs_id:i date_time:t", EV_SPLIT + "SELECT obs_id, date_time FROM test")
def _(spark, folder):
    return event_split(spark, folder)[1]


@query(
    "random_split", "M3", "obs_id:i side:s",
    EV + "SELECT obs_id, CASE WHEN CAST('0x' || substr(md5(concat_ws(':', obs_id::VARCHAR, '42')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.85 THEN 'train' ELSE 'test' END AS side FROM ev",
)
def _(spark, folder):
    train, test = selection.random_split(events(spark, folder), 0.85, ["obs_id"], 42)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


METRICS = "samples:i mae:d mse:d rmse:d r2:d"


def _metrics_sql(table: str, actual: str, predicted: str) -> str:
    return (
        f"count(*) AS samples, avg(abs({actual} - {predicted})) AS mae, avg(pow({actual} - {predicted}, 2)) AS mse, "
        f"sqrt(avg(pow({actual} - {predicted}, 2))) AS rmse, 1 - avg(pow({actual} - {predicted}, 2)) / var_pop({actual}) AS r2 FROM {table}"
    )


@query(
    "naive_baselines", "M8 M9", f"model_name:s {METRICS}",
    EV_FORECAST + f"SELECT '{modeling.NAIVE_HOUR}' AS model_name, {_metrics_sql('forecast', 'actual_traffic_volume', 'naive_lag1h_pred')}"
    + f" UNION ALL SELECT '{modeling.NAIVE_DAY}', {_metrics_sql('forecast', 'actual_traffic_volume', 'naive_lag24h_pred')}",
)
def _(spark, folder):
    features = materialize(windows.forecasting_features(series(spark, folder)), "features")
    _, test = modeling.chronological_split(features, EVENTS)
    return modeling.regression_metrics(modeling.naive_baselines(test), by=["model_name"], rounded=False)


@query("holdout_metrics", "M9 D5", METRICS, EV_SCORED + "SELECT " + _metrics_sql("scored", "traffic_volume", "prediction"))
def _(spark, folder):
    return modeling.regression_metrics(scored_events(spark, folder)[1], rounded=False)


LINE_SQL = """, line AS (SELECT regr_slope(traffic_volume, hour) AS b, regr_intercept(traffic_volume, hour) AS a FROM {train})"""


@query(
    "linear_regression_scoring", "M4 M15 S13", "obs_id:i Prediction:d",
    EV_SPLIT + LINE_SQL.format(train="train") + " SELECT obs_id, a + b * hour AS \"Prediction\" FROM test, line",
)
def _(spark, folder):
    """Fitted on the early rows, saved, loaded again, and applied to the late rows."""
    train, test = event_split(spark, folder)
    path = scratch_path(spark, "linear-model")
    modeling.save_model(modeling.fit(train, modeling.linear_regression(), ["hour"]), path)
    batch = test.select("obs_id", "date_time")
    return modeling.score_batch(modeling.load_model(path), batch, EVENTS)


@query(
    "decision_tree_scoring", "M5", "obs_id:i prediction:d",
    EV_SPLIT + "SELECT obs_id, cell AS prediction FROM test JOIN cells USING (hour)",
)
def _(spark, folder):
    """An unbounded tree on one feature ends with a leaf per hour, so it predicts the hour's mean."""
    train, test = event_split(spark, folder)
    return modeling.predict(modeling.fit(train, modeling.decision_tree(), ["hour"]), test)


@query("forest_forecast", "M6 M7 M8 M9 M17", f"model_type:s model_name:s {METRICS}")
def _(spark, folder):
    features = windows.forecasting_features(hourly(spark, folder), ["date_time"])
    table, _, _ = modeling.forecast_comparison(materialize(features, "features"), TREES, EVENTS)
    return table


@query("model_comparison", "M4 M5 M6 M10", f"model:s {METRICS}")
def _(spark, folder):
    train, test = modeling.chronological_split(hourly(spark, folder), EVENTS)
    return modeling.compare_models(train, test, trees=TREES)


@query("split_comparison", "M3 M6 M11", f"validation_method:s {METRICS}")
def _(spark, folder):
    return modeling.compare_splits(hourly(spark, folder), ["date_time"], trees=TREES, settings=EVENTS)


@query("feature_set_comparison", "M12", "feature_set:s r2:d rmse:d")
def _(spark, folder):
    df = hourly_weather(spark, folder)
    return modeling.compare_feature_sets(df, ["date_time"], trees=TREES, settings=EVENTS)


STEP_SQL = "floor(lag_1h / 10.0::DOUBLE) * 10"


@query(
    "lag_forest_of_one_tree", "M7 M17", "obs_id:i prediction:d",
    EV_FORECAST + f""",
steps AS (SELECT {STEP_SQL} AS step, avg(traffic_volume) AS cell FROM ftrain GROUP BY 1),
bounds AS (SELECT cell, (lag(step) OVER w + step) / 2 AS above, (lead(step) OVER w + step) / 2 AS upto FROM steps WINDOW w AS (ORDER BY step))
SELECT obs_id, cell AS prediction FROM (SELECT *, {STEP_SQL} AS step FROM ftest) t
JOIN bounds ON (above IS NULL OR step > above) AND (upto IS NULL OR step <= upto)""",
)
def _(spark, folder):
    """A forest on a lag feature whose values are determined: one unbounded tree without bootstrap, on the lag in
    steps of ten, predicts the mean of the early rows of a step; steps it has not seen go to the nearest one."""
    features = materialize(windows.forecasting_features(series(spark, folder)), "features")
    stepped = features.withColumn("lag_step", F.floor(F.col("lag_1h") / 10.0) * 10.0)
    train, test = modeling.chronological_split(stepped, EVENTS)
    return modeling.predict(modeling.fit(train, _one_tree(), ["lag_step"]), test)


@query(
    "forest_of_one_tree", "M6", "obs_id:i prediction:d",
    EV_SPLIT + "SELECT obs_id, cell AS prediction FROM test JOIN cells USING (hour)",
)
def _(spark, folder):
    """Without bootstrap, one unbounded tree of a forest on the hour predicts the hour's mean."""
    train, test = event_split(spark, folder)
    return modeling.predict(modeling.fit(train, _one_tree(), ["hour"]), test)


@query("feature_importances", "M13", "feature:s importance:d")
def _(spark, folder):
    train, _ = modeling.chronological_split(hourly(spark, folder), EVENTS)
    model = modeling.fit(train, modeling.random_forest(TREES), CALENDAR_FEATURES)
    return modeling.feature_importances(spark, model)


def _one_tree(depth: int = modeling.UNBOUNDED):
    """A forest of one tree on all rows: its splits are determined."""
    return modeling.random_forest(trees=1, depth=depth).setBootstrap(False)


def _rounded_metrics_sql(table: str) -> str:
    return (
        "samples, round(mae, 4) AS mae, round(mse, 2) AS mse, round(rmse, 4) AS rmse, round(r2, 6) AS r2 "
        f"FROM (SELECT {_metrics_sql(table, 'traffic_volume', 'prediction')})"
    )


@query(
    "model_comparison_determined", "M4 M5 M6 M10", f"model:s {METRICS}",
    EV_SPLIT + LINE_SQL.format(train="train") + ", lined AS (SELECT traffic_volume, a + b * hour AS prediction FROM test, line), celled AS (SELECT traffic_volume, cell AS prediction FROM test JOIN cells USING (hour)) "
    + " UNION ALL ".join(f"SELECT '{name}' AS model, {_rounded_metrics_sql(t)}" for name, t in (("Linear Regression", "lined"), ("Decision Tree", "celled"), ("Random Forest", "celled"))),
)
def _(spark, folder):
    """The comparison over learners on the hour whose predictions are determined: the line and the hour's means."""
    learners = {
        "Linear Regression": modeling.linear_regression(),
        "Decision Tree": modeling.decision_tree(),
        "Random Forest": _one_tree(),
    }
    return modeling.compare_models(*event_split(spark, folder), ["hour"], learners=learners)


RANDOM_SQL = f"""
sides AS (SELECT *, (weekday >= 5)::INTEGER AS weekend, CAST('0x' || substr(md5(concat_ws(':', obs_id::VARCHAR, '{EVENTS.seed}')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < {EVENTS.train_share} AS drawn FROM ev),
by_hour AS (SELECT hour, avg(traffic_volume) AS prediction FROM sides WHERE drawn GROUP BY ALL),
by_both AS (SELECT hour, weekend, avg(traffic_volume) AS prediction FROM sides WHERE drawn GROUP BY ALL),
random_hour AS (SELECT traffic_volume, prediction FROM sides JOIN by_hour USING (hour) WHERE NOT drawn),
random_both AS (SELECT traffic_volume, prediction FROM sides JOIN by_both USING (hour, weekend) WHERE NOT drawn)"""


@query(
    "split_comparison_determined", "M3 M6 M11", f"validation_method:s {METRICS}",
    EV_SPLIT + "," + RANDOM_SQL + f", late AS (SELECT traffic_volume, cell AS prediction FROM test JOIN cells USING (hour)) SELECT '{modeling.RANDOM_METHOD}' AS validation_method, {_rounded_metrics_sql('random_hour')} UNION ALL SELECT '{modeling.CHRONOLOGICAL_METHOD}', {_rounded_metrics_sql('late')}",
)
def _(spark, folder):
    """Both splits with a forest of one tree on the hour, which predicts the hour's mean."""
    df = series(spark, folder)
    return modeling.compare_splits(df, ["obs_id"], ["hour"], settings=EVENTS, learner=_one_tree())


@query(
    "feature_set_comparison_determined", "M12", "feature_set:s r2:d rmse:d",
    EV + "," + RANDOM_SQL + f" SELECT 'Temporal Only (Baseline)' AS feature_set, {_rounded_metrics_sql('random_hour')} UNION ALL SELECT 'Temporal + Weather', {_rounded_metrics_sql('random_both')}",
)
def _(spark, folder):
    """The hour alone against hour and weekend: an unbounded tree predicts the mean of each cell."""
    df = series(spark, folder).withColumn("weekend", (F.col("weekday") >= 5).cast("int"))
    return modeling.compare_feature_sets(
        df, ["obs_id"], ["weekend"], settings=EVENTS, base=["hour"], learner=modeling.decision_tree()
    )


def _best_splits_sql(name: str, rows: str) -> str:
    """Per node of ``rows`` (node, f, x, y) the split of all features' values that lowers the squares most."""
    return f"""{name}_values AS (SELECT node, f, x, count(*)::DOUBLE AS n, sum(y) AS s FROM {rows} GROUP BY ALL),
{name}_sums AS (SELECT node, f, x, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER g AS nn, sum(s) OVER g AS ss
  FROM {name}_values WINDOW w AS (PARTITION BY node, f ORDER BY x), g AS (PARTITION BY node, f)),
{name}_gains AS (SELECT node, f, x, sl * sl / nl + pow(ss - sl, 2) / (nn - nl) - ss * ss / nn AS gain FROM {name}_sums WHERE nn > nl),
{name} AS (SELECT node, arg_max(f, gain) AS f, arg_max(x, gain) AS x, max(gain) AS gain FROM {name}_gains GROUP BY node)"""


@query(
    "feature_importances_of_one_tree", "M13", "feature:s importance:d",
    EV_SPLIT + ", long AS (" + " UNION ALL ".join(f"SELECT obs_id, 0 AS node, '{f}' AS f, {f} AS x, traffic_volume - (SELECT avg(traffic_volume) FROM train) AS y FROM train" for f in CALENDAR_FEATURES) + "), "
    + _best_splits_sql("top", "long")
    + ", halves AS (SELECT obs_id, CASE WHEN long.x <= top.x THEN 1 ELSE 2 END AS half FROM long JOIN top USING (f)), lower AS (SELECT half AS node, f, x, y FROM long JOIN halves USING (obs_id)), "
    + _best_splits_sql("second", "lower")
    + ", used AS (SELECT f, gain FROM top UNION ALL SELECT f, gain FROM second) SELECT f AS feature, coalesce(sum(gain) / (SELECT sum(gain) FROM used), 0) AS importance FROM (SELECT DISTINCT f FROM long) LEFT JOIN used USING (f) GROUP BY f",
)
def _(spark, folder):
    """A tree of two levels on all calendar features: its importances are the squares that its three splits
    remove, which SQL finds by trying every split."""
    train, _ = event_split(spark, folder)
    return modeling.feature_importances(spark, modeling.fit(train, _one_tree(2), CALENDAR_FEATURES))


@query(
    "diurnal_curve", "M16", "hour:i prediction:d",
    EV_SPLIT + LINE_SQL.format(train="train") + " SELECT h AS hour, a + b * h AS prediction FROM range(24) AS r(h), line",
)
def _(spark, folder):
    train, _ = event_split(spark, folder)
    return modeling.diurnal_curve(spark, modeling.fit(train, modeling.linear_regression(), ["hour"]))


@query(
    "residual_diagnostics", "M14", "n:i mean_residual:d std_residual:d median_residual:d min_residual:d max_residual:d skewness:d",
    EV_SCORED + """SELECT count(*) AS n, avg(error) AS mean_residual, stddev_samp(error) AS std_residual, median(error) AS median_residual,
      min(error) AS min_residual, max(error) AS max_residual, skewness(error) AS skewness FROM scored""",
)
def _(spark, folder):
    return modeling.residual_diagnostics(scored_events(spark, folder)[1])


@query(
    "holdout_errors", "E1 P16", "obs_id:i hour:i prediction:d error:d abs_error:d squared_error:d",
    EV_SCORED + "SELECT * FROM scored",
)
def _(spark, folder):
    return errors.with_residuals(scored_events(spark, folder)[1])


REPORT = "segment_type:s segment_value:s sample_count:i mae:d rmse:d mean_bias_error:d bias_direction:s"
CUT = "CASE WHEN traffic_volume <= 20 THEN 'Low (<20)' WHEN traffic_volume <= 100 THEN 'Moderate (20-100)' ELSE 'Heavy (>=100)' END"
BUCKET = "CASE WHEN traffic_volume < 20 THEN 'Low (<20)' WHEN traffic_volume < 100 THEN 'Moderate (20-100)' ELSE 'Heavy (>=100)' END"


def _segment_sql(kind: str, value: str) -> str:
    return f"""SELECT '{kind}' AS segment_type, {value}::VARCHAR AS segment_value, {value}::VARCHAR AS segment_label, count(*) AS sample_count, avg(abs_error) AS mae,
      sqrt(avg(squared_error)) AS rmse, avg(error) AS mean_bias_error,
      CASE WHEN avg(error) > 2 THEN 'Underprediction (Actual > Pred)' WHEN avg(error) < -2 THEN 'Overprediction (Pred > Actual)' ELSE 'Unbiased (Near Zero)' END AS bias_direction
      FROM scored GROUP BY {value}"""


@query("error_by_hour", "E2 P17", REPORT, EV_SCORED + _segment_sql("Hour of Day", "hour"))
def _(spark, folder):
    rows = errors.with_residuals(scored_events(spark, folder)[1])
    return errors.segment_report(rows, "hour", EVENTS, digits=None)


@query("error_by_bucket", "E3 P10 P17", REPORT, EV_SCORED + _segment_sql(BUCKET_SEGMENT, CUT))
def _(spark, folder):
    return errors.bucket_report(scored_events(spark, folder)[1], EVENTS, digits=None)


@query(
    "error_full_report", "E4 A16", REPORT,
    EV_SCORED + " UNION ALL ".join(_segment_sql(t, BUCKET if s == "volume_bucket" else s) for s, t in SEGMENT_TYPES.items()),
)
def _(spark, folder):
    rows = errors.holdout(scored_events(spark, folder)[1], EVENTS)
    return errors.full_report(rows, settings=EVENTS, digits=None)


STACKED = "segment_type:s segment_value:s segment_label:s sample_count:i mae:d rmse:d mean_bias_error:d bias_direction:s"
STACKED_SQL = EV_SCORED + " UNION ALL ".join(
    _segment_sql(SEGMENT_TYPES[s], CUT if s == "volume_bucket" else s)
    for s in ("volume_bucket", "hour", "is_rush", "weekday")
)


@query("error_analysis_stacked", "U1 X6 A16 P23", STACKED, STACKED_SQL)
def _(spark, folder):
    return star.error_analysis(scored_events(spark, folder)[1], EVENTS, digits=None)


@query(
    "prediction_balance", "A15", "total_samples:i underpred_count:i overpred_count:i underpred_pct:d overpred_pct:d",
    EV_SCORED + """SELECT count(*) AS total_samples, count(*) FILTER (traffic_volume > prediction) AS underpred_count, count(*) FILTER (traffic_volume < prediction) AS overpred_count,
      underpred_count * 100.0::DOUBLE / count(*) AS underpred_pct, overpred_count * 100.0::DOUBLE / count(*) AS overpred_pct FROM scored""",
)
def _(spark, folder):
    return aggregates.prediction_balance(scored_events(spark, folder)[1], "traffic_volume", "prediction")


DEMAND_SQL = """, d AS (SELECT avg(traffic_volume) AS avg_volume, median(traffic_volume) AS median_volume, max(traffic_volume) AS peak_volume,
  avg(traffic_volume) FILTER (is_rush = 1) AS rush_mean, avg(traffic_volume) FILTER (is_rush = 0) AS non_rush_mean,
  avg(traffic_volume) FILTER (weekday < 5) AS weekday_mean, avg(traffic_volume) FILTER (weekday >= 5) AS weekend_mean,
  count(*) FILTER (traffic_volume < 20) AS low_count, count(*) FILTER (traffic_volume >= 20 AND traffic_volume < 100) AS moderate_count,
  count(*) FILTER (traffic_volume >= 100) AS heavy_count, count(*) AS total_count FROM {t}),
th AS (SELECT string_agg(printf('%02d:00 (%.0f veh/hr)', hour, m), ', ' ORDER BY m DESC, hour) AS top_hours FROM (SELECT hour, avg(traffic_volume) AS m FROM {t} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)),
tm AS (SELECT string_agg(printf('%s (%.0f veh/hr)', ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month], m), ', ' ORDER BY m DESC, month) AS top_months FROM (SELECT month, avg(traffic_volume) AS m FROM {t} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3))
"""


@query(
    "demand_kpis", "E5 A11 A12 O2 P27",
    "avg_volume:d median_volume:d peak_volume:d rush_mean:d non_rush_mean:d rush_diff:d rush_pct:d weekday_mean:d weekend_mean:d weekday_diff:d weekday_pct:d "
    "low_count:i moderate_count:i heavy_count:i total_count:i top_hours:s top_months:s",
    EV + DEMAND_SQL.format(t="ev") + """SELECT *, rush_mean - non_rush_mean AS rush_diff, rush_diff * 100 / non_rush_mean AS rush_pct,
      weekday_mean - weekend_mean AS weekday_diff, weekday_diff * 100 / weekend_mean AS weekday_pct FROM d, th, tm""",
)
def _(spark, folder):
    return kpis.demand_kpis(events(spark, folder), EVENTS)


ERROR_KPIS = "total_samples:i underpred_count:i overpred_count:i underpred_pct:d overpred_pct:d mean_bias:d mae:d rmse:d heavy_mae:d heavy_rmse:d heavy_bias:d"
ERROR_SQL = """, e AS (SELECT count(*) AS total_samples, count(*) FILTER (traffic_volume > prediction) AS underpred_count, count(*) FILTER (traffic_volume < prediction) AS overpred_count,
  avg(error) AS mean_bias, avg(abs_error) AS mae, sqrt(avg(squared_error)) AS rmse, avg(abs_error) FILTER (traffic_volume >= 100) AS heavy_mae,
  sqrt(avg(squared_error) FILTER (traffic_volume >= 100)) AS heavy_rmse, avg(error) FILTER (traffic_volume >= 100) AS heavy_bias FROM scored),
wh AS (SELECT string_agg(printf('%02d:00 (MAE %.1f)', hour, m), ', ' ORDER BY m DESC, hour) AS worst_hours FROM (SELECT hour, avg(abs_error) AS m FROM scored GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3))
"""


@query(
    "error_kpis", "E10 A15", ERROR_KPIS,
    EV_SCORED + ERROR_SQL + "SELECT *, underpred_count * 100.0::DOUBLE / total_samples AS underpred_pct, overpred_count * 100.0::DOUBLE / total_samples AS overpred_pct FROM e",
)
def _(spark, folder):
    return kpis.error_kpis(errors.with_residuals(scored_events(spark, folder)[1]), EVENTS)


@query(
    "model_kpis", "E6 O2", f"{ERROR_KPIS} worst_hours:s",
    EV_SCORED + ERROR_SQL + "SELECT *, underpred_count * 100.0::DOUBLE / total_samples AS underpred_pct, overpred_count * 100.0::DOUBLE / total_samples AS overpred_pct FROM e, wh",
)
def _(spark, folder):
    return kpis.model_kpis(errors.with_residuals(scored_events(spark, folder)[1]), None, EVENTS)


KPI_ROWS_SQL = """SELECT 'Demand Profile' AS kpi_category, unnest(['Top Peak Demand Hours', 'Highest Demand Months',
    'Rush vs Non-Rush Demand Difference', 'Weekday vs Weekend Demand Difference',
    'Low-Volume Hours (<20) Count (%)', 'Moderate-Volume Hours (20-99) Count (%)', 'Heavy-Volume Hours (>=100) Count (%)',
    'Average Traffic Volume (veh/hr)', 'Median Traffic Volume (veh/hr)', 'Peak Single-Hour Volume (veh/hr)', 'Rush-Hour Mean Volume (veh/hr)', 'Non-Rush-Hour Mean Volume (veh/hr)',
    'Weekday Mean Volume (veh/hr)', 'Weekend Mean Volume (veh/hr)']) AS kpi_name,
  unnest([top_hours, top_months,
    printf('%+.2f veh/hr (%+.2f%%)', rush_mean - non_rush_mean, (rush_mean - non_rush_mean) / non_rush_mean * 100),
    printf('%+.2f veh/hr (%+.2f%%)', weekday_mean - weekend_mean, (weekday_mean - weekend_mean) / weekend_mean * 100),
    printf('%d (%.2f%%)', low_count, low_count::DOUBLE / total_count * 100), printf('%d (%.2f%%)', moderate_count, moderate_count::DOUBLE / total_count * 100),
    printf('%d (%.2f%%)', heavy_count, heavy_count::DOUBLE / total_count * 100),
    round(avg_volume, 2)::VARCHAR, round(median_volume, 2)::VARCHAR, peak_volume::VARCHAR, round(rush_mean, 2)::VARCHAR, round(non_rush_mean, 2)::VARCHAR,
    round(weekday_mean, 2)::VARCHAR, round(weekend_mean, 2)::VARCHAR]) AS kpi_value FROM d, th, tm
UNION ALL SELECT 'Model Performance & Bias', unnest(['Chronological Holdout Model MAE', 'Chronological Holdout Model RMSE', 'Forecasting Model Accuracy (Short-Term Lags)',
    'Highest Error Hours', 'Underpredictions Count (%)', 'Overpredictions Count (%)', 'Overall Mean Bias Error', 'Heavy-Volume (>=100) MAE', 'Heavy-Volume (>=100) RMSE', 'Heavy-Volume Mean Bias Error']),
  unnest([round(mae, 2)::VARCHAR, round(rmse, 2)::VARCHAR, NULL, worst_hours, printf('%d (%.2f%%)', underpred_count, underpred_count::DOUBLE / total_samples * 100),
    printf('%d (%.2f%%)', overpred_count, overpred_count::DOUBLE / total_samples * 100), printf('%+.2f veh/hr', mean_bias), round(heavy_mae, 2)::VARCHAR, round(heavy_rmse, 2)::VARCHAR,
    printf('%+.2f veh/hr (Positive bias indicates underprediction during peak surges)', heavy_bias)]) FROM e, wh"""


@query("kpi_long", "E7 X7 A14 P27", "kpi_category:s kpi_name:s kpi_value:s", EV_SCORED + DEMAND_SQL.format(t="ev") + ERROR_SQL + KPI_ROWS_SQL)
def _(spark, folder):
    rows = errors.with_residuals(scored_events(spark, folder)[1])
    return kpis.business_kpis(events(spark, folder), rows, None, EVENTS)


EXECUTIVE = "avg_traffic:d median_traffic:d peak_traffic:d rush_mean:d non_rush_mean:d weekday_mean:d weekend_mean:d rush_diff:d rush_pct_shift:d weekday_diff:d weekday_pct_shift:d"


@query(
    "executive_kpis_filtered", "E8 P21 A11", EXECUTIVE,
    EV + """SELECT avg(traffic_volume) AS avg_traffic, median(traffic_volume) AS median_traffic, max(traffic_volume) AS peak_traffic,
      coalesce(avg(traffic_volume) FILTER (is_rush = 1), avg_traffic) AS rush_mean, coalesce(avg(traffic_volume) FILTER (is_rush = 0), avg_traffic) AS non_rush_mean,
      avg(traffic_volume) FILTER (weekday < 5) AS weekday_mean, avg(traffic_volume) FILTER (weekday >= 5) AS weekend_mean,
      rush_mean - non_rush_mean AS rush_diff, rush_diff / non_rush_mean * 100 AS rush_pct_shift, weekday_mean - weekend_mean AS weekday_diff, weekday_diff / weekend_mean * 100 AS weekday_pct_shift
      FROM ev WHERE is_rush = 1 AND date_time >= TIMESTAMP '2024-01-08'""",
)
def _(spark, folder):
    sliced = selection.slice_observations(events(spark, folder), start="2024-01-08", rush=True)
    return kpis.executive_kpis(sliced, EVENTS, None)


PERFORMANCE_SQL = "SELECT '{strategy}' AS evaluation_strategy, '{model}' AS model_name, '{features}' AS features_used, '85/15 Time-Sorted' AS train_test_split, mae, rmse, r2 AS r2_score FROM (SELECT {metrics})"


def _performance_sql() -> str:
    parts = []
    for row, table, actual, predicted in (
        ("holdout", "scored", "traffic_volume", "prediction"),
        ("forecast", "forecast", "actual_traffic_volume", "ml_rf_forecast_pred"),
        ("naive", "forecast", "actual_traffic_volume", "naive_lag1h_pred"),
    ):
        strategy, model, features = star.PERFORMANCE_ROWS[row]
        parts.append(
            PERFORMANCE_SQL.format(
                strategy=strategy, model=model, features=features, metrics=_metrics_sql(table, actual, predicted)
            )
        )
    both = EV_FORECAST + EV_SCORED[len(EV):].replace("numbered", "numbered_all")
    return both + ", perf AS (" + " UNION ALL ".join(parts) + ") "


PERFORMANCE = "evaluation_strategy:s model_name:s features_used:s train_test_split:s mae:d rmse:d r2_score:d"


def _performance(spark, folder):
    forecast = star.demand_forecast(scored_forecast(spark, folder))
    return star.model_performance(scored_events(spark, folder)[1], forecast, EVENTS, rounded=False)


@query("model_performance", "X5 U2 M9", PERFORMANCE, _performance_sql() + "SELECT * FROM perf")
def _(spark, folder):
    return _performance(spark, folder)


@query(
    "forecast_kpis", "E9 J4 P22", "ml_mae:d ml_rmse:d ml_r2:d naive_mae:d mae_reduction_pct:d",
    _performance_sql() + """SELECT max(mae) FILTER (model_name LIKE 'ML Lag%') AS ml_mae, max(rmse) FILTER (model_name LIKE 'ML Lag%') AS ml_rmse, max(r2_score) FILTER (model_name LIKE 'ML Lag%') AS ml_r2,
      max(mae) FILTER (model_name LIKE 'Naive%') AS naive_mae, round((naive_mae - ml_mae) * 100 / naive_mae, 2) AS mae_reduction_pct FROM perf""",
)
def _(spark, folder):
    return kpis.forecast_kpis(_performance(spark, folder))


@query(
    "model_metrics_long", "A13", "model_name:s metric:s value:d",
    _performance_sql() + "SELECT model_name, 'MAE (veh/hr)' AS metric, mae AS value FROM perf UNION ALL SELECT model_name, 'RMSE (veh/hr)', rmse FROM perf",
)
def _(spark, folder):
    names = {"mae": "MAE (veh/hr)", "rmse": "RMSE (veh/hr)"}
    return aggregates.long_metrics(_performance(spark, folder), ["model_name"], names)


@query(
    "prediction_log_latest", "S11 S12", "hour:i day:i month:i weekday:i is_rush:i predicted_traffic_volume:d actual_traffic_volume:d model_version:s",
    EV_SCORED + "SELECT hour, day, month, weekday, is_rush, prediction AS predicted_traffic_volume, traffic_volume AS actual_traffic_volume, 'v1.0.0' AS model_version FROM scored ORDER BY date_time DESC, obs_id DESC LIMIT 100",
)
def _(spark, folder):
    train, test = scored_events(spark, folder)
    path = scratch_path(spark, "prediction-log")
    older = F.lit("2024-01-01").cast("timestamp_ntz")
    prediction_log.append_predictions(train, path, logged_at=older)
    prediction_log.append_predictions(selection.chronological(test), path, actual="traffic_volume")
    return prediction_log.latest_predictions(spark, path)


@query(
    "guarded_quality", "Q10 S2 P25", "samples:i mae:d",
    EV_SCORED + "SELECT count(*) AS samples, avg(abs_error) AS mae FROM scored",
)
def _(spark, folder):
    rows = scored_events(spark, folder)[1]
    quality.require_ranges(quality.require_rows(rows, "holdout"))
    return modeling.regression_metrics(quality.require_values(rows, "traffic_volume"), rounded=False)


@query(
    "forecast_mae_by_hour", "X4 M9", "hour:i mae_ml:d mae_naive:d",
    EV_FORECAST + "SELECT hour, avg(ml_rf_abs_error) AS mae_ml, avg(naive_lag1h_abs_error) AS mae_naive FROM forecast GROUP BY 1",
)
def _(spark, folder):
    return (
        star.demand_forecast(scored_forecast(spark, folder))
        .groupBy("hour")
        .agg(F.avg("ml_rf_abs_error").alias("mae_ml"), F.avg("naive_lag1h_abs_error").alias("mae_naive"))
    )


