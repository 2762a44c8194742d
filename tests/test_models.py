import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import CALENDAR_FEATURES, Settings
from tidemark.operators import errors, kpis, modeling, selection, windows


@pytest.fixture(scope="module")
def cycle(make_series):
    """Six weeks with a daily and a weekly cycle and a little noise."""
    rng = np.random.default_rng(5)
    hours = np.arange(24 * 42)
    day = (hours // 24) % 7
    volumes = 3000 + 2000 * np.sin((hours % 24 - 6) / 24 * 2 * math.pi) - 800 * (day >= 5) + rng.normal(0, 60, len(hours))
    return make_series(list(volumes))


@pytest.fixture(scope="module")
def split(cycle):
    return modeling.chronological_split(cycle)


def test_chronological_split_is_exact(cycle, split):
    train, test = split
    n = cycle.count()
    assert (train.count(), test.count()) == (int(n * 0.85), n - int(n * 0.85))
    assert train.agg(F.max("date_time")).first()[0] < test.agg(F.min("date_time")).first()[0]


@pytest.mark.parametrize("hours", [[0] * 100, [i // 30 for i in range(100)]])
def test_split_among_tied_times(make_series, hours):
    train, test = modeling.chronological_split(make_series(range(100), hours))
    assert train.count() == 85
    assert train.agg(F.max("obs_id")).first()[0] < test.agg(F.min("obs_id")).first()[0]


def test_split_summary(cycle):
    rows = {r.split: r for r in modeling.split_summary(cycle).collect()}
    assert rows["train"].row_count + rows["test"].row_count == 24 * 42
    assert rows["train"].window_start == datetime(2024, 1, 1)


def test_random_split_survives_repartitioning(cycle):
    a = {r.obs_id for r in selection.random_split(cycle, 0.85, ["obs_id"])[0].select("obs_id").collect()}
    b = {r.obs_id for r in selection.random_split(cycle.repartition(37), 0.85, ["obs_id"])[0].select("obs_id").collect()}
    assert a == b and 0.8 < len(a) / (24 * 42) < 0.9
    c = {r.obs_id for r in selection.random_split(cycle, 0.85, ["obs_id"], seed=7)[0].select("obs_id").collect()}
    assert a != c


def test_fixed_sample_is_seeded(cycle):
    a = {r.obs_id for r in selection.fixed_sample(cycle, 50, ["obs_id"]).collect()}
    assert a == {r.obs_id for r in selection.fixed_sample(cycle.repartition(9), 50, ["obs_id"]).collect()}
    assert len(a) == 50


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(3.0, 2.0), (5.0, 5.0), (1.0, 4.0)], "traffic_volume double, prediction double")
    row = modeling.regression_metrics(df).first()
    assert (row.samples, row.mae, row.mse, row.rmse) == (3, 1.3333, 3.33, 1.8257)
    assert row.r2 == pytest.approx(1 - 10 / 8, abs=1e-6)
    with pytest.raises(ValueError):
        modeling.evaluate_performance(df.filter("false"))


def test_forecast_beats_the_baselines(cycle):
    features = windows.forecasting_features(cycle)
    table, scored, model = modeling.forecast_comparison(features, trees=15)
    rows = {r.model_name: r for r in table.collect()}
    assert len(rows) == 3
    forest = rows[modeling.LAG_FOREST]
    assert forest.r2 > 0.80 and forest.model_type == "ML Forecasting Model"
    assert forest.rmse < rows[modeling.NAIVE_HOUR].rmse
    assert scored.count() == features.count() - int(features.count() * 0.85)
    importances = modeling.feature_importances(cycle.sparkSession, model).collect()
    assert len(importances) == 10 and sum(r.importance for r in importances) == pytest.approx(1.0)


def test_model_tables(cycle, split):
    rows = {r.model: r for r in modeling.compare_models(*split, trees=10).collect()}
    assert set(rows) == {"Linear Regression", "Decision Tree", "Random Forest"}
    assert rows["Random Forest"].r2 > 0.8 > rows["Linear Regression"].r2
    methods = modeling.compare_splits(cycle, ["obs_id"], trees=5).collect()
    assert {r.validation_method for r in methods} == {modeling.RANDOM_METHOD, modeling.CHRONOLOGICAL_METHOD}
    sets = modeling.compare_feature_sets(
        cycle.withColumn("temp", F.col("hour") * 1.0), ["obs_id"], ["temp"], trees=5
    ).collect()
    assert len(sets) == 2 and all(r.r2 > 0.5 for r in sets)


@pytest.mark.parametrize("learner", [modeling.decision_tree, lambda: modeling.random_forest(1, modeling.UNBOUNDED).setBootstrap(False)])
def test_an_unbounded_tree_has_a_leaf_for_every_value(spark, learner):
    """Also for values too rare for a sample of the rows, and for more values than the usual bins."""
    step = F.when(F.col("id") < 200, F.col("id") * 10).otherwise(F.lit(2000) + F.col("id") % 3 * 10)
    rows = spark.range(40_000).select(step.cast("double").alias("step"), (step + 3).alias("traffic_volume"))
    found = modeling.predict(modeling.fit(rows, learner(), ["step"]), rows)
    assert found.filter(F.abs(F.col("prediction") - F.col("traffic_volume")) > 1e-6).count() == 0


def test_batch_scoring_after_reload(spark, split, tmp_path):
    train, test = split
    model = modeling.fit(train, modeling.random_forest(5), CALENDAR_FEATURES)
    modeling.save_model(model, str(tmp_path / "model"))
    loaded = modeling.load_model(str(tmp_path / "model"))
    text = spark.createDataFrame([("05-02-2024 08:00",), ("05-02-2024 17:00",)], "date_time string")
    scored = modeling.score_batch(loaded, text).collect()
    assert [r.hour for r in scored] == [8, 17] and all(r.Prediction > 0 for r in scored)
    assert scored[0].flow_class in {"Smooth Traffic Flow", "Moderate Traffic", "Heavy Traffic"}
    with pytest.raises(ValueError, match="lacks the columns"):
        modeling.score_batch(loaded, spark.range(3))
    curve = modeling.diurnal_curve(spark, loaded).collect()
    assert [r.hour for r in curve] == list(range(24)) and {r.weekday for r in curve} == {2}


def test_unseen_cells_get_the_overall_mean(make_series):
    train = make_series([10.0, 20.0])
    row = modeling.group_mean_predictor(train, make_series([1.0], hours=[5]), ["hour"]).first()
    assert row.prediction == 15.0
    with pytest.raises(ValueError, match="not calendar features"):
        modeling.group_mean_predictor(train, train, ["traffic_volume"])


@pytest.fixture(scope="module")
def scored(split):
    train, test = split
    return modeling.group_mean_predictor(train, test, ["hour"])


def test_segments_cover_the_holdout(scored):
    rows = errors.full_report(errors.holdout(scored)).collect()
    by_type = {}
    for r in rows:
        by_type.setdefault(r.segment_type, []).append(r)
    assert len(by_type["Hour of Day"]) == 24
    assert {sum(r.sample_count for r in part) for part in by_type.values()} == {scored.count()}
    single = {r.segment_value: tuple(r) for r in errors.segment_report(errors.holdout(scored), "hour").collect()}
    assert single == {r.segment_value: tuple(r) for r in by_type["Hour of Day"]}


def test_empty_holdout_raises(scored):
    with pytest.raises(ValueError):
        errors.segment_report(errors.holdout(scored.filter("false")), "hour")


def test_out_of_range_volumes_have_no_right_closed_bucket(scored):
    odd = scored.withColumn("traffic_volume", F.when(F.col("hour") == 0, 20000.0).otherwise(F.col("traffic_volume")))
    counted = sum(r.sample_count for r in errors.bucket_report(odd).collect())
    assert counted == odd.filter("hour <> 0").count()


def test_kpi_table(cycle, scored):
    features = windows.forecasting_features(cycle)
    comparison, _, _ = modeling.forecast_comparison(features, trees=5)
    rows = {r.kpi_name: r for r in kpis.business_kpis(cycle, errors.holdout(scored), comparison).collect()}
    assert len(rows) == 24
    assert rows["Average Traffic Volume (veh/hr)"].kpi_category == "Demand Profile"
    assert rows["Forecasting Model Accuracy (Short-Term Lags)"].kpi_value.startswith("ML Lag RF MAE: ")
    assert rows["Top Peak Demand Hours"].kpi_value.count(":00 (") == 3
    pdf = cycle.toPandas()
    assert rows["Peak Single-Hour Volume (veh/hr)"].kpi_value == str(pdf["traffic_volume"].max())


@pytest.mark.parametrize("limit", [1, 1 << 15])
def test_demand_kpis_over_blocks(spark, make_series, monkeypatch, limit):
    """Also where volumes are cut into blocks and a third of the rows share one."""
    monkeypatch.setattr(kpis, "ROWS_PER_BLOCK", limit)
    rng = np.random.default_rng(3)
    volumes = [None if i % 50 == 0 else 300.0 if i % 3 == 0 else float(v) for i, v in enumerate(rng.integers(0, 900, 2001))]
    df = make_series(volumes)
    pdf = df.toPandas()
    row = kpis.demand_kpis(df.repartition(7), Settings(low=200, heavy=600)).first()
    v = pdf.traffic_volume
    assert (row.median_volume, row.peak_volume, row.total_count) == (v.median(), v.max(), len(pdf))
    assert row.avg_volume == pytest.approx(v.mean()) and row.rush_mean == pytest.approx(v[pdf.is_rush == 1].mean())
    assert row.weekend_mean == pytest.approx(v[pdf.weekday >= 5].mean())
    assert (row.low_count, row.heavy_count) == ((v < 200).sum(), (v >= 600).sum())
    best = v.groupby(pdf.hour).mean().sort_values(ascending=False, kind="stable").head(3)
    assert row.top_hours == ", ".join(f"{h:02d}:00 ({m:.0f} veh/hr)" for h, m in best.items())


def test_demand_kpis_need_volumes(make_series):
    with pytest.raises(ValueError, match="no values"):
        kpis.demand_kpis(make_series([None, None]).filter("obs_id < 1"))
    with pytest.raises(ValueError, match="no values"):
        kpis.demand_kpis(make_series([1, 2]).filter("traffic_volume > 5"))


def test_kpi_table_takes_few_jobs_and_one_read(spark, make_series, count_jobs):
    df = make_series([float(i % 40) for i in range(400)])
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        reads.add(1)
        return v

    facts = df.withColumn("traffic_volume", counted("traffic_volume"))
    scored = errors.with_residuals(df.withColumn("prediction", F.lit(20.0)))
    rows, jobs = count_jobs(lambda: kpis.business_kpis(facts, scored).collect())
    assert len(rows) == 24 and reads.value == 400 and jobs <= 12


def test_model_kpis_of_no_rows(spark):
    none = errors.with_residuals(spark.createDataFrame([], "hour int, traffic_volume double, prediction double"))
    row = kpis.model_kpis(none).first()
    assert (row.total_samples, row.underpred_count, row.mae, row.worst_hours) == (0, 0, None, "")


def test_ties_are_neither_under_nor_over(spark):
    rows = [(5.0, 5.0), (6.0, 5.0), (4.0, 5.0), (9.0, 5.0)]
    df = errors.with_residuals(spark.createDataFrame(rows, "traffic_volume double, prediction double"))
    row = kpis.error_kpis(df, Settings(low=2, heavy=6)).first()
    assert (row.underpred_count, row.overpred_count, row.underpred_pct) == (2, 1, 50.0)
    assert (row.heavy_mae, row.heavy_bias) == (2.5, 2.5)


def test_executive_kpis_of_five_rows(make_series):
    df = make_series([100, 200, 300, 400, 500], hours=[7, 8, 12, 13, 24 * 5 + 17])
    row = kpis.executive_kpis(df).first()
    assert (row.avg_traffic, row.median_traffic, row.peak_traffic) == (300.0, 300.0, 500.0)
    assert (row.rush_mean, row.non_rush_mean) == (266.67, 350.0)
    assert (row.weekday_mean, row.weekend_mean) == (250.0, 500.0)


def test_forecast_kpis_from_two_rows(spark):
    rows = [("ML Lag Random Forest Model", 158.14, 240.38, 0.9853), ("Naive Prev-Hour Persistence (Lag 1h)", 485.95, 740.42, 0.8608)]
    row = kpis.forecast_kpis(spark.createDataFrame(rows, "model_name string, mae double, rmse double, r2_score double")).first()
    assert row.ml_mae == 158.14 and row.naive_mae == 485.95
    assert row.mae_reduction_pct == pytest.approx(67.46, abs=0.05)


def test_residual_diagnostics(scored):
    row = modeling.residual_diagnostics(scored).first()
    pdf = scored.toPandas()
    r = pdf["traffic_volume"] - pdf["prediction"]
    assert row.mean_residual == pytest.approx(r.mean())
    assert row.median_residual == pytest.approx(r.median())
    assert row.skewness == pytest.approx(r.skew())


@pytest.mark.parametrize("missing", [0, 10, 99])
def test_split_and_summary_agree_on_rows_without_a_time(make_series, missing):
    df = make_series(range(100)).withColumn("date_time", F.when(F.col("obs_id") >= missing, F.col("date_time")))
    train, test = modeling.chronological_split(df)
    rows = {r.split: r.row_count for r in modeling.split_summary(df).collect()}
    assert (train.count(), test.count()) == (rows["train"], rows["test"]) == (85, 15)
    assert test.filter("date_time IS NULL").count() == min(missing, 15)
