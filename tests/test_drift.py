import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import drift, measures, modeling, selection


def brute_psi(expected, actual, bins=10, eps=1e-4):
    edges = np.unique(np.percentile(expected, np.linspace(0, 100, bins + 1)))
    if len(edges) <= 1:
        edges = np.array([min(expected) - 1, max(expected) + 1])
    shares = [np.histogram(x, bins=edges)[0] / len(x) for x in (expected, actual)]
    r, a = [np.where(s == 0, eps, s) for s in shares]
    return float(np.sum((a - r) * np.log(a / r)))


def brute_distance(a, b):
    points = np.sort(np.concatenate([a, b]))
    f, g = [np.searchsorted(np.sort(x), points[:-1], side="right") / len(x) for x in (a, b)]
    return float(np.sum(np.abs(f - g) * np.diff(points)))


def column(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double")


def drift_of(spark, a, b, **options):
    return drift.single_drift(column(spark, a), column(spark, b), "v", **options).first()


CASES = {
    "same": (np.arange(100), np.arange(100)),
    "shifted": (np.arange(100), np.arange(100) + 30),
    "outside": (np.arange(50), np.arange(200, 260)),
    "ties": (np.repeat([0, 1], [75, 25]), np.repeat([0, 1], [10, 90])),
    "constant": (np.full(40, 7), np.full(10, 7.5)),
    "normal": (np.random.default_rng(1).normal(3000, 1000, 1000), np.random.default_rng(2).normal(5000, 1000, 1000)),
}


def test_drift_matches_brute_force(spark):
    """All cases side by side as columns; shorter ones are padded with nulls, which do not count."""

    def table(side):
        length = max(len(c[side]) for c in CASES.values())
        rows = [
            tuple(float(c[side][i]) if i < len(c[side]) else None for c in CASES.values()) for i in range(length)
        ]
        return spark.createDataFrame(rows, ", ".join(f"{name} double" for name in CASES))

    paired = drift.paired_counts(table(0), table(1), list(CASES))
    scores = {r.feature: r for r in drift.drift_table(paired, drift.sides(paired)).collect()}
    for name, (a, b) in CASES.items():
        assert scores[name].psi == pytest.approx(brute_psi(a, b), abs=1e-9), name
        assert scores[name].wasserstein == pytest.approx(brute_distance(a, b), abs=1e-9), name
        assert scores[name].reference_std == pytest.approx(np.std(a), abs=1e-9), name
        assert scores[name].current_std == pytest.approx(np.std(b), abs=1e-9), name


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.integers(0, 30), min_size=1, max_size=60),
    st.lists(st.integers(-5, 40), min_size=1, max_size=60),
)
def test_drift_property(spark, a, b):
    row = drift_of(spark, a, b)
    assert row.psi == pytest.approx(brute_psi(a, b), abs=1e-9)
    assert row.wasserstein == pytest.approx(brute_distance(np.array(a, float), np.array(b, float)), abs=1e-9)
    assert row.psi >= -1e-12


def test_empty_side_has_no_psi(spark):
    row = drift_of(spark, [1, 2, 3], [])
    assert row.psi == 0.0


def test_open_ends_and_categories_see_what_the_default_misses(spark):
    a, b = CASES["outside"]
    assert drift_of(spark, a, b, open_ends=True).psi > 0.25
    a, b = CASES["ties"]
    paired = drift.paired_counts(column(spark, a), column(spark, b), ["v"])
    assert drift.psi(paired).first().psi == pytest.approx(0.0)
    assert drift.psi(paired, categorical=["v"]).first().psi > 0.25


@pytest.fixture(scope="module")
def reference(spark):
    rng = np.random.default_rng(42)
    rows = [
        (int(h), int(d), int(m), int(w), int(r), float(v))
        for h, d, m, w, r, v in zip(
            rng.integers(0, 24, 1000), rng.integers(1, 31, 1000), rng.integers(1, 13, 1000),
            rng.integers(0, 7, 1000), rng.integers(0, 2, 1000), rng.integers(500, 5000, 1000),
        )
    ]
    schema = "hour int, day int, month int, weekday int, is_rush int, traffic_volume double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def current(reference):
    return selection.fixed_sample(reference, 500, reference.columns)


def test_feature_table(reference, current):
    rows = drift.feature_drift(reference, current).collect()
    assert len(rows) == 5 and all(r.psi >= 0 for r in rows)
    assert {r.drift_status for r in rows} == {"No Drift"}


def test_bad_inputs_raise(spark, reference, current):
    with pytest.raises(ValueError, match="lacks the columns"):
        drift.feature_drift(reference, current.drop("is_rush"))
    with pytest.raises(ValueError, match="'hour' outside 0 to 23"):
        drift.feature_drift(reference, current.withColumn("hour", F.lit(99)))
    with pytest.raises(ValueError, match="not given|no values"):
        drift.feature_drift(reference, current.filter("false"))
    with pytest.raises(ValueError, match="not given|no values"):
        drift.feature_drift(reference, None)
    with pytest.raises(ValueError, match="not given|no values"):
        drift.prediction_drift(column(spark, []), column(spark, [1]), "v")


def test_override_is_detected(reference, current):
    forced = selection.override(current, {"hour": 8, "is_rush": 1})
    rows = {r.feature: r for r in drift.feature_drift(reference, forced).collect()}
    assert rows["hour"].drift_detected and rows["hour"].psi >= 0.10
    assert not rows["is_rush"].drift_detected
    forced_rush = drift.feature_drift(reference, forced, categorical=["is_rush"]).collect()
    assert {r.feature: r.drift_detected for r in forced_rush}["is_rush"]


def test_shifted_predictions_are_flagged(spark):
    a, b = CASES["normal"]
    row = drift.prediction_drift(column(spark, a), column(spark, b), "v").first()
    assert row.drift_detected and row.drift_status == "Drift Detected"
    assert row.reference_std == pytest.approx(np.std(a), abs=0.01)
    assert row.current_median == pytest.approx(np.median(b), abs=0.01)
    assert row.reference_q1 == pytest.approx(np.percentile(a, 25), abs=0.01)


def test_bad_predictions_raise_the_alert(spark):
    rows = [(3000.0, 1000.0), (4000.0, 1000.0), (5000.0, 1000.0), (2000.0, 5000.0), (1000.0, 5000.0)]
    df = spark.createDataFrame(rows, "traffic_volume double, prediction double")
    performance = modeling.evaluate_performance(df)
    assert performance.first().samples == 5
    alert = drift.alert(performance).first()
    assert alert.alert_triggered and alert.status == "Performance Degradation Detected"


def test_report_and_flat_table(reference, current):
    scored = [df.withColumn("prediction", F.col("traffic_volume") + 10.0) for df in (reference, current)]
    report = drift.monitoring_report(*scored, label="Batch 7")
    assert report["summary"].first().monitored_samples == 500
    assert report["summary"].first().dataset_label == "Batch 7"
    flat = drift.flatten_report(report).collect()
    assert len(flat) == 6
    assert {r.monitored_rmse for r in flat} == {10.0} and not any(r.alert_triggered for r in flat)
    values = measures.evaluate(drift.flatten_report(report), measures.monitoring_measures()).first()
    assert (values.monitored_rmse, values.rmse_threshold, values.alert_color) == (10.0, 550.0, "#5CB85C")


def test_report_without_actuals(reference, current):
    scored = [df.withColumn("prediction", F.col("traffic_volume")) for df in (reference, current)]
    report = drift.monitoring_report(scored[0], scored[1].drop("traffic_volume"), Settings(rmse_threshold=1.0))
    assert report["performance_metrics"] is None and report["alert"] is None
    row = drift.flatten_report(report).first()
    assert row.monitored_rmse is None and row.alert_message == "Normal"


def test_many_values_are_cut_into_blocks(spark, monkeypatch):
    """Running totals over blocks give what one window gives; ties and an outer range included."""
    monkeypatch.setattr(drift, "ROWS_PER_BLOCK", 50)
    rng = np.random.default_rng(8)
    a, b = np.round(rng.normal(0, 40, 3000), 1), np.round(rng.normal(5, 50, 2000), 1)
    paired = drift.paired_counts(column(spark, a).repartition(9), column(spark, b), ["v"])
    known = drift.sides(paired)
    assert len(known["v"].cuts) > 8
    found = drift.shapes(paired, known, {("v", "ref"): [0.25, 0.5], ("v", "cur"): [0.75]})["v"]
    assert found.wasserstein == pytest.approx(brute_distance(a, b), abs=1e-9)
    assert found.quantile("ref", 3000, 0.25) == pytest.approx(np.percentile(a, 25))
    assert found.quantile("ref", 3000, 0.5) == pytest.approx(np.median(a))
    assert found.quantile("cur", 2000, 0.75) == pytest.approx(np.percentile(b, 75))
    assert drift.psi(paired, known=known).first().psi == pytest.approx(brute_psi(a, b), abs=1e-9)


def test_a_report_takes_few_jobs(spark, reference, current):
    """Counts, three aggregates; parts of the report are local tables afterwards. With adaptive execution every
    shuffle is a job of its own."""
    scored = [df.withColumn("prediction", F.col("traffic_volume") + 10.0) for df in (reference, current)]
    spark.sparkContext.setJobGroup("report", "jobs of a report")
    try:
        report = drift.monitoring_report(*scored)
        built = len(spark.sparkContext.statusTracker().getJobIdsForGroup("report"))
        drift.flatten_report(report).collect()
        total = len(spark.sparkContext.statusTracker().getJobIdsForGroup("report"))
    finally:
        spark.sparkContext.setJobGroup("other", "")
    assert 0 < built <= 10 and total - built <= 3
