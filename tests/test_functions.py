import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import calendar, labels
from tidemark.functions import distributions as dist


def test_day_first_parse_accepts_all_spellings(spark):
    texts = ["03-04-2016 07:00", "03/04/2016 07:00:00", "2016-04-03 07:00:00", "2016-04-03T07:00:00", "13-04-2016", "nonsense"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(calendar.parse_time(F.col("t"))).collect()]
    assert got[:4] == [datetime(2016, 4, 3, 7)] * 4
    assert got[4] == datetime(2016, 4, 13) and got[5] is None


def test_calendar_features(spark):
    times = [datetime(2024, 1, 1, 7, 30), datetime(2024, 1, 7, 16), datetime(2024, 12, 31, 19)]
    df = spark.createDataFrame([(t,) for t in times], "date_time timestamp_ntz")
    rows = calendar.with_calendar_names(calendar.with_calendar(df)).collect()
    assert [r.weekday for r in rows] == [t.weekday() for t in times]
    assert [r.is_rush for r in rows] == [1, 0, 1]
    assert [r.is_weekday for r in rows] == [1, 0, 1]
    assert [r.weekday_name for r in rows] == ["Monday", "Sunday", "Tuesday"]
    assert [r.month_name for r in rows] == ["Jan", "Jan", "Dec"]
    start = df.select(calendar.hour_start(F.col("date_time"))).first()[0]
    assert start == datetime(2024, 1, 1, 7)


def test_bucket_edges_differ_between_the_two_modes(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 1999.0, 2000.0, 5000.0, 10000.0, 10001.0)], "v double")
    left = [r[0] for r in df.select(labels.volume_bucket(F.col("v"))).collect()]
    right = [r[0] for r in df.select(labels.volume_bucket_right_closed(F.col("v"))).collect()]
    low, moderate, heavy = "Low (<2000)", "Moderate (2000-5000)", "Heavy (>=5000)"
    assert left == [low, low, low, moderate, heavy, heavy, heavy]
    assert right == [None, low, low, low, moderate, heavy, None]
    assert config.DEFAULTS.moderate_export_label == "Moderate (2000-4999)"


def test_bias_and_alert_limits_are_strict(spark):
    df = spark.createDataFrame([(50.0,), (50.1,), (-50.0,), (-50.1,)], "b double")
    got = [r[0] for r in df.select(labels.bias_direction(F.col("b"))).collect()]
    assert got == [config.UNBIASED, config.UNDERPREDICTION, config.UNBIASED, config.OVERPREDICTION]
    df = spark.createDataFrame([(550.0,), (550.01,)], "r double")
    got = df.select(labels.alert_triggered(F.col("r")), labels.alert_message(F.col("r"))).collect()
    assert [r[0] for r in got] == [False, True]
    assert got[0][1] == "Monitored RMSE (550.00) is within acceptable threshold (550.00)."
    assert got[1][1] == "Monitored RMSE (550.01) exceeds performance threshold (550.00)."


def test_drift_status_limits(spark):
    df = spark.createDataFrame([(0.0999,), (0.1,), (0.25,)], "p double")
    got = [tuple(r) for r in df.select(labels.drift_status(F.col("p")), labels.drift_threshold_text(F.col("p"))).collect()]
    assert got == [
        ("No Drift", "PSI < 0.10"),
        ("Moderate Shift", "0.10 <= PSI < 0.25"),
        ("Significant Drift", "PSI >= 0.25"),
    ]


def test_guarded_division_and_texts(spark):
    row = spark.range(1).select(
        labels.divide(F.lit(1.0), F.lit(0.0)).alias("zero"),
        labels.divide(F.lit(None).cast("double"), F.lit(1.0)).alias("null"),
        labels.shift_text(F.lit(1559.92), F.lit(54.36)).alias("shift"),
        labels.share_text(F.lit(15216), F.lit(48187)).alias("share"),
        labels.p_text(F.lit(1e-10)).alias("tiny"),
        labels.p_text(F.lit(0.04567)).alias("plain"),
    ).first()
    assert (row.zero, row.null) == (0.0, 0.0)
    assert row["shift"] == "+1559.92 veh/hr (+54.36%)"
    assert row.share == "15216 (31.58%)"
    assert (row.tiny, row.plain) == ("1.0000e-10", "0.0457")


def test_effect_size_follows_the_value():
    assert labels.effect_size(0.8348).startswith("Large")
    assert labels.effect_size(-0.4965).startswith("Small")
    assert labels.effect_size(0.1).startswith("Negligible")


@pytest.mark.parametrize("t,df", [(0.3, 2), (2.5, 7), (-12.0, 40), (1.96, 48186), (55.6, 20000)])
def test_t_tail_matches_commons_math(spark, t, df):
    x = df / (df + t * t)
    theirs = spark._jvm.org.apache.commons.math3.special.Beta.regularizedBeta(x, df / 2.0, 0.5)
    assert dist.t_two_sided(t, df) == pytest.approx(theirs, rel=1e-9, abs=1e-300)


def test_other_tails_match_commons_math(spark):
    special = spark._jvm.org.apache.commons.math3.special
    for f, a, b in [(1.4, 4, 9995), (97.2941, 10, 48176), (0.2, 3, 12)]:
        theirs = special.Beta.regularizedBeta(b / (b + a * f), b / 2.0, a / 2.0)
        assert dist.f_upper(f, a, b) == pytest.approx(theirs, rel=1e-8)
    for x, k in [(3.58, 4), (889.87, 10), (0.1, 2), (30.0, 30)]:
        assert dist.chi2_upper(x, k) == pytest.approx(special.Gamma.regularizedGammaQ(k / 2.0, x / 2.0), rel=1e-9)
    students = spark._jvm.org.apache.commons.math3.distribution.TDistribution(17.0)
    assert dist.t_quantile(0.95, 17) == pytest.approx(students.inverseCumulativeProbability(0.975), rel=1e-8)


def test_published_p_values():
    """Statistics and p-values of the published result tables."""
    assert dist.f_upper(97.2941, 10, 48187 - 11) == pytest.approx(1.4813e-200, rel=2e-3)
    assert dist.chi2_upper(889.87, 10) == pytest.approx(9.6399e-185, rel=1e-3)
    assert dist.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert dist.normal_two_sided(1.959963984540054) == pytest.approx(0.05)


@pytest.mark.parametrize("df", [1e2, 1e3, 1e5, 1.9e5, 2.1e5, 1e7, 1e9, 1e11, 1e13])
def test_t_quantiles_approach_the_normal_one(df):
    z = 1.959963984540054
    terms = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    expansion = z + sum(t / df ** (k + 1) for k, t in enumerate(terms))
    assert dist.t_quantile(0.95, df) == pytest.approx(expansion, abs=2e-8 if df < 1e3 else 1e-9)


@pytest.mark.parametrize("df", [1e7, 1e9, 1e11, 1e13])
def test_f_tail_approaches_the_chi_square_tail(df):
    assert dist.f_upper(2.6, 3, df) == pytest.approx(dist.chi2_upper(7.8, 3), rel=100 / df + 1e-9)


def test_tails_agree_on_both_sides_of_the_expansions(monkeypatch):
    cases = [(dist.chi2_upper, (x, 210000.0)) for x in (207000.0, 210000.0, 210300.0, 213000.0)]
    cases += [(dist.f_upper, (f, 3, 300000.0)) for f in (0.1, 1.0, 2.6, 9.0)]
    cases += [(dist.t_two_sided, (t, 300000.0)) for t in (0.01, 1.0, 3.0, 6.0)]
    expanded = [f(*args) for f, args in cases]
    monkeypatch.setattr(dist, "_LARGE_BETA", 1e18)
    monkeypatch.setattr(dist, "_LARGE_GAMMA", 1e18)
    assert expanded == pytest.approx([f(*args) for f, args in cases], rel=1e-9)


def test_the_median_of_a_wide_chi_square_is_near_a_half():
    for df in (1e6, 1e9, 1e12):
        assert dist.chi2_upper(df, df) == pytest.approx(0.5, abs=1 / math.sqrt(df))


def test_loops_that_do_not_converge_raise(monkeypatch):
    monkeypatch.setattr(dist, "_STEPS", 5)
    with pytest.raises(ArithmeticError):
        dist.chi2_upper(1000.0, 1000.0)
    with pytest.raises(ArithmeticError):
        dist.t_two_sided(0.5, 5000.0)
