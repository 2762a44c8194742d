import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, quality, statistics


@pytest.fixture(scope="module")
def sample(make_series):
    rng = np.random.default_rng(11)
    values = np.round(rng.gamma(2.0, 900.0, 1500) / 50) * 50
    temp = 280.0 + values / 500 + rng.normal(0, 3, 1500)
    weather = rng.choice(["Clear", "Rain", "Snow"], 1500, p=[0.6, 0.3, 0.1])
    return make_series(list(values), temp=[float(x) for x in temp], weather_main=[str(w) for w in weather])


@pytest.fixture(scope="module")
def pdf(sample):
    return sample.toPandas()


def test_descriptive_matches_pandas(sample, pdf):
    row = statistics.descriptive(sample, digits=None).first()
    v = pdf["traffic_volume"]
    assert row.n == 1500
    expected = [v.mean(), v.std(), v.median(), v.quantile(0.25), v.quantile(0.75), v.skew(), v.kurtosis()]
    got = [row.mean, row.std_dev, row.median, row.q1, row.q3, row.skewness, row.kurtosis]
    assert got == pytest.approx(expected, rel=1e-10)


def test_descriptive_display_rounding(sample, pdf):
    row = statistics.descriptive(sample).first()
    assert row.mean == round(pdf["traffic_volume"].mean(), 2)
    assert row.skewness == pytest.approx(pdf["traffic_volume"].skew(), abs=5.1e-5)


def test_empty_and_all_null_targets_raise(make_series, sample):
    with pytest.raises(ValueError):
        statistics.descriptive(sample.filter("false"))
    with pytest.raises(ValueError):
        statistics.descriptive(make_series([None, None]))
    with pytest.raises(ValueError):
        statistics.descriptive(sample.drop("traffic_volume"))


def test_interval_brackets_the_mean(sample):
    row = statistics.confidence_report(sample, replicates=300).first()
    assert row.ci_low < row["mean"] < row.ci_high
    assert row.boot_low < row["mean"] < row.boot_high
    assert row.boot_low == pytest.approx(row.ci_low, abs=0.5 * row.sem)
    assert row.boot_high == pytest.approx(row.ci_high, abs=0.5 * row.sem)


def test_single_row_interval_is_zero():
    assert statistics.mean_interval(1, 5.0, 0.0) == (0.0, 0.0)
    assert statistics.difference_interval(1, 5.0, 0.0, 9, 1.0, 1.0) == (0.0, 0.0)


def test_published_interval():
    """Interval of the published rush-hour mean from its count, mean and deviation."""
    low, high = statistics.mean_interval(12050, 4429.45, 1465.23)
    assert (round(low, 2), round(high, 2)) == (4403.29, 4455.61) or high == pytest.approx(4455.62, abs=0.01)


@pytest.mark.parametrize("partitions", [40])
def test_bootstrap_does_not_depend_on_partitioning(sample, partitions):
    a = statistics.bootstrap_interval(sample, replicates=50).first()
    b = statistics.bootstrap_interval(sample.repartition(partitions), replicates=50).first()
    assert tuple(a) == pytest.approx(tuple(b), rel=1e-12)


def test_bootstrap_spread_with_heavy_ties(spark):
    """Ten thousand copies of two values: replicate means spread like the standard error."""
    df = spark.range(20000).select((F.col("id") % 2).cast("double").alias("traffic_volume"))
    sd = statistics.bootstrap_replicates(df, replicates=600).agg(F.stddev_samp("mean_value")).first()[0]
    assert sd == pytest.approx(0.5 / math.sqrt(20000), rel=0.15)


def test_correlations_match_pandas(sample, pdf):
    features = ["temp", "hour", "weekday", "is_rush"]
    rows = statistics.correlations(sample, features).collect()
    assert [abs(r.pearson_r) for r in rows] == sorted((abs(r.pearson_r) for r in rows), reverse=True)
    ranks = pdf[[*features, "traffic_volume"]].rank()
    for r in rows:
        assert r.pearson_r == pytest.approx(pdf[r.feature].corr(pdf["traffic_volume"]), rel=1e-9)
        assert r.spearman_r == pytest.approx(ranks[r.feature].corr(ranks["traffic_volume"]), rel=1e-9)
        assert r.significant == (r.pearson_p < 0.01)
    matrix = statistics.correlation_matrix(sample, ["traffic_volume", *features]).collect()
    assert len(matrix) == 25 and all(r.r == pytest.approx(1.0) for r in matrix if r.column_a == r.column_b)


def test_correlations_over_blocks(spark, monkeypatch):
    """Many blocks, a third of the rows at one target, another third at one feature value, and a constant feature."""
    monkeypatch.setattr(statistics, "ROWS_PER_BLOCK", 10)
    rng = np.random.default_rng(5)
    n = 3000
    y = np.where(np.arange(n) % 3 == 0, 7.0, np.round(rng.normal(7, 4, n), 2))
    x = np.where(np.arange(n) % 3 == 1, -1.5, np.round(y + rng.normal(0, 6, n), 2))
    frame = pd.DataFrame({"traffic_volume": y, "a": x, "b": rng.integers(0, 4, n), "c": 1})
    df = spark.createDataFrame(frame.sample(frac=1, random_state=1)).repartition(5)
    rows = {r.feature: r for r in statistics.correlations(df, ["a", "b", "c"]).collect()}
    for f in ("a", "b"):
        assert rows[f].n == n
        assert rows[f].pearson_r == pytest.approx(frame[f].corr(frame.traffic_volume), rel=1e-9)
        assert rows[f].spearman_r == pytest.approx(frame[f].rank().corr(frame.traffic_volume.rank()), rel=1e-9)
    assert rows["c"].pearson_r is None and rows["c"].spearman_r is None and not rows["c"].significant


def test_correlations_read_the_facts_once(spark, sample, count_jobs, tmp_path):
    sample.write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        reads.add(1)
        return v

    # Not deterministic: a filter would otherwise call it once more for the same read.
    watched = facts.withColumn("traffic_volume", counted.asNondeterministic()("traffic_volume"))
    rows, jobs = count_jobs(lambda: statistics.correlations(watched, ["temp", "hour"]).collect())
    assert len(rows) == 2 and reads.value == facts.count() and jobs <= 12


def test_correlations_without_complete_rows(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (float("nan"), 1.0)], "traffic_volume double, a double")
    assert statistics.correlations(df, ["a"]).collect() == []
    df = spark.createDataFrame([(1.0, 3.0)], "traffic_volume double, a double")
    assert statistics.correlations(df, ["a"]).first().pearson_r is None


def brute_two_sample(a, b):
    both = pd.concat([a, b], keys=["a", "b"])
    ranks = both.rank()
    n1, n2 = len(a), len(b)
    u = ranks["a"].sum() - n1 * (n1 + 1) / 2
    z = [abs(x - x.median()) for x in (a, b)]
    zbar = pd.concat(z).mean()
    between = sum(len(x) * (x.mean() - zbar) ** 2 for x in z)
    within = sum(((x - x.mean()) ** 2).sum() for x in z)
    pooled = math.sqrt(((n1 - 1) * a.var() + (n2 - 1) * b.var()) / (n1 + n2 - 2))
    return {
        "mann_whitney_u": u,
        "levene_statistic": (n1 + n2 - 2) * between / within,
        "welch_t": (a.mean() - b.mean()) / math.sqrt(a.var() / n1 + b.var() / n2),
        "cohens_d": (a.mean() - b.mean()) / pooled,
        "rank_biserial": 1 - 2 * u / (n1 * n2),
        "median1": a.median(),
        "median2": b.median(),
    }


def test_two_sample_reports_match_brute_force(sample, pdf):
    v = pdf["traffic_volume"]
    for report, mask in ((statistics.rush_test(sample), pdf["is_rush"] == 1), (statistics.weekday_test(sample), pdf["weekday"] < 5)):
        row = report.first()
        for name, expected in brute_two_sample(v[mask], v[~mask]).items():
            assert row[name] == pytest.approx(expected, rel=1e-9), name
        assert row.n1 + row.n2 == 1500
        assert row.mean1_ci_low < row.mean1 < row.mean1_ci_high


def test_swapping_groups_complements_u(sample):
    a = statistics.two_sample(sample, F.col("is_rush") == 1).first()
    b = statistics.two_sample(sample, F.col("is_rush") == 0).first()
    assert a.mann_whitney_u + b.mann_whitney_u == a.n1 * a.n2
    assert a.welch_t == pytest.approx(-b.welch_t)
    assert a.mann_whitney_p == pytest.approx(b.mann_whitney_p)


def test_known_mann_whitney(make_series):
    """Ten rows against nine with one tie; U by its definition, a count over pairs."""
    x = [19, 22, 16, 29, 24, 31, 18, 25, 27, 20]
    y = [20, 11, 17, 12, 15, 10, 13, 14, 9]
    df = make_series(x + y).withColumn("g", F.col("obs_id") < 10)
    row = statistics.two_sample(df, F.col("g")).first()
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    assert row.mann_whitney_u == u
    n, ties = 19, 6
    s = math.sqrt(90 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert row.mann_whitney_p == pytest.approx(math.erfc((u - 45 - 0.5) / s / math.sqrt(2)))


def test_constant_groups_do_not_fail(make_series):
    df = make_series([5.0] * 48)
    row = statistics.rush_test(df).first()
    assert row.cohens_d == 0.0 and row.mann_whitney_p == 1.0 and math.isnan(row.welch_t)
    with pytest.raises(ValueError, match="both groups"):
        statistics.rush_test(df.filter("is_rush = 1"))


def test_category_test_matches_brute_force(sample, pdf):
    row = statistics.category_test(sample).first()
    v = pdf["traffic_volume"]
    groups = [g for _, g in v.groupby(pdf["weather_main"])]
    n, k = len(v), len(groups)
    between = sum(len(g) * (g.mean() - v.mean()) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert row.anova_f == pytest.approx(between / (k - 1) / (within / (n - k)), rel=1e-9)
    ranks = v.rank()
    squares = sum(r.sum() ** 2 / len(r) for _, r in ranks.groupby(pdf["weather_main"]))
    counts = v.value_counts()
    h = (12 / (n * (n + 1)) * squares - 3 * (n + 1)) / (1 - (counts**3 - counts).sum() / (n**3 - n))
    assert row.kruskal_h == pytest.approx(h, rel=1e-9)
    assert (row.categories, row.n) == (3, 1500)


def test_quality_profiles(make_series, sample, pdf):
    assert quality.negative_count(make_series([-1, 0, 5])).first()[0] == 1
    outliers = quality.iqr_outliers(sample).first()
    q1, q3 = pdf["traffic_volume"].quantile([0.25, 0.75])
    high = (pdf["traffic_volume"] > q3 + 1.5 * (q3 - q1)).sum()
    assert (outliers.q1, outliers.outliers_above) == (q1, high)
    doubled = sample.select("weather_main", "is_rush")
    row = quality.duplicate_profile(doubled).first()
    assert row.duplicate_count == 1500 - doubled.distinct().count()
    nulls = {r.column_name: r.missing_count for r in quality.null_profile(make_series([1, None, None])).collect()}
    assert nulls["traffic_volume"] == 2 and nulls["hour"] == 0
    with pytest.raises(ValueError, match="'hour' outside 0 to 23"):
        quality.require_ranges(sample.withColumn("hour", F.lit(99)))
    assert quality.require_ranges(sample) is sample


def test_histogram_counts_every_row(sample, make_series):
    bins = aggregates.histogram(sample).collect()
    assert len(bins) == 50 and sum(b["count"] for b in bins) == 1500
    constant = aggregates.histogram(make_series([7, 7, 7]), bins=4).collect()
    assert sum(b["count"] for b in constant) == 3


def test_density_integrates_to_one(sample):
    rows = aggregates.density(sample).orderBy("point").collect()
    step = rows[1].x - rows[0].x
    assert sum(r.density for r in rows) * step == pytest.approx(1.0, abs=0.05)


def test_density_of_far_apart_values(make_series):
    """Kernels that reach no grid point between two clusters leave zeros, not gaps."""
    rows = aggregates.density(make_series([0.0, 1e-6] * 2000 + [1e6])).orderBy("point").collect()
    assert len(rows) == 200 and rows[0].density > 0


def test_bucket_shares_sum_to_100(sample):
    assert sum(r.percentage for r in aggregates.bucket_shares(sample, digits=None).collect()) == pytest.approx(100.0)


def test_missing_weekday_keeps_a_null_row(make_series):
    rows = aggregates.weekday_means(make_series([1.0] * 24)).collect()
    assert [r.weekday_name for r in rows][:2] == ["Monday", "Tuesday"]
    assert [r.avg_traffic_volume for r in rows] == [1.0] + [None] * 6
    pivot = aggregates.hour_weekday_pivot(make_series([1.0] * 48))
    assert pivot.columns == ["hour", "Monday", "Tuesday"]


def test_shift_falls_back_to_the_overall_mean(make_series):
    row = aggregates.conditional_shift(make_series([4.0, 6.0])).first()
    assert (row.rush_mean, row.non_rush_mean, row.rush_pct_shift) == (5.0, 5.0, 0.0)


@pytest.mark.parametrize("mean", [3, 9, 10, 40, 41, 700, 10**7])
def test_resampling_weights_are_poisson(spark, mean):
    """Mean, variance and third moment of the draws for one count, whichever way they are made."""
    draws = 20000
    key = [F.lit(1.5), F.col("id"), F.lit(42)]
    if mean < 10:
        one = [statistics._poisson_one(statistics._uniform(*key, F.lit(i))) for i in range(1, mean + 1)]
        draw = sum(one[1:], one[0]).cast("double")
    else:
        draw = statistics._poisson(F.lit(float(mean)), key).cast("double")
    values = np.array([r[0] for r in spark.range(draws).select(draw).collect()])
    z = (values - mean) / math.sqrt(mean)
    assert abs(z.mean()) < 5 / math.sqrt(draws)
    assert z.var() == pytest.approx(1, abs=0.06)
    assert (z**3).mean() == pytest.approx(1 / math.sqrt(mean), abs=0.15)


def test_kruskal_keeps_its_digits_for_large_counts(spark):
    """Groups of near equal ranks: H is tiny against the terms it used to be the difference of."""
    rows = [(c, float(v), n) for c, v, n in [("a", 1, 3000), ("a", 2, 3001), ("b", 1, 3002), ("b", 2, 3000), ("c", 1, 3000), ("c", 2, 3000)]]
    df = spark.createDataFrame(rows, "weather_main string, traffic_volume double, n int")
    df = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).select("weather_main", "traffic_volume")
    h = statistics.category_test(df).first().kruskal_h
    n, low = 18003, 9002
    groups = {"a": (3000, 3001), "b": (3002, 3000), "c": (3000, 3000)}
    mid1, mid2 = (low + 1) / 2, low + (n - low + 1) / 2
    square = sum((x * mid1 + y * mid2 - (x + y) * (n + 1) / 2) ** 2 / (x + y) for x, y in groups.values())
    ties = low**3 - low + (n - low) ** 3 - (n - low)
    assert h == pytest.approx(12 / (n * (n + 1)) * square / (1 - ties / (n**3 - n)), rel=1e-9)
