import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import errors, measures, modeling, quality
from tidemark.plans import reports, star, views
from tidemark.sources import datasets
from tidemark.streaming import jobs


@pytest.fixture(scope="module")
def base(make_series):
    rng = np.random.default_rng(8)
    hours = np.arange(24 * 60)
    volumes = np.round(3500 + 2500 * np.sin((hours % 24 - 6) / 24 * 2 * np.pi) + rng.normal(0, 100, len(hours)))
    return make_series(
        list(volumes),
        temp=[float(t) for t in 273.15 + rng.normal(5, 4, len(hours))],
        rain_1h=[float(r) for r in rng.random(len(hours))],
        weather_main=[str(w) for w in rng.choice(["Clear", "Rain"], len(hours))],
    )


@pytest.fixture(scope="module")
def exported(base, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("star"))
    reports.export_star(base, folder, trees=5, sample=200)
    return folder


def test_all_ten_tables_load(spark, exported):
    tables = datasets.load_all(spark, exported)
    assert set(tables) == set(datasets.REQUIRED_COLUMNS)
    assert tables["dim_time"].count() == 24
    assert tables["model_performance"].count() == 3
    assert tables["monitoring_metrics"].count() == 6
    assert tables["business_kpis"].count() == 24
    assert tables["error_analysis"].filter("segment_type = 'Month of Year'").count() == 0


def test_csv_export_loads_with_types(spark, base, tmp_path):
    star.write_table(star.traffic_daily(base), str(tmp_path), "traffic_daily", fmt="csv")
    star.write_table(star.traffic_hourly(base), str(tmp_path), "traffic_hourly", "year", fmt="csv")
    daily = datasets.load_dataset(spark, "traffic_daily", str(tmp_path), "csv")
    assert sorted(map(tuple, daily.collect())) == sorted(map(tuple, star.traffic_daily(base).collect()))
    hourly = dict(datasets.load_dataset(spark, "traffic_hourly", str(tmp_path), "csv").dtypes)
    assert (hourly["date_time"], hourly["traffic_volume"], hourly["hour"]) == ("timestamp_ntz", "double", "int")


def test_layer_report(spark, exported, base):
    mean = base.agg(F.avg("traffic_volume")).first()[0]
    good = reports.validate_export(spark, exported, 24 * 60, (mean, 1.0)).collect()
    assert len(good) == 10 and all(r.all_passed for r in good)
    bad = {r.table_name: r for r in reports.validate_export(spark, exported, 48187, (3259.82, 1.0)).collect()}
    assert bad["traffic_hourly"].status.startswith("FAILED") and not bad["dim_time"].all_passed
    assert "Expected 48,187 rows, got 1440" in bad["traffic_hourly"].notes


def test_report_marks_empty_tables_and_missing_columns(spark):
    tables = {"a": spark.range(0), "b": spark.range(3)}
    rows = {r.table_name: r for r in quality.validate_layer(tables, required={"b": ["x"]}).collect()}
    assert rows["a"].status == "FAILED (Empty File)" and rows["a"].notes == "0 rows"
    assert rows["b"].status == "FAILED (Missing Column)" and rows["b"].notes == "Missing x"


def test_year_slicer_prunes_partitions(spark, exported):
    fact = spark.read.parquet(f"{exported}/traffic_hourly")
    plan = fact.filter("year = 2024").groupBy("hour").count()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_star_join_filters_through_dimensions(base):
    joined = star.star_join(star.traffic_hourly(base), star.dim_date(base), star.dim_time(base.sparkSession))
    rush = joined.filter("time_time_of_day_period = 'Morning Rush' AND date_is_weekday = 1")
    assert rush.count() == base.filter("hour IN (7, 8, 9) AND weekday < 5").count()
    row = measures.evaluate(rush, measures.volume_measures()).first()
    assert row.non_rush_avg_volume is None and row.rush_shift_pct == 0.0


def test_dim_date_is_continuous(make_series):
    rows = star.dim_date(make_series([1, 2], hours=[0, 24 * 400])).orderBy("date").collect()
    assert len(rows) == 401
    assert rows[0].week_of_year == 1 and rows[0].month_name == "January" and rows[0].quarter == 1


def test_stacked_error_table_equals_its_parts(base):
    train, test = modeling.chronological_split(base)
    scored = modeling.group_mean_predictor(train, test, ["hour"])
    table = [tuple(r) for r in star.error_analysis(scored).collect()]
    rows = errors.holdout(scored, right_closed=True)
    parts = []
    for segment in ("volume_bucket", "hour", "is_rush", "weekday"):
        parts += [(r[0], r[1], r[1], *r[2:]) for r in errors.segment_report(rows, segment).collect()]
    assert sorted(table) == sorted(parts)
    assert len(table) == 3 + 24 + 2 + 7


def test_five_step_run(spark, base, tmp_path):
    results = reports.run_analysis(base, str(tmp_path), trees=5, replicates=50)
    for part in (
        "sql/v_daily_traffic_summary", "sql/v_peak_traffic_rankings_top10", "statistics/descriptive_stats",
        "statistics/rush_hour_test", "forecasting/forecasting_comparison", "error_analysis", "business/business_kpis",
    ):
        assert spark.read.option("header", True).csv(str(tmp_path / part)).count() > 0, part
    assert results["forecasting_comparison"].count() == 3
    assert {r.segment_type for r in results["error_analysis"].collect()} >= {"Hour of Day", "Month of Year"}


def test_top_peaks_share_ranks(make_series):
    rows = views.top_peaks(make_series([5, 9, 9, 1, 8]), 4).collect()
    assert [r.volume_rank for r in rows] == [1, 1, 3, 4]


def test_late_rows_are_dropped(spark, tmp_path):
    """The limit for late rows follows the watermark by one batch, so the late row comes in the
    second batch after the one that moved it."""
    schema = "ts timestamp_ntz"
    batches = [
        ["2024-01-01 00:10:00", "2024-01-01 00:50:00"],
        ["2024-01-01 06:00:00"],
        ["2024-01-01 06:59:00"],
        ["2024-01-01 00:20:00", "2024-01-01 09:00:00"],
    ]
    for i, times in enumerate(batches):
        rows = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
        rows.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = (
        jobs.hourly_volume(stream).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    rows = {r.date_time.hour: r.traffic_volume for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {0: 2, 6: 2}


def test_replayed_micro_batch_leaves_one_copy(spark, base, tmp_path):
    model = modeling.fit(base, modeling.linear_regression(), ["hour"])
    handle = jobs.monitor_batch(model, str(tmp_path / "log"), str(tmp_path / "metrics"))
    batch = base.select("date_time", "traffic_volume").limit(100)
    for batch_id in (0, 1, 1):
        handle(batch, batch_id)
    handle(batch.filter("false"), 2)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 200
    metrics = spark.read.parquet(str(tmp_path / "metrics")).orderBy("batch_id").collect()
    assert [r.batch_id for r in metrics] == [0, 1] and all(r.alert_triggered for r in metrics)


def test_batches_without_actuals_are_logged_and_have_no_metrics(spark, base, tmp_path):
    model = modeling.fit(base, modeling.linear_regression(), ["hour"])
    log, metrics = str(tmp_path / "log"), str(tmp_path / "metrics")
    handle = jobs.monitor_batch(model, log, metrics)
    batch = base.select("date_time", "traffic_volume").limit(50)
    handle(batch.select("date_time"), 0)
    handle(batch.withColumn("traffic_volume", F.lit(None).cast("double")), 1)
    handle(batch, 2)
    assert spark.read.parquet(log).count() == 150
    assert [r.batch_id for r in spark.read.parquet(metrics).collect()] == [2]


def test_missing_tables_and_time_grain_are_rows_of_the_report(spark):
    tables = {"a": None, "b": spark.range(23)}
    rows = {r.table_name: r for r in quality.validate_layer(tables, hours={"b": 24}).collect()}
    assert (rows["a"].status, rows["a"].row_count) == ("FAILED (Missing File)", 0)
    assert (rows["b"].status, rows["b"].notes) == ("FAILED (Invalid Time Grain)", "Expected 24 hours, got 23")
    assert not rows["b"].all_passed


def test_all_late_rows_are_monitored(base):
    reference, current = reports.monitoring_inputs(base)
    assert current.count() == base.count() - int(base.count() * 0.85)
    assert reference.count() == int(base.count() * 0.85)
