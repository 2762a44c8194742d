"""Whole runs: the analysis suite, the star-schema export and its validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import CALENDAR_FEATURES, DEFAULTS, WEATHER_FEATURES, Settings
from tidemark.functions import labels
from tidemark.operators import drift, errors, kpis, modeling, quality, selection, statistics, windows
from tidemark.plans import star, views
from tidemark.session import materialize, scratch_scope
from tidemark.sources import datasets
from tidemark.sources.observations import write_csv


def calendar_holdout(
    df: DataFrame, trees: int = 200, settings: Settings = DEFAULTS
) -> tuple[DataFrame, modeling.PipelineModel]:
    """A forest on calendar features, fitted on the early rows and scored on the late ones."""
    train, test = modeling.chronological_split(df, settings)
    model = modeling.fit(train, modeling.random_forest(trees), CALENDAR_FEATURES)
    return materialize(modeling.predict(model, test), "holdout"), model


def lag_forecast(
    df: DataFrame, trees: int = 200, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """Comparison table and scored tail of the forecasting job."""
    features = windows.forecasting_features(df, modeling.time_keys(df))
    comparison, scored, _ = modeling.forecast_comparison(
        materialize(features, "forecast-features"), trees, settings
    )
    return materialize(comparison, "comparison"), materialize(scored, "forecast")


def run_sql_views(df: DataFrame, folder: str, settings: Settings = DEFAULTS) -> None:
    """Write every view; the ranking only as its ten highest rows."""
    for name, view in views.VIEWS.items():
        if name == "v_peak_traffic_rankings":
            write_csv(views.top_peaks(df), f"{folder}/{name}_top10", single_file=True)
        else:
            write_csv(view(df, settings), f"{folder}/{name}")


def run_statistics(df: DataFrame, folder: str, replicates: int = 1000) -> dict[str, DataFrame]:
    features = [c for c in (*WEATHER_FEATURES, *CALENDAR_FEATURES) if c in df.columns]
    reports = {
        "descriptive_stats": statistics.descriptive(df),
        "confidence_intervals": statistics.confidence_report(df, replicates=replicates),
        "correlations_pvalues": statistics.correlations(df, features).withColumns(
            {p: labels.p_text(F.col(p)) for p in ("pearson_p", "spearman_p")}
        ),
        "weekday_weekend_test": statistics.weekday_test(df),
        "rush_hour_test": statistics.rush_test(df),
    }
    if "weather_main" in df.columns:
        reports["weather_anova_test"] = statistics.category_test(df)
    for name, report in reports.items():
        write_csv(report, f"{folder}/{name}", single_file=True)
    return reports


def run_error_analysis(scored: DataFrame, folder: str, settings: Settings = DEFAULTS) -> DataFrame:
    """All five segment reports from one pass, one folder per segment type."""
    report = errors.full_report(errors.holdout(scored, settings, right_closed=True), settings=settings)
    report.write.mode("overwrite").option("header", True).partitionBy("segment_type").csv(folder)
    return report


def run_analysis(
    df: DataFrame, folder: str, trees: int = 200, replicates: int = 1000, settings: Settings = DEFAULTS
) -> dict[str, DataFrame]:
    """The five analysis steps over prepared observations, in the published order."""
    df = materialize(df, "base")
    run_sql_views(df, f"{folder}/sql", settings)
    results = run_statistics(df, f"{folder}/statistics", replicates)
    comparison, _ = lag_forecast(df, trees, settings)
    write_csv(comparison, f"{folder}/forecasting/forecasting_comparison", single_file=True)
    scored, _ = calendar_holdout(df, trees, settings)
    results["error_analysis"] = run_error_analysis(scored, f"{folder}/error_analysis", settings)
    business = kpis.business_kpis(df, errors.holdout(scored, settings), comparison, settings)
    write_csv(business, f"{folder}/business/business_kpis", single_file=True)
    results["forecasting_comparison"] = comparison
    results["business_kpis"] = business
    return results


def monitoring_inputs(
    df: DataFrame, sample: int | None = None, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """Early rows as reference; the late rows, or a seeded sample of ``sample`` of them, as current batch."""
    reference, late = modeling.chronological_split(df, settings)
    if sample is None:
        return reference, late
    return reference, selection.fixed_sample(late, sample, modeling.time_keys(df), settings.seed)


def export_star(
    df: DataFrame,
    folder: str,
    trees: int = 200,
    sample: int | None = None,
    settings: Settings = DEFAULTS,
    fmt: str = "parquet",
) -> None:
    """Write all ten tables. The hourly fact is partitioned by year, so a slicer on dates reads only
    the years it needs. Intermediate tables are dropped at the end."""
    with scratch_scope(df.sparkSession):
        _export_star(df, folder, trees, sample, settings, fmt)


def _export_star(
    df: DataFrame, folder: str, trees: int, sample: int | None, settings: Settings, fmt: str
) -> None:
    df = materialize(df, "base")
    comparison, forecast_rows = lag_forecast(df, trees, settings)
    holdout, model = calendar_holdout(df, trees, settings)
    forecast = star.demand_forecast(forecast_rows)
    reference, current = monitoring_inputs(df, sample, settings)
    report = drift.monitoring_report(
        modeling.predict(model, reference), modeling.predict(model, current), settings, "Test Holdout"
    )
    tables = {
        "traffic_daily": star.traffic_daily(df),
        "traffic_monthly": star.traffic_monthly(df),
        "demand_forecast": forecast,
        "model_performance": star.model_performance(holdout, forecast, settings),
        "error_analysis": star.error_analysis(holdout, settings),
        "business_kpis": kpis.business_kpis(df, errors.holdout(holdout, settings), comparison, settings),
        "monitoring_metrics": drift.flatten_report(report, settings),
        "dim_date": star.dim_date(df),
        "dim_time": star.dim_time(df.sparkSession, settings),
    }
    star.write_table(star.traffic_hourly(df, settings), folder, "traffic_hourly", "year", fmt)
    for name, table in tables.items():
        star.write_table(table, folder, name, fmt=fmt)


def validate_export(
    spark: SparkSession,
    folder: str,
    expected_rows: int | None = None,
    expected_mean: tuple[float, float] | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """The layer report over an exported folder; a table that is not there is a row of the report."""
    tables = {name: datasets.find_dataset(spark, name, folder, fmt) for name in datasets.REQUIRED_COLUMNS}
    rows = {}
    if expected_rows is not None:
        rows["traffic_hourly"] = expected_rows
    means = {}
    if expected_mean is not None:
        means["traffic_hourly"] = ("traffic_volume", *expected_mean)
    return quality.validate_layer(tables, rows, means, datasets.REQUIRED_COLUMNS, {"dim_time": 24})


def model_metadata(
    train: DataFrame, metrics: DataFrame, features=CALENDAR_FEATURES, settings: Settings = DEFAULTS
) -> DataFrame:
    """One nested row describing a fitted model, to be stored as JSON."""
    window = train.agg(
        F.count("*").alias("reference_dataset_size"),
        F.date_format(F.min("date_time"), "yyyy-MM-dd HH:mm:ss").alias("reference_window_start"),
        F.date_format(F.max("date_time"), "yyyy-MM-dd HH:mm:ss").alias("reference_window_end"),
    )
    scores = metrics.select(
        F.struct(F.col("mae").alias("MAE"), F.col("mse").alias("MSE"), F.col("rmse").alias("RMSE"), F.col("r2").alias("R2"))
    ).scalar()
    return window.select(
        "*",
        F.array(*map(F.lit, features)).alias("features"),
        F.lit("traffic_volume").alias("target"),
        F.struct(scores.alias("time_aware_split_85_15")).alias("validation_metrics"),
        F.struct(
            F.lit(settings.psi_moderate).alias("psi_no_drift"),
            F.lit(settings.psi_significant).alias("psi_moderate_drift"),
            F.lit(settings.rmse_threshold).alias("rmse_alert_threshold"),
        ).alias("monitoring_thresholds"),
    )
