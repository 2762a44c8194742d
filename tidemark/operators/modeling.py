"""Splits, regressors, baselines and evaluation as table jobs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import CALENDAR_FEATURES, DEFAULTS, LAG_FEATURES, WEATHER_FEATURES, Settings
from tidemark.functions import calendar, labels
from tidemark.operators import selection
from tidemark.operators.ordering import before_key, from_key, time_key_at
from tidemark.operators.quality import require_values
from tidemark.operators.statistics import bias_corrected_shape
from tidemark.operators.quantiles import overall_quantiles
from tidemark.session import small_table
from tidemark.sources.observations import require_columns

TARGET = "traffic_volume"
TIME_KEYS = ("date_time", "obs_id")
RANDOM_METHOD, CHRONOLOGICAL_METHOD = "Random Split (85/15)", "Chronological Split (85/15)"
NAIVE_HOUR = "Naive Prev-Hour Baseline (Lag 1h)"
NAIVE_DAY = "Naive Prev-Day Baseline (Lag 24h)"
LAG_FOREST = "Random Forest Forecasting (Temporal + Lags)"
UNBOUNDED = 30  # Spark's deepest trees
MOST_BINS = 46_340  # Spark squares the number of bins as an int


def time_keys(df: DataFrame) -> list[str]:
    return [k for k in TIME_KEYS if k in df.columns]


def split_conditions(df: DataFrame, settings: Settings = DEFAULTS) -> tuple[Column, Column]:
    """Filters of the earliest ``int(n * share)`` rows and of all others; rows without a time are late.

    The row at the split position is located through counts per time; the split itself is then a
    comparison with constants that reaches the scan, and no row is moved.
    """
    keys = time_keys(df)
    bound = time_key_at(df, keys, settings.train_share)
    if bound is None:
        return F.lit(True), F.lit(False)
    return before_key(keys, bound), from_key(keys, bound)


def chronological_split(df: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    early, late = split_conditions(df, settings)
    return df.filter(early), df.filter(late)


def split_summary(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Rows, percent and time window of both sides."""
    early, _ = split_conditions(df, settings)
    total = df.agg(F.count("*")).scalar()
    return (
        df.groupBy(F.when(early, "train").otherwise("test").alias("split"))
        .agg(
            F.count("*").alias("row_count"),
            F.min("date_time").alias("window_start"),
            F.max("date_time").alias("window_end"),
        )
        .withColumn("row_pct", F.col("row_count") * 100.0 / total)
    )


def regression_metrics(
    df: DataFrame,
    actual: str = TARGET,
    predicted: str = "prediction",
    by: Sequence[str] = (),
    rounded: bool = True,
) -> DataFrame:
    """Rows, MAE, MSE, RMSE and R2, optionally per group, in one aggregate."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    error = a - p
    both = F.when(a.isNotNull() & p.isNotNull(), a)
    raw = df.groupBy(*by).agg(
        F.count(error).alias("samples"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop(both).alias("_var"),
    )
    r2 = 1.0 - F.try_divide(F.col("mse"), F.col("_var"))

    def shown(c: Column, digits: int) -> Column:
        return F.round(c, digits) if rounded else c

    return raw.select(
        *by,
        "samples",
        shown(F.col("mae"), 4).alias("mae"),
        shown(F.col("mse"), 2).alias("mse"),
        shown(F.sqrt("mse"), 4).alias("rmse"),
        shown(r2, 6).alias("r2"),
    )


def evaluate_performance(df: DataFrame, actual: str = TARGET, predicted: str = "prediction") -> DataFrame:
    require_values(df, actual, "actuals")
    require_values(df, predicted, "predictions")
    return regression_metrics(df, actual, predicted)


def linear_regression() -> LinearRegression:
    return LinearRegression(solver="normal")


def decision_tree(depth: int = UNBOUNDED, seed: int = 42) -> DecisionTreeRegressor:
    """As deep as Spark allows, standing for an unbounded tree."""
    return DecisionTreeRegressor(maxDepth=depth, maxBins=64, seed=seed)


def random_forest(trees: int = 200, depth: int = 10, seed: int = 42) -> RandomForestRegressor:
    """All features compete in every split, as in a bagged regression forest."""
    return RandomForestRegressor(
        numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="all", seed=seed
    )


def fit(train: DataFrame, regressor, features: Sequence[str], label: str = TARGET) -> PipelineModel:
    require_columns(train, [*features, label], "training rows")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    learner = regressor.setFeaturesCol("features").setLabelCol(label).setPredictionCol("prediction")
    rows = train.select(*features, label).na.drop()
    if learner.hasParam("maxBins") and learner.getMaxDepth() >= UNBOUNDED:
        learner = learner.copy({learner.maxBins: max(learner.getMaxBins(), bins_for_every_value(rows, features))})
    return Pipeline(stages=[assembler, learner]).fit(rows)


def bins_for_every_value(rows: DataFrame, features: Sequence[str]) -> int:
    """Bins with which an unbounded tree may split between any two values of a feature.

    Spark looks for split points in a sample of about the squared number of bins, so there must be enough bins
    not only for the values but for every row to be read; values without a row take no bin.
    """
    per_feature = [rows.groupBy(F.col(f).cast("double").alias("value")).agg(F.count("*").alias("n")) for f in features]
    sizes = [v.agg(F.count("*").alias("values"), F.sum("n").alias("n")).first() for v in per_feature]
    wanted = [max(s["values"], math.ceil(math.sqrt(s.n or 0))) + 1 for s in sizes]
    return min(max(wanted), MOST_BINS)


def predict(model: PipelineModel, rows: DataFrame, name: str = "prediction") -> DataFrame:
    """Score rows in place: every row keeps its columns, so nothing is joined back."""
    scored = model.transform(rows).drop("features", "rawPrediction")
    return scored if name == "prediction" else scored.withColumnRenamed("prediction", name)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_features(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def feature_importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """One row per feature, most important first."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(w)) for f, w in zip(model_features(model), weights)]
    table = small_table(spark, rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")


def compare_models(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str] = CALENDAR_FEATURES,
    trees: int = 200,
    learners: dict[str, Estimator] | None = None,
) -> DataFrame:
    """Linear regression, decision tree and random forest, or the given learners, on the same split."""
    learners = learners or {
        "Linear Regression": linear_regression(),
        "Decision Tree": decision_tree(),
        "Random Forest": random_forest(trees),
    }
    scored = None
    for name, learner in learners.items():
        part = predict(fit(train, learner, features), test).select(
            F.lit(name).alias("model"), TARGET, "prediction"
        )
        scored = part if scored is None else scored.unionByName(part)
    return regression_metrics(scored, by=["model"])


def compare_splits(
    df: DataFrame,
    identity: Sequence[str],
    features: Sequence[str] = CALENDAR_FEATURES,
    trees: int = 200,
    settings: Settings = DEFAULTS,
    learner: Estimator | None = None,
) -> DataFrame:
    """The same forest, or the given learner, under a random and a chronological split."""
    learner = learner or random_forest(trees)
    splits = {
        RANDOM_METHOD: selection.random_split(df, settings.train_share, identity, settings.seed),
        CHRONOLOGICAL_METHOD: chronological_split(df, settings),
    }
    scored = None
    for method, (train, test) in splits.items():
        part = predict(fit(train, learner, features), test).select(
            F.lit(method).alias("validation_method"), TARGET, "prediction"
        )
        scored = part if scored is None else scored.unionByName(part)
    return regression_metrics(scored, by=["validation_method"])


def compare_feature_sets(
    df: DataFrame,
    identity: Sequence[str],
    extra: Sequence[str] = WEATHER_FEATURES,
    trees: int = 200,
    settings: Settings = DEFAULTS,
    base: Sequence[str] = CALENDAR_FEATURES,
    learner: Estimator | None = None,
) -> DataFrame:
    """Calendar features alone against calendar plus weather, on one random split."""
    learner = learner or random_forest(trees)
    train, test = selection.random_split(df, settings.train_share, identity, settings.seed)
    sets = {
        "Temporal Only (Baseline)": list(base),
        "Temporal + Weather": [*base, *extra],
    }
    scored = None
    for name, features in sets.items():
        part = predict(fit(train, learner, features), test).select(
            F.lit(name).alias("feature_set"), TARGET, "prediction"
        )
        scored = part if scored is None else scored.unionByName(part)
    return regression_metrics(scored, by=["feature_set"]).select("feature_set", "r2", "rmse")


def residual_diagnostics(
    df: DataFrame, actual: str = TARGET, predicted: str = "prediction"
) -> DataFrame:
    """Mean, sample deviation, median, range and skewness of the residuals."""
    errors = df.select((F.col(actual) - F.col(predicted)).alias("residual"))
    r = F.col("residual")
    skew, _ = bias_corrected_shape(F.col("n"), F.col("_g1"), F.lit(0.0))
    moments = errors.agg(
        F.count(r).alias("n"),
        F.avg(r).alias("mean_residual"),
        F.stddev_samp(r).alias("std_residual"),
        F.min(r).alias("min_residual"),
        F.max(r).alias("max_residual"),
        F.skewness(r).alias("_g1"),
    )
    median = F.lit(overall_quantiles(errors, "residual", {"median": 0.5})["median"])
    return moments.withColumn("median_residual", median).withColumn("skewness", skew).drop("_g1")


def score_batch(model: PipelineModel, batch: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Derive calendar features where a time is given, require the model's inputs, and score."""
    if "date_time" in batch.columns:
        if dict(batch.dtypes)["date_time"] == "string":
            batch = batch.withColumn("date_time", calendar.parse_time(F.col("date_time")))
        batch = calendar.with_calendar(batch, settings)
    require_columns(batch, model_features(model), "batch")
    return predict(model, batch, "Prediction").withColumn(
        "flow_class", labels.flow_class(F.col("Prediction"), settings)
    )


def diurnal_curve(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Prediction for each hour of a mid-June Wednesday, rush flag set throughout."""
    # The published what-if row.
    constants = {"day": 15, "month": 6, "weekday": 2, "is_rush": 1}
    hours = spark.range(24).select(
        F.col("id").cast("int").alias("hour"), *[F.lit(v).alias(c) for c, v in constants.items()]
    )
    return predict(model, hours).orderBy("hour")


def naive_baselines(test: DataFrame) -> DataFrame:
    """Long predictions of the two persistence baselines."""
    return test.select(
        TARGET,
        F.inline(
            F.array(
                F.struct(F.lit("Baseline").alias("model_type"), F.lit(NAIVE_HOUR).alias("model_name"), F.col("lag_1h").alias("prediction")),
                F.struct(F.lit("Baseline").alias("model_type"), F.lit(NAIVE_DAY).alias("model_name"), F.col("lag_24h").alias("prediction")),
            )
        ),
    )


def forecast_comparison(
    features: DataFrame, trees: int = 200, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """Baselines against a forest on lag features, on the chronological tail.

    Returns the comparison table, the scored tail and the model.
    """
    train, test = chronological_split(features, settings)
    model = fit(train, random_forest(trees), [*CALENDAR_FEATURES, *LAG_FEATURES])
    scored = predict(model, test)
    forest = scored.select(
        TARGET,
        F.lit("ML Forecasting Model").alias("model_type"),
        F.lit(LAG_FOREST).alias("model_name"),
        "prediction",
    )
    long = naive_baselines(test).unionByName(forest)
    return regression_metrics(long, by=["model_type", "model_name"]), scored, model


def group_mean_predictor(train: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predict the training mean of the row's calendar cell, or the overall mean for a new cell.

    A cheap, exactly reproducible stand-in for a tree over the same few calendar columns. The cells
    are bounded by the calendar (24 hours, 7 weekdays, 12 months, 31 days, 2 rush states).
    """
    require_columns(train, keys, "training rows")
    unknown = [k for k in keys if k not in CALENDAR_FEATURES]
    if unknown:
        raise ValueError(f"not calendar features: {unknown}")
    cells = train.groupBy(*keys).agg(F.avg(TARGET).alias("_cell"))
    overall = train.agg(F.avg(TARGET)).scalar()
    return rows.join(F.broadcast(cells), list(keys), "left").withColumn(
        "prediction", F.coalesce("_cell", overall)
    ).drop("_cell")
