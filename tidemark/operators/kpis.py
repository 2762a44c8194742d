"""Business, executive, forecast and error KPIs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, DEMAND_CATEGORY, MODEL_CATEGORY, Settings
from tidemark.functions import calendar, labels
from tidemark.operators import aggregates
from tidemark.operators.ordering import ROWS_PER_BLOCK, block_cuts, point_block
from tidemark.operators.quality import require_values
from tidemark.operators.quantiles import block_quantiles, overall_quantiles
from tidemark.session import materialize

TARGET = "traffic_volume"


CELL = ("hour", "weekday", "month", "is_rush")
TOP = 3


def _top_text(top: Column, text: Callable[[Column], Column]) -> Column:
    """The texts of the best of some groups, given as an array of (mean, key); equal means keep the smaller key first."""
    ranked = F.array_sort(F.transform(top, lambda g: F.struct((-g["mean"]).alias("a"), g["key"].alias("b"), text(g).alias("t"))))
    return F.array_join(F.transform(F.slice(ranked, 1, TOP), lambda g: g["t"]), ", ")


def _demand_cells(df: DataFrame) -> tuple[DataFrame, list[float]]:
    """Rows per calendar cell and volume, from the only read of the facts, and values that cut the volumes
    into blocks, if there are many."""
    seen, v = Observation(), F.col(TARGET)
    counts = df.groupBy(*CELL, TARGET).agg(F.count("*").alias("n"))
    watched = counts.observe(
        seen, F.count(v).alias("rows"), block_cuts(df.sparkSession, v.cast("double")).alias("cuts")
    )
    cells = materialize(watched, "demand-cells")
    many = (seen.get.get("rows") or 0) > ROWS_PER_BLOCK
    return cells, sorted(set(seen.get["cuts"])) if many else []


def _demand_groups(cells: DataFrame, cuts: list[float], settings: Settings) -> dict[tuple[str, int | None], Row]:
    """Sums over the whole table, every hour, month, rush and weekday side and block of volumes, in one
    aggregate: at most some forty groups and the blocks."""
    v, n = F.col(TARGET), F.col("n")
    groups = {
        "all": F.lit(0),
        "hour": F.col("hour"),
        "month": F.col("month"),
        "rush": (F.col("is_rush") == 1),
        "work": (F.col("weekday") < 5),
        "block": point_block(cuts, v.cast("double")),
    }
    entries = [F.struct(F.lit(k).alias("kind"), c.cast("int").alias("key")) for k, c in groups.items()]
    rows = (
        cells.select(v, n, F.inline(F.array(*entries)))
        .groupBy("kind", "key")
        .agg(
            F.sum(n).alias("rows"),
            F.sum(F.when(v.isNotNull(), n)).alias("values"),
            F.sum(v.cast("double") * n).alias("total"),
            F.max(v).alias("top"),
            F.sum(F.when(v < settings.low, n)).alias("low"),
            F.sum(F.when((v >= settings.low) & (v < settings.heavy), n)).alias("moderate"),
            F.sum(F.when(v >= settings.heavy, n)).alias("heavy"),
        )
    )
    return {(r["kind"], r["key"]): r for r in rows.collect()}


def demand_kpis(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row of numeric demand KPIs, with the texts beside them.

    The facts are read once, into rows per calendar cell and volume. One aggregate over those gives
    every sum; the median ranks only the block of volumes that holds it. Groups without a volume are
    not among the top ones.
    """
    if TARGET not in df.columns:
        require_values(df, TARGET)
    cells, cuts = _demand_cells(df)
    groups = _demand_groups(cells, cuts, settings)
    whole = groups.get(("all", 0))
    if whole is None or not whole["values"]:
        return require_values(df, TARGET)

    def mean(kind: str, key: int) -> Column:
        g = groups.get((kind, key))
        return F.lit(g["total"] / g["values"] if g and g["values"] else None).cast("double")

    def means(kind: str) -> Column:
        known = [(g["total"] / g["values"], key) for (k, key), g in groups.items() if k == kind and g["values"]]
        return F.array(*[F.struct(F.lit(m).alias("mean"), F.lit(key).cast("int").alias("key")) for m, key in known])

    blocks = {key: g["values"] for (kind, key), g in groups.items() if kind == "block" and g["values"]}
    median = block_quantiles(cells, TARGET, {"median": 0.5}, cuts, blocks)["median"]
    wide = df.sparkSession.range(0, 1, 1, 1).select(
        mean("all", 0).alias("avg_volume"),
        F.lit(whole["top"]).cast(df.schema[TARGET].dataType).alias("peak_volume"),
        mean("rush", 1).alias("rush_mean"),
        mean("rush", 0).alias("non_rush_mean"),
        mean("work", 1).alias("weekday_mean"),
        mean("work", 0).alias("weekend_mean"),
        *[F.lit(whole[c] or 0).cast("bigint").alias(f"{c}_count") for c in ("low", "moderate", "heavy")],
        F.lit(whole["rows"]).cast("bigint").alias("total_count"),
        F.lit(median).cast("double").alias("median_volume"),
        _top_text(means("hour"), lambda g: labels.hour_text(g["key"], g["mean"])).alias("top_hours"),
        _top_text(means("month"), lambda g: labels.month_text(calendar.month_abbreviation(g["key"]), g["mean"])).alias("top_months"),
    ).withColumns(
        {
            "rush_diff": F.col("rush_mean") - F.col("non_rush_mean"),
            "weekday_diff": F.col("weekday_mean") - F.col("weekend_mean"),
        }
    )
    return wide.withColumns(
        {
            "rush_pct": F.try_divide(F.col("rush_diff") * 100, F.col("non_rush_mean")),
            "weekday_pct": F.try_divide(F.col("weekday_diff") * 100, F.col("weekend_mean")),
        }
    )


def demand_kpi_texts(kpis: DataFrame, settings: Settings = DEFAULTS) -> dict[str, Column]:
    """Published names and texts of the demand KPIs."""
    low, heavy = f"{settings.low:g}", f"{settings.heavy:g}"

    def number(c: str) -> Column:
        return F.round(F.col(c), 2).cast("string")

    def share(c: str) -> Column:
        return labels.share_text(F.col(c), F.col("total_count"))

    return {
        "Average Traffic Volume (veh/hr)": number("avg_volume"),
        "Median Traffic Volume (veh/hr)": number("median_volume"),
        "Peak Single-Hour Volume (veh/hr)": F.col("peak_volume").cast("string"),
        "Top Peak Demand Hours": F.col("top_hours"),
        "Rush-Hour Mean Volume (veh/hr)": number("rush_mean"),
        "Non-Rush-Hour Mean Volume (veh/hr)": number("non_rush_mean"),
        "Rush vs Non-Rush Demand Difference": labels.shift_text(F.col("rush_diff"), F.col("rush_pct")),
        "Weekday Mean Volume (veh/hr)": number("weekday_mean"),
        "Weekend Mean Volume (veh/hr)": number("weekend_mean"),
        "Weekday vs Weekend Demand Difference": labels.shift_text(F.col("weekday_diff"), F.col("weekday_pct")),
        "Highest Demand Months": F.col("top_months"),
        f"Low-Volume Hours (<{low}) Count (%)": share("low_count"),
        f"Moderate-Volume Hours ({low}-{settings.heavy - 1:g}) Count (%)": share("moderate_count"),
        f"Heavy-Volume Hours (>={heavy}) Count (%)": share("heavy_count"),
    }


def _error_sums(settings: Settings) -> dict[str, Column]:
    """What error KPIs follow from; sums of parts of the rows add up to those of all."""
    a, p = F.col(TARGET), F.col("prediction")
    heavy = a >= settings.heavy
    sums = {
        "total_samples": F.count("*"),
        "underpred_count": F.count_if(a > p),
        "overpred_count": F.count_if(a < p),
    }
    for error in ("error", "abs_error", "squared_error"):
        for side, value in (("all", F.col(error)), ("heavy", F.when(heavy, F.col(error)))):
            sums |= {f"_{side}_{error}": F.sum(value.cast("double")), f"_{side}_{error}_n": F.count(value)}
    return sums


def _error_figures(sums: DataFrame, *others: str) -> DataFrame:
    def mean(side: str, error: str) -> Column:
        return F.try_divide(F.col(f"_{side}_{error}"), F.col(f"_{side}_{error}_n"))

    counts = ("total_samples", "underpred_count", "overpred_count")
    return sums.select(
        *counts,
        mean("all", "error").alias("mean_bias"),
        mean("all", "abs_error").alias("mae"),
        F.sqrt(mean("all", "squared_error")).alias("rmse"),
        mean("heavy", "abs_error").alias("heavy_mae"),
        F.sqrt(mean("heavy", "squared_error")).alias("heavy_rmse"),
        mean("heavy", "error").alias("heavy_bias"),
        *[F.try_divide(F.col(c) * 100.0, F.col("total_samples")).alias(c.replace("count", "pct")) for c in counts[1:]],
        *others,
    )


def error_kpis(errors: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row of holdout error KPIs from rows with residuals, in one aggregate."""
    return _error_figures(errors.agg(*[c.alias(n) for n, c in _error_sums(settings).items()]))


def model_kpis(
    errors: DataFrame, comparison: DataFrame | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Error KPIs plus the hours with the largest errors and the forecasting comparison text, all from one
    read of the rows: sums per hour first, then those of all hours."""
    sums = _error_sums(settings)
    hours = errors.groupBy("hour").agg(*[c.alias(n) for n, c in sums.items()])
    mean = F.try_divide(F.col("_all_abs_error"), F.col("_all_abs_error_n"))
    group = F.when(mean.isNotNull(), F.struct(mean.alias("mean"), F.col("hour").alias("key")))
    whole = hours.agg(
        *[(F.coalesce(F.sum(n), F.lit(0)) if n.endswith(("_n", "samples", "count")) else F.sum(n)).alias(n) for n in sums],
        F.collect_list(group).alias("_hours"),
    ).withColumn("worst_hours", _top_text(F.col("_hours"), lambda g: labels.hour_error_text(g["key"], g["mean"])))
    wide = _error_figures(whole, "worst_hours")
    if comparison is None:
        return wide.withColumn("forecast_text", F.lit(None).cast("string"))
    f = forecast_kpis(comparison, "Random Forest|ML", "Naive Prev-Hour", ignore_case=False)
    text = F.format_string(
        "ML Lag RF MAE: %.2f veh/hr (vs Naive Prev-Hour MAE: %.2f veh/hr)",
        F.col("ml_mae"),
        F.col("naive_mae"),
    )
    return wide.withColumn("forecast_text", f.select(text).scalar())


def model_kpi_texts(settings: Settings = DEFAULTS) -> dict[str, Column]:
    heavy = f"{settings.heavy:g}"

    def number(c: str) -> Column:
        return F.round(F.col(c), 2).cast("string")

    def share(c: str) -> Column:
        return labels.share_text(F.col(c), F.col("total_samples"))

    return {
        "Chronological Holdout Model MAE": number("mae"),
        "Chronological Holdout Model RMSE": number("rmse"),
        "Forecasting Model Accuracy (Short-Term Lags)": F.col("forecast_text"),
        "Highest Error Hours": F.col("worst_hours"),
        "Underpredictions Count (%)": share("underpred_count"),
        "Overpredictions Count (%)": share("overpred_count"),
        "Overall Mean Bias Error": labels.signed_text(F.col("mean_bias")),
        f"Heavy-Volume (>={heavy}) MAE": number("heavy_mae"),
        f"Heavy-Volume (>={heavy}) RMSE": number("heavy_rmse"),
        "Heavy-Volume Mean Bias Error": F.concat(
            labels.signed_text(F.col("heavy_bias")),
            F.lit(" (Positive bias indicates underprediction during peak surges)"),
        ),
    }


def long_kpis(wide: DataFrame, texts: dict[str, Column], category: str) -> DataFrame:
    """A one-row KPI table as rows of category, name and text value."""
    entries = [F.struct(F.lit(n).alias("kpi_name"), t.cast("string").alias("kpi_value")) for n, t in texts.items()]
    return wide.select(F.lit(category).alias("kpi_category"), F.inline(F.array(*entries)))


def business_kpis(
    df: DataFrame, errors: DataFrame, comparison: DataFrame | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Both KPI tables as rows, from one read of the facts and one of the scored rows."""
    demand = demand_kpis(df, settings)
    model = model_kpis(errors, comparison, settings)
    return long_kpis(demand, demand_kpi_texts(demand, settings), DEMAND_CATEGORY).unionByName(
        long_kpis(model, model_kpi_texts(settings), MODEL_CATEGORY)
    )


def executive_kpis(df: DataFrame, settings: Settings = DEFAULTS, digits: int | None = 2) -> DataFrame:
    """Overview KPIs of the whole table or of a slice of it, always computed from the rows."""
    require_values(df, TARGET)
    shift = aggregates.conditional_shift(df, settings)
    parts = shift.columns
    row = df.agg(F.avg(TARGET).alias("avg_traffic"), F.max(TARGET).alias("peak_traffic")).withColumns(
        {
            "median_traffic": F.lit(overall_quantiles(df, TARGET, {"median": 0.5})["median"]),
            "_s": shift.select(F.struct(*parts)).scalar(),
        }
    )

    def rounded(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    return row.select(
        rounded(F.col("avg_traffic")).alias("avg_traffic"),
        rounded(F.col("median_traffic")).alias("median_traffic"),
        "peak_traffic",
        *[rounded(F.col(f"_s.{p}")).alias(p) for p in parts],
    )


def forecast_kpis(
    performance: DataFrame,
    model_pattern: str = "ML Lag|Lags",
    naive_pattern: str = "Naive",
    name: str = "model_name",
    ignore_case: bool = True,
) -> DataFrame:
    """The model's metrics against the naive ones, both picked by name in one pass.

    Where several rows match, the first name in alphabetical order is used.
    """
    flag = "(?i)" if ignore_case else ""
    r2 = "r2_score" if "r2_score" in performance.columns else "r2"

    def pick(pattern: str, column: str) -> Column:
        hit = F.col(name).rlike(flag + pattern)
        return F.min_by(F.when(hit, F.col(column)), F.when(hit, F.col(name)))

    picked = performance.agg(
        pick(model_pattern, "mae").alias("ml_mae"),
        pick(model_pattern, "rmse").alias("ml_rmse"),
        pick(model_pattern, r2).alias("ml_r2"),
        pick(naive_pattern, "mae").alias("naive_mae"),
    )
    reduction = F.try_divide((F.col("naive_mae") - F.col("ml_mae")) * 100, F.col("naive_mae"))
    return picked.withColumn("mae_reduction_pct", F.round(reduction, 2))

