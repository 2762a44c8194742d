"""Distribution drift, performance alerts and the monitoring report.

Reference and current rows are counted per distinct value, side by side, and written. Three aggregates over
these counts give everything else, each for all features at once: sizes, means and ranges; then, over running
totals, the distance, the deviations and the values at all wanted quantiles; then the rows per bin. What passes
between them is some numbers per named feature, which become constants of the next plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.config import (
    CALENDAR_FEATURES,
    DEFAULTS,
    DRIFT_DETECTED,
    FEATURE_DRIFT_TYPE,
    PREDICTION_DRIFT_TYPE,
    PREDICTION_FEATURE_NAME,
    STABLE,
    Settings,
)
from tidemark.functions import labels
from tidemark.operators.ordering import BLOCKS_PER_PARTITION, ROWS_PER_BLOCK, bisect
from tidemark.operators.quality import ALLOWED_RANGES
from tidemark.operators.quantiles import QUARTILES, interpolated, positions
from tidemark.session import materialize, small_table
from tidemark.sources.observations import require_columns

EPSILON = 1e-4
PERFORMANCE_SCHEMA = "samples bigint, mae double, mse double, rmse double, r2 double"
FEATURE, VALUE = "feature", "value"
ROWS = "(rows)"
MOST_BLOCKS = 1024


def _long(df: DataFrame, features: Sequence[str], side: str) -> DataFrame:
    pairs = [F.struct(F.lit(f).alias(FEATURE), F.col(f).cast("double").alias(VALUE)) for f in features]
    return df.select(F.lit(side).alias("side"), F.inline(F.array(*pairs))).filter(F.col(VALUE).isNotNull())


def paired_counts(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature and distinct value: rows on either side; written."""
    both = _long(reference, features, "ref").unionByName(_long(current, features, "cur"))
    return materialize(both.groupBy(FEATURE, VALUE).agg(*_side_counts()), "paired-counts")


def _side_counts() -> list[Column]:
    return [F.count_if(F.col("side") == side).alias(f"n_{side}") for side in ("ref", "cur")]


def paired_counts_and_errors(
    reference: DataFrame, current: DataFrame, features: Sequence[str], actual: str | None, prediction: str
) -> DataFrame:
    """The paired counts and, from the same pass over the rows, the number of current rows and the
    error figures of those with an actual and a prediction. Errors ride along as a further feature,
    ``ROWS``, without a value, so that they need neither another read nor another shuffle."""

    def side(df: DataFrame, name: str) -> DataFrame:
        none = F.lit(None).cast("double")
        pairs = [
            F.struct(F.lit(f).alias(FEATURE), F.col(f).cast("double").alias(VALUE), none.alias("a"), none.alias("p"))
            for f in features
        ]
        if name == "cur":
            a = none if actual is None else F.col(actual).cast("double")
            pairs.append(
                F.struct(F.lit(ROWS).alias(FEATURE), none.alias(VALUE), a.alias("a"), F.col(prediction).cast("double").alias("p"))
            )
        long = df.select(F.lit(name).alias("side"), F.inline(F.array(*pairs)))
        return long.filter(F.col(VALUE).isNotNull() | (F.col(FEATURE) == ROWS))

    error = F.col("a") - F.col("p")
    counts = side(reference, "ref").unionByName(side(current, "cur")).groupBy(FEATURE, VALUE).agg(
        *_side_counts(),
        F.count(error).alias("samples"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop(F.when(error.isNotNull(), F.col("a"))).alias("variance"),
    )
    return materialize(counts, "paired-counts")


@dataclass(frozen=True)
class Sides:
    """Sums over one feature's values: rows, mean and range on either side, whether current values leave
    the allowed range, and values that cut its distinct values into blocks, if there are many."""

    ref: int
    cur: int
    ref_mean: float | None
    cur_mean: float | None
    low: float
    ref_low: float | None
    ref_high: float | None
    outside: bool
    cuts: tuple[float, ...] = ()


def _outside() -> Column:
    outside = F.lit(False)
    for feature, (low, high) in ALLOWED_RANGES.items():
        outside = outside | ((F.col(FEATURE) == feature) & ~F.col(VALUE).between(low, high))
    return outside


def sides(paired: DataFrame) -> dict[str, Sides]:
    """One entry per feature; there are as many features as the caller named."""
    return _sides_and_errors(paired)[0]


def _sides_and_errors(paired: DataFrame) -> tuple[dict[str, Sides], Row | None]:
    """The first aggregate: :class:`Sides` of every feature and the figures of ``ROWS``, if counted."""
    v, r, c = F.col(VALUE), F.col("n_ref"), F.col("n_cur")
    figures = [n for n in ("samples", "mae", "mse", "variance") if n in paired.columns]
    blocks = min(MOST_BLOCKS, BLOCKS_PER_PARTITION * int(paired.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = paired.groupBy(FEATURE).agg(
        F.sum(r).alias("ref"),
        F.sum(c).alias("cur"),
        F.try_divide(F.sum(r * v), F.sum(r)).alias("ref_mean"),
        F.try_divide(F.sum(c * v), F.sum(c)).alias("cur_mean"),
        F.min(v).alias("low"),
        F.min(F.when(r > 0, v)).alias("ref_low"),
        F.max(F.when(r > 0, v)).alias("ref_high"),
        F.bool_or((c > 0) & _outside()).alias("outside"),
        # They only balance blocks, so they need not be exact.
        F.percentile_approx(v, [b / blocks for b in range(1, blocks)], 10 * blocks).alias("cuts"),
        F.count(v).alias("n"),
        *[F.max(n).alias(n) for n in figures],
    )
    known, errors = {}, None
    for row in rows.collect():
        if row[FEATURE] == ROWS:
            errors = row
        else:
            cuts = tuple(sorted(set(row["cuts"]))) if row["n"] > ROWS_PER_BLOCK else ()
            known[row[FEATURE]] = Sides(*[row[f] for f in ("ref", "cur", "ref_mean", "cur_mean", "low", "ref_low", "ref_high", "outside")], cuts)
    return known, errors


def _for_feature(values: dict[str, object], type_: str) -> Column:
    """A constant of the row's feature, null for others; as SQL text, since every part of an expression that
    is put together here would be a call of its own."""

    def shown(value: object) -> str:
        if isinstance(value, (list, tuple)):
            return f"array({', '.join(map(shown, value))})"
        return "NULL" if value is None else f"CAST('{value!r}' AS {type_.removeprefix('array<').rstrip('>')})"

    if not values:
        return F.lit(None).cast(type_)
    names = {f: f.replace("\\", "\\\\").replace("'", "\\'") for f in values}
    cases = " ".join(f"WHEN '{names[f]}' THEN CAST({shown(v)} AS {type_})" for f, v in values.items())
    return F.expr(f"CASE {FEATURE} {cases} END")


def _cumulated(paired: DataFrame, known: dict[str, Sides]) -> DataFrame:
    """Add ``b_ref`` and ``b_cur``, the rows of lesser values on either side.

    Values of a feature are cut into blocks at ``Sides.cuts``; a running total inside a block follows on the
    totals of the blocks before, a table of some rows per feature that is broadcast.
    """
    both = paired.filter(F.col(FEATURE).isin(*[f for f, s in known.items() if s.ref and s.cur]))
    cuts = {f: list(s.cuts) for f, s in known.items() if s.cuts}
    inside = Window.partitionBy(FEATURE).orderBy(VALUE).rowsBetween(Window.unboundedPreceding, -1)
    before = {f"b_{s}": F.coalesce(F.sum(f"n_{s}").over(inside), F.lit(0)) for s in ("ref", "cur")}
    if not cuts:
        # A block of each feature: few enough values for one task.
        return both.withColumns(before)
    edges = F.coalesce(_for_feature(cuts, "array<double>"), F.array().cast("array<double>"))
    blocks = both.withColumn("_b", bisect(edges, max(map(len, cuts.values())), F.col(VALUE)))
    inside = Window.partitionBy(FEATURE, "_b").orderBy(VALUE).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(FEATURE).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy(FEATURE, "_b").agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur")).select(
        FEATURE, "_b", *[F.coalesce(F.sum(f"t_{s}").over(earlier), F.lit(0)).alias(f"s_{s}") for s in ("ref", "cur")]
    )
    own = {f"b_{s}": F.coalesce(F.sum(f"n_{s}").over(inside), F.lit(0)) for s in ("ref", "cur")}
    placed = blocks.withColumns(own).join(F.broadcast(starts), [FEATURE, "_b"])
    return placed.withColumns({f"b_{s}": F.col(f"b_{s}") + F.col(f"s_{s}") for s in ("ref", "cur")})


@dataclass(frozen=True)
class Shape:
    """What running totals say of one feature: the distance, deviations, and values by side and position."""

    wasserstein: float | None
    ref_std: float | None
    cur_std: float | None
    marks: dict[tuple[str, int], float]

    def quantile(self, side: str, size: int, share: float) -> float:
        return interpolated({p: v for (s, p), v in self.marks.items() if s == side}, size, share)


def shapes(
    paired: DataFrame, known: dict[str, Sides], wanted: dict[tuple[str, str], Sequence[float]]
) -> dict[str, Shape]:
    """The second aggregate, for features with rows on both sides.

    The distance is the area between the cumulative distributions, summed by parts: each value
    contributes itself times the drop in the absolute difference across it, so no row needs its
    successor. ``wanted`` names quantiles by (feature, side); their positions are known from the sizes, and
    the values that cover them, one for each, come back with the sums.
    """
    both = {f: s for f, s in known.items() if s.ref and s.cur}
    if not both:
        return {}
    constants = {"low": _for_feature({f: s.low for f, s in both.items()}, "double")}
    for side in ("ref", "cur"):
        constants[f"size_{side}"] = _for_feature({f: getattr(s, side) for f, s in both.items()}, "bigint")
        constants[f"mean_{side}"] = _for_feature({f: getattr(s, f"{side}_mean") for f, s in both.items()}, "double")

    def gap(extra_ref: Column, extra_cur: Column) -> Column:
        return F.abs(
            (F.col("b_ref") + extra_ref) / F.col("size_ref") - (F.col("b_cur") + extra_cur) / F.col("size_cur")
        )

    def deviation(side: str) -> Column:
        off = F.col(VALUE) - F.col(f"mean_{side}")
        return F.sqrt(F.sum(F.col(f"n_{side}") * off * off / F.col(f"size_{side}"))).alias(f"std_{side}")

    before, after = gap(F.lit(0), F.lit(0)), gap(F.col("n_ref"), F.col("n_cur"))
    term = (F.col(VALUE) - F.col("low")) * (before - after)
    spots: dict[str, dict[str, list[int]]] = {"ref": {}, "cur": {}}
    for (feature, side), shares in wanted.items():
        if feature in both:
            rows = getattr(both[feature], side)
            found = {spot for share in shares for spot in positions(rows, share)[:2]}
            spots[side][feature] = sorted(found)

    def covered(side: str) -> Column:
        first, after = F.col(f"b_{side}"), F.col(f"b_{side}") + F.col(f"n_{side}")
        here = F.exists(_for_feature(spots[side], "array<bigint>"), lambda s: (first <= s) & (s < after))
        return F.collect_list(F.when(here, F.struct(F.col(VALUE), first.alias("a"), after.alias("z")))).alias(f"at_{side}")

    rows = _cumulated(paired, known).withColumns(constants).groupBy(FEATURE).agg(
        F.sum(term).alias("wasserstein"), deviation("ref"), deviation("cur"), covered("ref"), covered("cur")
    )
    result = {}
    for row in rows.collect():
        feature = row[FEATURE]
        marks = {
            (side, spot): next(m[VALUE] for m in row[f"at_{side}"] if m["a"] <= spot < m["z"])
            for side in ("ref", "cur") for spot in spots[side].get(feature, [])
        }
        result[feature] = Shape(row["wasserstein"], row["std_ref"], row["std_cur"], marks)
    return result


def _bin_shares(known: dict[str, Sides], bins: int) -> dict[tuple[str, str], list[float]]:
    return {(f, "ref"): [i / bins for i in range(bins + 1)] for f in known}


def bin_edges(known: dict[str, Sides], found: dict[str, Shape], bins: int = 10) -> dict[str, list[float]]:
    """Distinct quantile edges of the reference; a constant reference gets one wide bin."""
    edges = {}
    for feature, shape in found.items():
        side = known[feature]
        marks = sorted({shape.quantile("ref", side.ref, i / bins) for i in range(bins + 1)})
        edges[feature] = marks if len(marks) > 1 else [side.ref_low - 1, side.ref_high + 1]
    return edges


def psi(
    paired: DataFrame,
    bins: int = 10,
    epsilon: float = EPSILON,
    open_ends: bool = False,
    categorical: Sequence[str] = (),
    known: dict[str, Sides] | None = None,
) -> DataFrame:
    """Population stability index per feature; 0 where a side is empty.

    Bins are the distinct quantile edges of the reference; the last one includes its upper edge.
    Values outside the reference range belong to no bin but stay in the denominator, unless
    ``open_ends`` extends the outer bins. ``categorical`` features use one bin per distinct value.
    """
    known = sides(paired) if known is None else known
    found = shapes(paired, known, _bin_shares(known, bins))
    scores = _psi_scores(paired, known, found, bins, epsilon, open_ends, categorical)
    return small_table(paired.sparkSession, list(scores.items()), f"{FEATURE} string, psi double")


def _psi_scores(
    paired: DataFrame,
    known: dict[str, Sides],
    found: dict[str, Shape],
    bins: int = 10,
    epsilon: float = EPSILON,
    open_ends: bool = False,
    categorical: Sequence[str] = (),
) -> dict[str, float]:
    """The third aggregate: rows per feature and bin, and from them the index."""
    v = F.col(VALUE)
    edges = bin_edges(known, found, bins)
    binned = {f: e for f, e in edges.items() if f not in categorical}
    each = [f for f in edges if f in categorical]
    if not edges:
        return {f: 0.0 for f in known}
    inner = _for_feature({f: e[1:-1] for f, e in binned.items()}, "array<double>")
    place = F.size(F.filter(inner, lambda e: e <= v))
    inside = F.lit(True)
    if not open_ends:
        inside = (v >= _for_feature({f: e[0] for f, e in binned.items()}, "double")) & (
            v <= _for_feature({f: e[-1] for f, e in binned.items()}, "double")
        )

    def index(ref: Column, cur: Column) -> Column:
        r = F.when(ref == 0, epsilon).otherwise(ref / F.col("size_ref"))
        c = F.when(cur == 0, epsilon).otherwise(cur / F.col("size_cur"))
        return (c - r) * F.log(c / r)

    most = max((len(e) - 1 for e in binned.values()), default=0)
    sizes = {f"size_{side}": _for_feature({f: getattr(known[f], side) for f in edges}, "bigint") for side in ("ref", "cur")}
    here = F.when(F.col(FEATURE).isin(*binned) & inside, place) if binned else F.lit(None).cast("int")
    counts = [
        F.expr(f"array({', '.join(f'sum(IF(_bin = {b}, n_{side}, 0))' for b in range(most))})")
        .cast("array<bigint>").alias(f"c_{side}")
        for side in ("ref", "cur")
    ]
    single = F.when(F.col(FEATURE).isin(*each), index(F.col("n_ref"), F.col("n_cur"))) if each else F.lit(0.0)
    summed = paired.filter(F.col(FEATURE).isin(*edges)).withColumns({"_bin": here, **sizes}).groupBy(FEATURE, *sizes).agg(
        F.sum(single).alias("single"), *counts
    )
    terms = F.zip_with("c_ref", "c_cur", index)
    total = F.aggregate(terms, F.coalesce("single", F.lit(0.0)), lambda a, t: a + t)
    scores = {r[FEATURE]: r["psi"] for r in summed.select(FEATURE, total.alias("psi")).collect()}
    return {f: scores.get(f) or 0.0 for f in known}


def distances(paired: DataFrame, known: dict[str, Sides] | None = None) -> DataFrame:
    """Wasserstein distance and the population deviation of both sides, per feature with rows on both."""
    found = shapes(paired, sides(paired) if known is None else known, {})
    rows = [(f, s.wasserstein, s.ref_std, s.cur_std) for f, s in found.items()]
    return small_table(paired.sparkSession, rows, f"{FEATURE} string, wasserstein double, std_ref double, std_cur double")


def wasserstein(paired: DataFrame, known: dict[str, Sides] | None = None) -> DataFrame:
    return distances(paired, known).select(FEATURE, "wasserstein")


def single_drift(
    reference: DataFrame, current: DataFrame, column: str, bins: int = 10, open_ends: bool = False
) -> DataFrame:
    """PSI and Wasserstein distance of one numeric column; an empty side gives a PSI of 0."""
    paired = paired_counts(reference, current, [column])
    known = sides(paired)
    found = shapes(paired, known, _bin_shares(known, bins))
    score = _psi_scores(paired, known, found, bins, open_ends=open_ends).get(column, 0.0)
    far = found[column].wasserstein if column in found else None
    return small_table(paired.sparkSession, [(column, score, far)], f"{FEATURE} string, psi double, wasserstein double")


def check_columns(
    reference: DataFrame | None, current: DataFrame | None, columns: Sequence[str]
) -> None:
    """Both sides exist and have the columns; reads no data."""
    for df, name in ((reference, "the reference"), (current, "the current batch")):
        if df is None or not df.columns:
            raise ValueError(f"{name} is not given or has no columns")
        require_columns(df, columns, name)


def check_sides(known: dict[str, Sides], columns: Sequence[str]) -> None:
    """Every column has values on both sides."""
    for column in columns:
        found = known.get(column)
        if found is None or not found.ref:
            raise ValueError(f"the reference has no values of {column!r}")
        if not found.cur:
            raise ValueError(f"the current batch has no values of {column!r}")


def check_ranges(known: dict[str, Sides], features: Sequence[str]) -> None:
    """Current values of calendar features stay in their allowed range."""
    for feature in features:
        if feature in ALLOWED_RANGES and feature in known and known[feature].outside:
            low, high = ALLOWED_RANGES[feature]
            raise ValueError(f"values of {feature!r} outside {low} to {high}")


def drift_table(
    paired: DataFrame,
    known: dict[str, Sides],
    categorical: Sequence[str] = (),
    found: dict[str, Shape] | None = None,
) -> DataFrame:
    """PSI, distance, means and deviations of every feature of a paired count, as a local table."""
    if found is None:
        found = shapes(paired, known, _bin_shares(known, 10))
    scores = _psi_scores(paired, known, found, categorical=categorical)
    none = Shape(None, None, None, {})
    rows = [
        (f, scores[f], far.wasserstein, far.ref_std, far.cur_std, s.ref_mean, s.cur_mean)
        for f, s in known.items() for far in [found.get(f, none)]
    ]
    schema = (
        f"{FEATURE} string, psi double, wasserstein double, reference_std double, current_std double, "
        "reference_mean double, current_mean double"
    )
    return small_table(paired.sparkSession, rows, schema)


def _feature_report(
    table: DataFrame, settings: Settings, digits: int | None = 4, with_means: bool = False
) -> DataFrame:
    def rounded(c: str) -> Column:
        return F.col(c) if digits is None else F.round(F.col(c), digits)

    p = F.col("psi")
    return table.select(
        FEATURE,
        rounded("psi").alias("psi"),
        rounded("wasserstein").alias("wasserstein"),
        labels.drift_threshold_text(p, settings).alias("threshold"),
        labels.drift_status(p, settings).alias("drift_status"),
        labels.drift_detected(p, settings).alias("drift_detected"),
        *(["reference_mean", "current_mean"] if with_means else []),
    )


def feature_drift(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str] = CALENDAR_FEATURES,
    settings: Settings = DEFAULTS,
    categorical: Sequence[str] = (),
    digits: int | None = 4,
    with_means: bool = False,
) -> DataFrame:
    """Drift of every feature with status, threshold text and flag."""
    check_columns(reference, current, features)
    paired = paired_counts(reference, current, features)
    known = sides(paired)
    check_sides(known, features)
    check_ranges(known, features)
    table = drift_table(paired, known, categorical)
    return _feature_report(table, settings, digits, with_means)


def _with_quartiles(known: dict[str, Sides], column: str) -> dict[tuple[str, str], list[float]]:
    """The quantiles of a report: bin edges of all features, quartiles of one column on both sides."""
    wanted = _bin_shares(known, 10)
    wanted[column, "ref"] = [*wanted[column, "ref"], *QUARTILES.values()]
    wanted[column, "cur"] = list(QUARTILES.values())
    return wanted


def _prediction_report(
    shape: Shape,
    size: Sides,
    table: DataFrame,
    column: str,
    settings: Settings,
    digits: tuple[int, int] | None = (2, 4),
) -> DataFrame:
    """The summary of one column of a paired count: location and spread of both sides, and drift."""
    shown = []

    def rounded(c: Column, place: int) -> Column:
        return c if digits is None else F.round(c, digits[place])

    for side, prefix in (("ref", "reference"), ("cur", "current")):
        values = {name: F.lit(shape.quantile(side, getattr(size, side), q)) for name, q in QUARTILES.items()}
        values |= {name: F.col(f"{prefix}_{name}") for name in ("mean", "std")}
        shown += [rounded(c, 0).alias(f"{prefix}_{name}") for name, c in values.items()]
    flag = labels.drift_detected(F.col("psi"), settings)
    return table.filter(F.col(FEATURE) == column).select(
        *shown,
        rounded(F.col("psi"), 1).alias("psi"),
        rounded(F.col("wasserstein"), 1).alias("wasserstein"),
        F.when(flag, DRIFT_DETECTED).otherwise(STABLE).alias("drift_status"),
        flag.alias("drift_detected"),
    )


def prediction_drift(
    reference: DataFrame,
    current: DataFrame,
    column: str = "prediction",
    settings: Settings = DEFAULTS,
    digits: tuple[int, int] | None = (2, 4),
) -> DataFrame:
    """Mean, median, population deviation and quartiles of both sides, with PSI and distance."""
    check_columns(reference, current, [column])
    paired = paired_counts(reference, current, [column])
    known = sides(paired)
    check_sides(known, [column])
    found = shapes(paired, known, _with_quartiles(known, column))
    table = drift_table(paired, known, found=found)
    return _prediction_report(found[column], known[column], table, column, settings, digits)


def alert(performance: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    rmse = F.col("rmse")
    return performance.select(
        labels.alert_triggered(rmse, settings).alias("alert_triggered"),
        labels.alert_status(rmse, settings).alias("status"),
        labels.alert_message(rmse, settings).alias("message"),
    )


def _performance(figures: Row) -> tuple:
    """Samples, MAE, MSE, RMSE and R2, rounded as performance figures are."""
    mse, variance = figures["mse"], figures["variance"]
    r2 = round(1.0 - mse / variance, 6) if variance else None
    return figures["samples"], round(figures["mae"], 4), round(mse, 2), round(math.sqrt(mse), 4), r2


def monitoring_report(
    reference: DataFrame,
    current: DataFrame,
    settings: Settings = DEFAULTS,
    label: str = "Historical Simulation",
    metadata: DataFrame | None = None,
    actual: str = "traffic_volume",
    prediction: str = "prediction",
) -> dict[str, DataFrame | None]:
    """All parts of a report on scored rows, each a table carrying the report label.

    Performance and alert exist only where current rows have actuals. Features, predictions and
    errors are counted together, so the rows are read once.
    """
    columns = [*CALENDAR_FEATURES, prediction]
    check_columns(reference, current, columns)
    known_actual = actual if actual in current.columns else None
    paired = paired_counts_and_errors(reference, current, columns, known_actual, prediction)
    known, figures = _sides_and_errors(paired)
    check_sides(known, columns)
    check_ranges(known, CALENDAR_FEATURES)
    found = shapes(paired, known, _with_quartiles(known, prediction))
    table = drift_table(paired, known, found=found)
    spark, performance = current.sparkSession, None
    if figures["samples"]:
        performance = small_table(spark, [_performance(figures)], PERFORMANCE_SCHEMA)
    monitored = figures["cur"]
    summary = small_table(
        spark, [(label, monitored)], "dataset_label string, monitored_samples bigint"
    ).select(F.localtimestamp().alias("timestamp"), "dataset_label", "monitored_samples")
    parts = {
        "feature_drift": _feature_report(
            table.filter(F.col(FEATURE) != prediction), settings, with_means=True
        ),
        "prediction_drift": _prediction_report(found[prediction], known[prediction], table, prediction, settings),
        "performance_metrics": performance,
        "alert": None if performance is None else alert(performance, settings),
        "model_metadata": metadata,
    }
    labelled = {k: None if t is None else t.withColumn("dataset_label", F.lit(label)) for k, t in parts.items()}
    return {"summary": summary, **labelled}


def flatten_report(report: dict[str, DataFrame | None], settings: Settings = DEFAULTS) -> DataFrame:
    """The report as one table: a row per feature and one for the predictions."""
    features = report["feature_drift"].select(
        F.lit(FEATURE_DRIFT_TYPE).alias("metric_type"),
        F.col(FEATURE).alias("feature_name"),
        F.round("reference_mean", 2).alias("reference_mean"),
        F.round("current_mean", 2).alias("current_mean"),
        F.col("psi").alias("psi_score"),
        "drift_status",
    )
    predictions = report["prediction_drift"].select(
        F.lit(PREDICTION_DRIFT_TYPE).alias("metric_type"),
        F.lit(PREDICTION_FEATURE_NAME).alias("feature_name"),
        "reference_mean",
        "current_mean",
        F.col("psi").alias("psi_score"),
        "drift_status",
    )
    rmse, flag, message = F.lit(None).cast("double"), F.lit(False), F.lit("Normal")
    if report["performance_metrics"] is not None:
        rmse = report["performance_metrics"].select("rmse").scalar()
        flag = report["alert"].select("alert_triggered").scalar()
        message = report["alert"].select("message").scalar()
    return features.unionByName(predictions).withColumns(
        {
            "rmse_threshold": F.lit(float(settings.rmse_threshold)),
            "monitored_rmse": rmse,
            "alert_triggered": flag,
            "alert_message": message,
        }
    )
