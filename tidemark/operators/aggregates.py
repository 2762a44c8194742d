"""Grouped summaries, profiles, histograms and reshapes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import CALENDAR_FEATURES, DEFAULTS, WEEKDAY_NAMES, Settings
from tidemark.functions import calendar, labels
from tidemark.operators.ordering import value_counts
from tidemark.operators.quantiles import QUARTILES, overall_quantiles, quantiles

TARGET = "traffic_volume"


def _rounded(column: Column, digits: int | None) -> Column:
    return column if digits is None else F.round(column, digits)


def volume_summary(
    df: DataFrame, keys: dict[str, Column], parts: Sequence[str], digits: int | None = 2
) -> DataFrame:
    """Count, average, sum, minimum and maximum of the volume per group, as chosen by ``parts``."""
    v = F.col(TARGET)
    available = {
        "record_count": F.count("*"),
        "avg_traffic_volume": _rounded(F.avg(v), digits),
        "total_traffic_volume": F.sum(v),
        "min_traffic_volume": F.min(v),
        "max_traffic_volume": F.max(v),
    }
    grouped = df.groupBy(*[c.alias(k) for k, c in keys.items()])
    return grouped.agg(*[available[p].alias(p) for p in parts])


def daily_fact(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Per date. The calendar columns are functions of the date, so they are derived after the
    aggregate instead of being carried through it."""
    v = F.col(TARGET)
    daily = df.groupBy(F.to_date("date_time").alias("date")).agg(
        F.sum(v).alias("total_traffic_volume"),
        _rounded(F.avg(v), digits).alias("avg_traffic_volume"),
        F.min(v).alias("min_traffic_volume"),
        F.max(v).alias("max_traffic_volume"),
        F.count(v).alias("record_count"),
    )
    d, weekday = F.col("date"), F.weekday("date")
    return daily.select(
        "date",
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        calendar.month_abbreviation(F.month(d)).alias("month_name"),
        F.dayofmonth(d).alias("day"),
        weekday.alias("weekday"),
        calendar.weekday_name(weekday).alias("weekday_name"),
        calendar.is_weekday(weekday).alias("is_weekday"),
        "total_traffic_volume",
        "avg_traffic_volume",
        "min_traffic_volume",
        "max_traffic_volume",
        "record_count",
    )


def monthly_fact(df: DataFrame, digits: int | None = 2) -> DataFrame:
    v = F.col(TARGET)
    monthly = df.groupBy(F.year("date_time").alias("year"), F.month("date_time").alias("month")).agg(
        _rounded(F.avg(v), digits).alias("avg_traffic_volume"),
        F.sum(v).alias("total_traffic_volume"),
        F.max(v).alias("peak_hourly_volume"),
        F.count(v).alias("record_count"),
    )
    return monthly.select(
        "year",
        "month",
        F.format_string("%04d-%02d", "year", "month").alias("year_month"),
        calendar.month_abbreviation(F.col("month")).alias("month_name"),
        "avg_traffic_volume",
        "total_traffic_volume",
        "peak_hourly_volume",
        "record_count",
    )


def diurnal_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("hour", calendar.day_type(F.col("weekday")).alias("day_type")).agg(
        F.avg(TARGET).alias("avg_traffic_volume")
    )


def weekday_means(df: DataFrame) -> DataFrame:
    """Seven rows, Monday to Sunday; a day without data keeps a null mean."""
    week = df.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    means = df.groupBy("weekday").agg(F.avg(TARGET).alias("avg_traffic_volume"))
    return (
        week.join(means, "weekday", "left")
        .withColumn("weekday_name", calendar.weekday_name(F.col("weekday")))
        .orderBy("weekday")
    )


def hour_weekday_pivot(df: DataFrame) -> DataFrame:
    """Mean per hour and weekday, one column per weekday that occurs."""
    present = {r[0] for r in df.select("weekday").distinct().collect()}
    days = [WEEKDAY_NAMES[d] for d in range(7) if d in present]
    named = df.withColumn("weekday_name", calendar.weekday_name(F.col("weekday")))
    return named.groupBy("hour").pivot("weekday_name", days).agg(F.avg(TARGET)).orderBy("hour")


def bucket_mix(df: DataFrame, settings: Settings = DEFAULTS, export_labels: bool = True) -> DataFrame:
    """Rows per volume bucket, most frequent first."""
    moderate = settings.moderate_export_label if export_labels else None
    bucket = labels.volume_bucket(F.col(TARGET), settings, moderate)
    return (
        df.groupBy(bucket.alias("volume_bucket"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), "volume_bucket")
    )


def calendar_means(df: DataFrame) -> DataFrame:
    """Means by hour, by weekday and by month in one pass."""
    keys = ["hour", "weekday", "month"]
    grouped = df.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("_set"), F.avg(TARGET).alias("avg_traffic_volume")
    )
    return grouped.select(
        F.when(F.col("_set") == 3, "hour").when(F.col("_set") == 5, "weekday").otherwise("month").alias("dimension"),
        F.coalesce(*keys).alias("value"),
        "avg_traffic_volume",
    )


def box_summary(df: DataFrame, by: Sequence[str] = (), value: str = TARGET) -> DataFrame:
    """Quartiles and whiskers (the outermost values within 1.5 IQR) per group.

    The whiskers are taken from the distinct values, which are few compared with the rows.
    """
    by = list(by)
    counted = value_counts(df, value, by)
    if by:
        few = set(by) <= set(CALENDAR_FEATURES)
        marks = quantiles(df, value, QUARTILES, by, few)
        fenced = counted.join(F.broadcast(marks) if few else marks, by)
    else:
        marks = overall_quantiles(df, value, QUARTILES)
        fenced = counted.withColumns({k: F.lit(v) for k, v in marks.items()})
    iqr = F.col("q3") - F.col("q1")
    v = F.col(value)
    return fenced.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(v >= F.col("q1") - 1.5 * iqr, v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("q3") + 1.5 * iqr, v)).alias("whisker_high"),
    )


def histogram(df: DataFrame, value: str = TARGET, bins: int = 50) -> DataFrame:
    """Equal-width bins over the observed range; the last bin includes its upper edge."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        raise ValueError(f"column '{value}' has no values")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    index = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(value).isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.col("bin") * width + lo).alias("bin_start"),
        ((F.col("bin") + 1) * width + lo).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


# Beyond this many bandwidths the Gaussian kernel is exactly zero in double precision.
KERNEL_REACH = 38.7


def density(df: DataFrame, value: str = TARGET, points: int = 200) -> DataFrame:
    """Gaussian kernel density at evenly spaced points over the observed range, with Scott's
    bandwidth. Equal values are collapsed first, a value visits only the points its kernel reaches,
    and partial sums leave each task with one row per point, so the shuffle does not grow with the
    data."""
    s = df.agg(
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        F.count(value).alias("n"),
        F.stddev_samp(value).alias("sd"),
    ).first()
    if not s["sd"]:
        raise ValueError(f"column '{value}' needs at least two different values")
    lo, h = float(s["lo"]), s["sd"] * s["n"] ** -0.2
    step = (s["hi"] - s["lo"]) / (points - 1)
    v = F.col(value)
    first = F.greatest(F.lit(0), F.ceil((v - KERNEL_REACH * h - lo) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((v + KERNEL_REACH * h - lo) / step)).cast("int")
    reached = F.when(first <= last, F.sequence(first, last))
    spread = value_counts(df, value).select(v.alias("_v"), "n", F.explode(reached).alias("point"))
    x = F.col("point") * step + lo
    z = (x - F.col("_v")) / h
    sums = spread.groupBy("point").agg(F.sum(F.col("n") * F.exp(-0.5 * z * z)).alias("_k"))
    scale = 1.0 / (s["n"] * h * math.sqrt(2 * math.pi))
    every = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    return every.join(sums, "point", "left").select(
        "point", x.alias("x"), (F.coalesce("_k", F.lit(0.0)) * scale).alias("density")
    )


def conditional_shift(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Rush against non-rush and weekday against weekend means, with the percent shift.

    A side without rows falls back to the overall mean; a shift over a non-positive base is 0.
    """
    v, rush, work = F.col(TARGET), F.col("is_rush") == 1, F.col("weekday") < 5
    means = df.agg(
        F.avg(v).alias("_all"),
        F.avg(F.when(rush, v)).alias("_rush"),
        F.avg(F.when(~rush, v)).alias("_non_rush"),
        F.avg(F.when(work, v)).alias("_weekday"),
        F.avg(F.when(~work, v)).alias("_weekend"),
    ).select(
        *[
            F.coalesce(f"_{c}", "_all").alias(f"{c}_mean")
            for c in ("rush", "non_rush", "weekday", "weekend")
        ]
    )

    def shift(a: str, b: str) -> Column:
        base = F.col(b)
        return F.when(base > 0, (F.col(a) - base) / base * 100).otherwise(0.0)

    return means.select(
        "*",
        (F.col("rush_mean") - F.col("non_rush_mean")).alias("rush_diff"),
        shift("rush_mean", "non_rush_mean").alias("rush_pct_shift"),
        (F.col("weekday_mean") - F.col("weekend_mean")).alias("weekday_diff"),
        shift("weekday_mean", "weekend_mean").alias("weekday_pct_shift"),
    )


def bucket_shares(df: DataFrame, settings: Settings = DEFAULTS, digits: int | None = 2) -> DataFrame:
    """Rows per bucket and percent of all rows. The total is summed over the few bucket rows, so
    the data is read once."""
    bucket = labels.volume_bucket(F.col(TARGET), settings)
    counts = df.groupBy(bucket.alias("volume_bucket")).agg(F.count("*").alias("record_count"))
    total = F.sum("record_count").over(Window.partitionBy())
    return counts.withColumn("percentage", _rounded(F.col("record_count") * 100.0 / total, digits))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Share of each group in the whole table, the total being an uncorrelated scalar subquery."""
    total = df.agg(F.count("*")).scalar()
    counts = df.groupBy(key).agg(F.count("*").alias("record_count"))
    return counts.withColumn("percentage", F.col("record_count") * 100.0 / total)


def long_metrics(df: DataFrame, keys: Sequence[str], metrics: dict[str, str]) -> DataFrame:
    """Wide metrics to one row per metric, relabelled by the given texts."""
    long = df.select(*keys, *[F.col(m).cast("double").alias(t) for m, t in metrics.items()])
    return long.unpivot(list(keys), list(metrics.values()), "metric", "value")


def prediction_balance(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Under- and over-predictions; exact hits count as neither."""
    a, p = F.col(actual), F.col(predicted)
    counts = df.agg(
        F.count("*").alias("total_samples"),
        F.count_if(a > p).alias("underpred_count"),
        F.count_if(a < p).alias("overpred_count"),
    )
    return counts.select(
        "*",
        F.try_divide(F.col("underpred_count") * 100.0, F.col("total_samples")).alias("underpred_pct"),
        F.try_divide(F.col("overpred_count") * 100.0, F.col("total_samples")).alias("overpred_pct"),
    )
