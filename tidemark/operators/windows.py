"""Lags, rolling statistics, exponential averages and ranks over one global order.

All row-based features share one exchange: see ``ordering.over_blocks``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import hour_start
from tidemark.operators.ordering import halo_chunks, lookup, over_blocks, ranked_values

TARGET = "traffic_volume"
TIME_KEYS = ("date_time", "obs_id")


def _finish(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    return df.filter("owned").drop("owned", "chunk", *drop)


def rolling_average(
    df: DataFrame,
    rows: int = 24,
    name: str = "rolling_24h_avg",
    keys: Sequence[str] = TIME_KEYS,
    series: Sequence[str] = (),
    digits: int | None = 2,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Average over the current and the preceding ``rows - 1`` rows; shorter at the start.
    ``chunk_rows`` sets the rows of a block here and below; see ``ordering.over_blocks``."""

    def features(df: DataFrame, parts: list[str], order: list[Column]) -> DataFrame:
        average = F.avg(TARGET).over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(-(rows - 1), 0))
        return df.withColumn(name, average if digits is None else F.round(average, digits))

    return over_blocks(df, keys, rows - 1, features, series, chunk_rows)


def lag_features(
    df: DataFrame,
    lags: Sequence[int] = (1, 24),
    keys: Sequence[str] = TIME_KEYS,
    series: Sequence[str] = (),
    chunk_rows: int | None = None,
) -> DataFrame:
    """``lag_<n>h``: the volume n rows earlier."""

    def features(df: DataFrame, parts: list[str], order: list[Column]) -> DataFrame:
        place = Window.partitionBy(*parts).orderBy(*order)
        return df.withColumns({f"lag_{n}h": F.lag(TARGET, n).over(place) for n in lags})

    return over_blocks(df, keys, max(lags), features, series, chunk_rows)


def _decay(span: int) -> tuple[float, int]:
    """Decay factor of an exponential average, and the number of rows after which a weight is below
    double precision."""
    q = 1.0 - 2.0 / (span + 1)
    return q, math.ceil(math.log(1e-18) / math.log(q)) if q > 0 else 1


def _exponential_average(v: Column, q: float, reach: int, parts: Sequence[str]) -> Column:
    """``sum(q^age * v) / sum(q^age)`` over the rows before each row, which has its ``_place`` in its part.

    Rows are cut into runs of ``reach``, ``_run``. A row adds up its own run so far, with weights relative to
    the start of the run, and the whole run before it; older rows weigh nothing. No weight leaves
    the range of ``q^reach``, however long a part is.
    """
    inside = F.col("_place") - F.col("_run") * reach
    so_far = Window.partitionBy(*parts, "_run").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*parts).orderBy("_run").rangeBetween(-1, -1)

    def weighted(x: Column) -> Column:
        own = F.sum(x * F.pow(F.lit(q), -inside.cast("double"))).over(so_far)
        last = F.sum(x * F.pow(F.lit(q), (reach - 1 - inside).cast("double"))).over(before)
        scale = F.pow(F.lit(q), (inside - 1).cast("double"))
        return F.coalesce(own * scale, F.lit(0.0)) + F.coalesce(last * scale * q, F.lit(0.0))

    return F.try_divide(weighted(v), weighted(F.when(v.isNotNull(), 1.0)))


def forecasting_features(
    df: DataFrame,
    keys: Sequence[str] = TIME_KEYS,
    series: Sequence[str] = (),
    lags: Sequence[int] = (1, 24),
    window: int = 24,
    span: int = 24,
    chunk_rows: int | None = None,
    drop_incomplete: bool = True,
) -> DataFrame:
    """Lags, rolling mean and sample deviation of the previous ``window`` rows, and the bias-adjusted
    exponential average of all previous rows. The current volume enters none of them.

    Rolling features need a full window of values. ``drop_incomplete`` drops rows whose history is
    too short for a feature, and no others.
    """
    q, reach = _decay(span)
    v = F.col(TARGET).cast("double")

    def features(df: DataFrame, parts: list[str], order: list[Column]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*parts).orderBy(*order)) - 1
        placed = df.withColumn("_place", place).withColumn("_run", F.floor(F.col("_place") / reach))
        # By run and place, the order that the average needs as well, so that rows are sorted once more only.
        ordered = Window.partitionBy(*parts).orderBy("_run", "_place")
        previous = ordered.rowsBetween(-window, -1)
        full = F.count(v).over(previous) == window
        # A span of one row leaves no weight but that of the row before.
        average = _exponential_average(v, q, reach, parts) if q > 0 else F.lag(v, 1).over(ordered)
        return placed.withColumns(
            {
                **{f"lag_{n}h": F.lag(v, n).over(ordered) for n in lags},
                f"rolling_mean_{window}h": F.when(full, F.avg(v).over(previous)),
                f"rolling_std_{window}h": F.when(full, F.stddev_samp(v).over(previous)),
                f"ewma_{span}h": average,
            }
        ).drop("_place", "_run")

    done = over_blocks(df, keys, max(*lags, window, reach), features, series, chunk_rows)
    if drop_incomplete:
        names = [f"lag_{n}h" for n in lags] + [f"rolling_mean_{window}h", f"rolling_std_{window}h", f"ewma_{span}h"]
        complete = F.lit(True)
        for name in names:
            complete = complete & F.col(name).isNotNull()
        done = done.filter(complete)
    return done


def volume_rank(
    df: DataFrame, value: str = TARGET, name: str = "volume_rank"
) -> DataFrame:
    """``RANK() OVER (ORDER BY value DESC)``: the rank of a value is one more than the rows above it,
    so only distinct values are ordered."""
    ranks = ranked_values(df, value, descending=True).withColumnRenamed("min_rank", name)
    return lookup(df, ranks.select(value, "n", name), value, [name])


def hourly_means(df: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """One row per hour: repeated hours become their mean."""
    return df.groupBy(*series, hour_start(F.col("date_time")).alias("date_time")).agg(
        F.avg(TARGET).alias(TARGET)
    )


def time_features(
    df: DataFrame, series: Sequence[str] = (), chunk_days: int = 32, lags: Sequence[int] = (1, 24)
) -> DataFrame:
    """The same features counted in hours instead of rows, so gaps do not shift them.

    Repeated hours are collapsed first, which bounds a chunk by the calendar: 24 rows a day.
    """
    hourly = hourly_means(df, series).withColumn(
        "_hours", (F.unix_date(F.to_date("date_time")) * 24 + F.hour("date_time")).cast("long")
    )
    chunk_hours, look = chunk_days * 24, max(24, *lags)
    chunked = halo_chunks(hourly, look, chunk_hours, "_hours")
    place = Window.partitionBy("chunk", *series).orderBy("_hours")

    def hours(first: int, last: int) -> Window:
        return place.rangeBetween(first, last)

    v: Column = F.col(TARGET)
    features = chunked.withColumns(
        {
            "rolling_24h_avg": F.avg(v).over(hours(-23, 0)),
            **{f"lag_{n}h": F.max(v).over(hours(-n, -n)) for n in lags},
            "rolling_mean_24h": F.avg(v).over(hours(-24, -1)),
            "rolling_std_24h": F.stddev_samp(v).over(hours(-24, -1)),
        }
    )
    return _finish(features, ["_hours"])

