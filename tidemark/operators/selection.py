"""Filters, sorts, top-k, samples and constant overrides."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET = "traffic_volume"


def slice_observations(
    df: DataFrame,
    start: str | None = None,
    end: str | None = None,
    rush: bool | None = None,
    weekday: bool | None = None,
    years: Sequence[int] | None = None,
    categories: Sequence[str] | None = None,
    hours: Sequence[int] | None = None,
) -> DataFrame:
    """Slicers. Dates are inclusive and compare the stored time itself, so they reach the scan."""
    t = F.col("date_time")
    if start is not None:
        df = df.filter(t >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(t < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    if years is not None:
        inside = F.lit(False)
        for y in years:
            inside = inside | (
                (t >= F.lit(f"{y:04d}-01-01").cast("timestamp_ntz"))
                & (t < F.lit(f"{y + 1:04d}-01-01").cast("timestamp_ntz"))
            )
        df = df.filter(inside)
    if rush is not None:
        df = df.filter(F.col("is_rush") == int(rush))
    if weekday is not None:
        df = df.filter(F.col("weekday") < 5 if weekday else F.col("weekday") >= 5)
    if categories is not None:
        df = df.filter(F.col("weather_main").isin(*categories))
    if hours is not None:
        df = df.filter(F.col("hour").isin(*hours))
    return df


def matching(df: DataFrame, column: str, pattern: str, ignore_case: bool = True) -> DataFrame:
    """Rows whose text contains a match of the pattern; nulls never match."""
    return df.filter(F.col(column).rlike(("(?i)" if ignore_case else "") + pattern))


def override(df: DataFrame, constants: dict[str, Any]) -> DataFrame:
    """Replace those of the named columns that are present by constants of the same type."""
    types = dict(df.dtypes)
    return df.withColumns({c: F.lit(v).cast(types[c]) for c, v in constants.items() if c in types})


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def chronological(df: DataFrame, keys: Sequence[str] = ("date_time", "obs_id")) -> DataFrame:
    """Total order by time with an explicit tie-breaker: a range shuffle, not one task."""
    return df.orderBy(*keys)


def first_rows(df: DataFrame, n: int, keys: Sequence[str] = ("date_time", "obs_id")) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def top_groups_by_mean(df: DataFrame, key: str, k: int = 3, value: str = TARGET) -> DataFrame:
    """The k groups with the highest mean; equal means keep the smaller key first."""
    means = df.groupBy(key).agg(F.avg(value).alias("mean_value"))
    return means.orderBy(F.col("mean_value").desc(), key).limit(k)


def by_magnitude(df: DataFrame, column: str, tie: str) -> DataFrame:
    return df.orderBy(F.abs(F.col(column)).desc(), tie)


def hash_text(identity: Sequence[str], seed: int) -> Column:
    """A uniform 32-digit text per row identity and seed, the same however rows are partitioned."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in identity], F.lit(str(seed))))


def hash_share(identity: Sequence[str], seed: int) -> Column:
    """A uniform number in [0, 1) per row identity and seed."""
    return F.conv(F.substring(hash_text(identity, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def fixed_sample(df: DataFrame, n: int, identity: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows without replacement: the n smallest hashes, found by a per-task top-k."""
    return df.orderBy(hash_text(identity, seed), *identity).limit(n)


def random_split(
    df: DataFrame, train_share: float, identity: Sequence[str], seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Seeded split by row identity; unlike a random draw it survives re-partitioning."""
    share = hash_share(identity, seed)
    return df.filter(share < train_share), df.filter(share >= train_share)


def top_k_per_year(df: DataFrame, k: int = 5, value: str = TARGET) -> DataFrame:
    """Rows holding one of the k highest distinct volumes of their year.

    Distinct values are ranked per year, where a limit per task applies before the shuffle; the
    surviving table has at most k rows per year and selects the data rows by broadcast.
    """
    year = F.year("date_time")
    distinct = df.select(year.alias("year"), F.col(value)).filter(F.col(value).isNotNull()).distinct()
    best = Window.partitionBy("year").orderBy(F.col(value).desc())
    top = distinct.withColumn("volume_rank", F.dense_rank().over(best)).filter(F.col("volume_rank") <= k)
    # A few thousand rows at most for usual k; for others Spark decides by the size it sees.
    return df.withColumn("year", year).join(F.broadcast(top) if k <= 100 else top, ["year", value])
