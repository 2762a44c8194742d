"""Data-quality profile and input guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import (
    EMPTY_FILE,
    INVALID_TIME_GRAIN,
    MEAN_MISMATCH,
    MISSING_COLUMN,
    MISSING_FILE,
    PASSED,
    ROW_COUNT_MISMATCH,
    VALID_NOTE,
)
from tidemark.operators.ordering import ranked_values
from tidemark.operators.quantiles import QUARTILES, pick_quantiles, quantiles
from tidemark.session import materialize, small_table

TARGET = "traffic_volume"


def overview(df: DataFrame) -> DataFrame:
    """Row count next to every column's name, position and type."""
    columns = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(t).alias("data_type"))
            for i, (c, t) in enumerate(df.dtypes)
        ]
    )
    return df.agg(F.count("*").alias("row_count")).select("row_count", F.inline(columns))


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first rows in an explicit order, since files have none."""
    return df.orderBy(*order).limit(n)


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and percent of every column, from one scan."""
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return counts.unpivot("_rows", df.columns, "column_name", "missing_count").select(
        "column_name",
        "missing_count",
        (F.try_divide(F.col("missing_count") * 100.0, F.col("_rows"))).alias("missing_pct"),
    )


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy of each distinct row. Copies are counted map-side."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    return copies.agg(
        F.sum("_copies").alias("row_count"),
        F.sum(F.col("_copies") - 1).alias("duplicate_count"),
    ).withColumn("duplicate_pct", F.try_divide(F.col("duplicate_count") * 100.0, F.col("row_count")))


def deduplicate(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def time_range(df: DataFrame, time: str = "date_time") -> DataFrame:
    return df.agg(F.min(time).alias("earliest"), F.max(time).alias("latest"))


def negative_count(df: DataFrame, value: str = TARGET) -> DataFrame:
    return df.agg(F.count_if(F.col(value) < 0).alias("negative_count"))


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [c for c, t in df.dtypes if t in kinds]


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles and max per numeric column.

    The columns are unpivoted so that one aggregate and one ranking serve all of them.
    """
    columns = list(columns or numeric_columns(df))
    long = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
                    for c in columns
                ]
            )
        )
    ).filter("value IS NOT NULL")
    moments = long.groupBy("column_name").agg(
        F.count("*").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return moments.join(quantiles(long, "value", QUARTILES, ["column_name"], few_groups=True), "column_name")


def iqr_outliers(df: DataFrame, value: str = TARGET) -> DataFrame:
    """Tukey fences and the rows outside them."""
    ranked = materialize(ranked_values(df, value), "ranked")
    size = ranked.agg(F.sum("n")).first()[0]
    if not size:
        raise ValueError(f"column '{value}' has no values")
    q = pick_quantiles(ranked, value, {"q1": 0.25, "q3": 0.75}, {None: size})[None]
    q1, q3 = q["q1"], q["q3"]
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    v, n = F.col(value), F.col("n")
    counts = ranked.agg(
        F.sum(n).alias("_n"),
        F.coalesce(F.sum(F.when(v < low, n)), F.lit(0)).alias("outliers_below"),
        F.coalesce(F.sum(F.when(v > high, n)), F.lit(0)).alias("outliers_above"),
    )
    total = F.col("outliers_below") + F.col("outliers_above")
    return counts.select(
        F.lit(q1).alias("q1"),
        F.lit(q3).alias("q3"),
        F.lit(q3 - q1).alias("iqr"),
        F.lit(low).alias("lower_bound"),
        F.lit(high).alias("upper_bound"),
        "outliers_below",
        "outliers_above",
        total.alias("outliers_total"),
        (total * 100.0 / F.col("_n")).alias("outliers_pct"),
    )


def require_values(df: DataFrame, column: str, name: str = "dataset") -> DataFrame:
    """Fail unless the column holds at least one value; reads no more than it must."""
    if column not in df.columns:
        raise ValueError(f"{name} is missing column '{column}'")
    if df.select(column).filter(F.col(column).isNotNull()).isEmpty():
        raise ValueError(f"{name} is empty or column '{column}' has no values")
    return df


def require_rows(df: DataFrame | None, name: str) -> DataFrame:
    if df is None or not df.columns or df.isEmpty():
        raise ValueError(f"{name} cannot be empty or None")
    return df


# Allowed ranges of calendar features.
ALLOWED_RANGES = {"hour": (0, 23), "month": (1, 12)}


def range_violations(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return df.agg(
        *[F.count_if(~F.col(c).between(*bounds)).alias(c) for c, bounds in ranges.items()]
    )


def require_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Fail if a present column has values outside its allowed range."""
    ranges = {c: b for c, b in (ranges or ALLOWED_RANGES).items() if c in df.columns}
    if ranges:
        found = range_violations(df, ranges).first()
        for c, (low, high) in ranges.items():
            if found[c]:
                raise ValueError(f"values of {c!r} outside {low} to {high}")
    return df


def _table_report(
    name: str,
    df: DataFrame,
    rows: int | None,
    mean: tuple[str, float, float] | None,
    columns: Sequence[str],
    hours: int | None,
) -> DataFrame:
    """The report row of one table, from one aggregate over it. A later rule's status wins, as the
    notes of all broken rules are kept."""
    mean_ready = mean is not None and mean[0] in df.columns
    nulls = [F.count_if(F.col(c).isNull()) for c in df.columns]
    facts = df.agg(
        F.count("*").alias("row_count"),
        sum(nulls[1:], nulls[0]).alias("null_count"),
        (F.avg(mean[0]) if mean_ready else F.lit(None).cast("double")).alias("_mean"),
    )
    n = F.col("row_count")
    rules = [(n == 0, EMPTY_FILE, F.lit("0 rows"))]
    if rows is not None:
        rules.append((n != rows, ROW_COUNT_MISMATCH, F.format_string(f"Expected {rows:,} rows, got %d", n)))
    if mean is not None:
        off = F.col("_mean").isNull() | (F.abs(F.col("_mean") - mean[1]) > mean[2])
        got = F.coalesce(F.format_string("%.2f", F.col("_mean")), F.lit("none"))
        rules.append((off, MEAN_MISMATCH, F.concat(F.lit(f"Expected mean ~{mean[1]:g}, got "), got)))
    for c in columns:
        if c not in df.columns:
            rules.append((F.lit(True), MISSING_COLUMN, F.lit(f"Missing {c}")))
    if hours is not None:
        rules.append((n != hours, INVALID_TIME_GRAIN, F.format_string(f"Expected {hours} hours, got %d", n)))
    status = F.lit(PASSED)
    for broken, verdict, _ in rules:
        status = F.when(broken, verdict).otherwise(status)
    notes = F.concat_ws("; ", *[F.when(broken, note) for broken, _, note in rules])
    return facts.select(
        F.lit(name).alias("table_name"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        "null_count",
        status.alias("status"),
        F.when(notes == "", VALID_NOTE).otherwise(notes).alias("notes"),
    )


def validate_layer(
    tables: dict[str, DataFrame | None],
    expected_rows: dict[str, int] | None = None,
    expected_means: dict[str, tuple[str, float, float]] | None = None,
    required: dict[str, Sequence[str]] | None = None,
    hours: dict[str, int] | None = None,
) -> DataFrame:
    """One report row per table: rows, columns, nulls, status and notes.

    Rules are data: exact row counts, ``(column, mean, tolerance)``, required columns and the hours
    of a time table. A table that is None, or has no columns, is missing. Each table is read by one
    aggregate; ``all_passed`` repeats the overall verdict on every row.
    """
    expected_rows, expected_means = expected_rows or {}, expected_means or {}
    required, hours = required or {}, hours or {}
    reports, missing = [], []
    for name, df in tables.items():
        if df is None or not df.columns:
            missing.append((name, 0, 0, 0, MISSING_FILE, "File missing"))
        else:
            rules = expected_rows.get(name), expected_means.get(name), required.get(name, []), hours.get(name)
            reports.append(_table_report(name, df, *rules))
    if missing:
        spark = SparkSession.active()
        schema = "table_name string, row_count bigint, column_count int, null_count bigint, status string, notes string"
        reports.append(small_table(spark, missing, schema))
    report = reports[0]
    for more in reports[1:]:
        report = report.unionByName(more)
    failed = report.agg(F.count_if(F.col("status") != PASSED)).scalar()
    return report.withColumn("all_passed", failed == 0)
