"""Reading observations and the shared preparation every job starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import DEFAULTS, Settings
from tidemark.functions import calendar

RAW_SCHEMA = T.StructType(
    [
        T.StructField("holiday", T.StringType()),
        T.StructField("temp", T.DoubleType()),
        T.StructField("rain_1h", T.DoubleType()),
        T.StructField("snow_1h", T.DoubleType()),
        T.StructField("clouds_all", T.IntegerType()),
        T.StructField("weather_main", T.StringType()),
        T.StructField("weather_description", T.StringType()),
        T.StructField("date_time", T.StringType()),
        T.StructField("traffic_volume", T.IntegerType()),
    ]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str = RAW_SCHEMA) -> DataFrame:
    """Headered CSV with a declared schema: no inference pass over the data."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Headered CSV. ``single_file`` is for summaries of a known handful of rows."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """``df`` itself, or an error that lists what it lacks; reads no data."""
    present = set(df.columns)
    if not present.issuperset(columns):
        absent = ", ".join(c for c in columns if c not in present)
        raise ValueError(f"{name} lacks the columns: {absent}")
    return df


def identity(df: DataFrame) -> Column:
    """A number that depends on all columns of a row, nulls included, and on nothing else."""
    return F.xxhash64(*[x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def prepare(
    raw: DataFrame,
    settings: Settings = DEFAULTS,
    deduplicate: bool = True,
    identified: bool = True,
    strict: bool = True,
) -> DataFrame:
    """Parsed, de-duplicated observations with calendar features: the base of every job.

    Copies collapse in the map-side step of the aggregate, so a row repeated across a third of
    the input is not gathered anywhere. Rows without an ``obs_id`` get one from their raw columns,
    which orders rows of the same time alike however they are partitioned (not if ``identified`` is
    false, for tables with one row per time). A time that no known format fits is an error, or null
    if not ``strict``; a row without a time is kept and comes last in every order.
    """
    df = raw.dropDuplicates() if deduplicate else raw
    if identified and "obs_id" not in df.columns:
        df = df.withColumn("obs_id", identity(df))
    kind = df.schema["date_time"].dataType
    if isinstance(kind, T.StringType):
        df = df.withColumn("date_time", calendar.parse_time(F.col("date_time"), strict=strict))
    elif not isinstance(kind, T.TimestampNTZType):
        df = df.withColumn("date_time", F.col("date_time").cast("timestamp_ntz"))
    return calendar.with_calendar(df, settings)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations_from_events(
    spark: SparkSession, folder: str, settings: Settings = DEFAULTS
) -> DataFrame:
    """The event table in the observation schema; ``obs_id`` breaks ties in time."""
    k = F.get_json_object("props", "$.k").cast("int")
    raw = table(spark, folder, "events").select(
        F.col("event_id").alias("obs_id"),
        F.col("ts").alias("date_time"),
        F.col("value").alias("traffic_volume"),
        F.col("event_type").alias("weather_main"),
        (k + 250.0).alias("temp"),
        (F.col("user_id") / 10.0).alias("rain_1h"),
        k.alias("clouds_all"),
    )
    return prepare(raw, settings, deduplicate=False)


def hourly_from_events(
    spark: SparkSession, folder: str, settings: Settings = DEFAULTS
) -> DataFrame:
    """Events per hour as a volume series, the grain the forecasting jobs work on."""
    hour = calendar.hour_start(F.col("ts"))
    hourly = (
        table(spark, folder, "events")
        .groupBy(hour.alias("date_time"))
        .agg(
            F.count("*").cast("double").alias("traffic_volume"),
            F.avg("value").alias("temp"),
            F.avg(F.get_json_object("props", "$.k").cast("int")).alias("clouds_all"),
        )
    )
    return prepare(hourly, settings, deduplicate=False, identified=False)


def observations_from_orders(
    spark: SparkSession, folder: str, settings: Settings = DEFAULTS
) -> DataFrame:
    """Orders in the observation schema: several years, many rows per time."""
    raw = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("obs_id"),
        F.col("o_orderdate").alias("date_time"),
        F.col("o_totalprice").alias("traffic_volume"),
        F.col("o_orderpriority").alias("weather_main"),
        F.col("o_custkey").alias("custkey"),
    )
    return prepare(raw, settings, deduplicate=False)
