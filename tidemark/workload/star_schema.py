"""Star-schema tables, joins, measures, file formats and streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators import measures, modeling, quality, selection, windows
from tidemark.plans import reports, star
from tidemark.session import scratch_path
from tidemark.sources import datasets
from tidemark.sources import observations as obs
from tidemark.streaming import jobs
from tidemark.workload.inputs import (
    EV,
    EV_FORECAST,
    EV_SPLIT,
    EVENTS,
    HR,
    ORD,
    ORDERS,
    events,
    hourly,
    orders,
    scored_events,
    scored_forecast,
)
from tidemark.workload.modelling import BUCKET, LINE_SQL, STACKED_SQL
from tidemark.workload.registry import query

EXPORT_BUCKET = BUCKET.replace("(20-100)", "(20-99)")


@query(
    "star_hourly", "X1 P4 P7 P8 P9 P23",
    "date_time:t date:y year:i month:i month_name:s day:i hour:i weekday:i weekday_name:s is_weekday:i is_rush:i temp_celsius:d temp:d rain_1h:d clouds_all:i weather_main:s traffic_volume:d volume_bucket:s",
    EV + f"""SELECT *, date_time::DATE AS date, year(date_time) AS year, strftime(date_time, '%b') AS month_name, dayname(date_time) AS weekday_name,
      CASE WHEN weekday < 5 THEN 1 ELSE 0 END AS is_weekday, round(temp - 273.15::DOUBLE, 2) AS temp_celsius, {EXPORT_BUCKET} AS volume_bucket FROM ev""",
)
def _(spark, folder):
    return star.traffic_hourly(events(spark, folder), EVENTS)


FORECAST = " ".join(
    f"{c}:{'t' if c == 'date_time' else 'i' if c in ('hour', 'weekday', 'is_rush') else 'd'}" for c in star.FORECAST_COLUMNS
)


@query("demand_forecast", "X4 M7 M8 P16 J3", FORECAST, EV_FORECAST + "SELECT * FROM forecast")
def _(spark, folder):
    return star.demand_forecast(scored_forecast(spark, folder))


DIM_DATE = "date:y year:i quarter:i month:i month_name:s day:i day_of_week:i weekday_name:s is_weekday:i week_of_year:i"
DIM_DATE_SQL = """SELECT d::DATE AS date, year(d) AS year, quarter(d) AS quarter, month(d) AS month, monthname(d) AS month_name, day(d) AS day,
  isodow(d) - 1 AS day_of_week, dayname(d) AS weekday_name, CASE WHEN isodow(d) < 6 THEN 1 ELSE 0 END AS is_weekday, weekofyear(d) AS week_of_year
  FROM (SELECT unnest(generate_series(date_trunc('day', (SELECT min(date_time) FROM {t})), date_trunc('day', (SELECT max(date_time) FROM {t})), INTERVAL 1 DAY)) AS d)"""


@query("dim_date", "X9", DIM_DATE, ORD + DIM_DATE_SQL.format(t="od"))
def _(spark, folder):
    return star.dim_date(orders(spark, folder))


PERIOD_SQL = """CASE WHEN hour BETWEEN 7 AND 9 THEN 'Morning Rush' WHEN hour BETWEEN 17 AND 19 THEN 'Evening Rush'
      WHEN hour BETWEEN 10 AND 16 THEN 'Midday Off-Peak' WHEN hour >= 20 THEN 'Late Evening' ELSE 'Overnight Low' END"""


@query(
    "dim_time", "X10 P13 P14 J1", "hour:i time_label:s time_of_day_period:s is_rush_hour:i record_count:i",
    EV + f"SELECT hour, printf('%02d:00', hour) AS time_label, {PERIOD_SQL} AS time_of_day_period, is_rush AS is_rush_hour, count(*) AS record_count FROM ev GROUP BY hour, is_rush",
)
def _(spark, folder):
    """Every row of the dimension with the fact rows it selects."""
    times = star.dim_time(spark, EVENTS)
    counts = events(spark, folder).groupBy("hour").agg(F.count("*").alias("record_count"))
    return times.join(counts, "hour", "left")


VOLUME = "average_volume:d total_volume:m peak_volume:d rush_avg_volume:d non_rush_avg_volume:d rush_shift_pct:d weekday_avg_volume:d weekend_avg_volume:d weekday_shift_pct:d"
VOLUME_SQL = """avg(traffic_volume) AS average_volume, sum(traffic_volume) AS total_volume, max(traffic_volume) AS peak_volume,
  avg(traffic_volume) FILTER (is_rush = 1) AS rush_avg_volume, avg(traffic_volume) FILTER (is_rush = 0) AS non_rush_avg_volume,
  coalesce((rush_avg_volume - non_rush_avg_volume) / nullif(non_rush_avg_volume, 0), 0) AS rush_shift_pct,
  avg(traffic_volume) FILTER (weekday < 5) AS weekday_avg_volume, avg(traffic_volume) FILTER (weekday >= 5) AS weekend_avg_volume,
  coalesce((weekday_avg_volume - weekend_avg_volume) / nullif(weekend_avg_volume, 0), 0) AS weekday_shift_pct"""


@query("volume_measures", "B1 B2 B3", VOLUME, EV + f"SELECT {VOLUME_SQL} FROM ev")
def _(spark, folder):
    fact = star.traffic_hourly(events(spark, folder), EVENTS)
    return measures.evaluate(fact, measures.volume_measures())


@query(
    "star_join_measures", "J1 B1 B2 B3 X1 X9 X10", f"date_quarter:i time_time_of_day_period:s {VOLUME}",
    EV + f"SELECT quarter(date_time) AS date_quarter, {PERIOD_SQL} AS time_time_of_day_period, {VOLUME_SQL} FROM ev WHERE weekofyear(date_time) <= 4 GROUP BY 1, 2",
)
def _(spark, folder):
    """Measures over the fact, filtered and grouped through its dimensions."""
    df = events(spark, folder)
    joined = star.star_join(star.traffic_hourly(df, EVENTS), star.dim_date(df), star.dim_time(spark, EVENTS))
    chosen = joined.filter(F.col("date_week_of_year") <= 4)
    return measures.evaluate(chosen, measures.volume_measures(), ["date_quarter", "time_time_of_day_period"])


@query(
    "category_measures_by_region", "J1 B1 B2 B3", f"r_name:s weather_main:s {VOLUME}",
    ORD + f"""SELECT r_name, weather_main, {VOLUME_SQL} FROM od JOIN customer ON custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def _(spark, folder):
    """Nation and region are broadcast by Spark from their size; customers grow with the data, so
    that join is left to the planner as well."""
    df = orders(spark, folder).withColumn("is_weekday", calendar.is_weekday(F.col("weekday")))
    joined = (
        df.join(obs.table(spark, folder, "customer"), F.col("custkey") == F.col("c_custkey"))
        .join(obs.table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(obs.table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return measures.evaluate(joined, measures.volume_measures(), ["r_name", "weather_main"])


@query(
    "forecast_measures", "B4 B5 B6 B7 M9",
    "actual_volume:d ml_forecast_volume:d naive_volume:d mae_ml:d mae_naive:d rmse_ml:d r2_ml:d error_reduction_pct:d forecast_mean_bias:d",
    EV_FORECAST + """SELECT avg(actual_traffic_volume) AS actual_volume, avg(ml_rf_forecast_pred) AS ml_forecast_volume, avg(naive_lag1h_pred) AS naive_volume,
      avg(ml_rf_abs_error) AS mae_ml, avg(naive_lag1h_abs_error) AS mae_naive, sqrt(avg(ml_rf_squared_error)) AS rmse_ml, 1 - avg(ml_rf_squared_error) / var_pop(actual_traffic_volume) AS r2_ml,
      (mae_ml - mae_naive) / mae_naive AS error_reduction_pct, avg(ml_rf_error) AS forecast_mean_bias FROM forecast""",
)
def _(spark, folder):
    forecast = star.demand_forecast(scored_forecast(spark, folder))
    return measures.evaluate(forecast, measures.forecast_measures())


@query(
    "error_measures", "B8 B9", "holdout_mean_bias:d holdout_weighted_bias:d heavy_mean_bias:d heavy_mae:d",
    "WITH seg AS (" + STACKED_SQL + """) SELECT avg(mean_bias_error) AS holdout_mean_bias, sum(mean_bias_error * sample_count) / sum(sample_count) AS holdout_weighted_bias,
      avg(mean_bias_error) FILTER (segment_type = 'Traffic Volume Bucket' AND segment_label = 'Heavy (>=100)') AS heavy_mean_bias,
      avg(mae) FILTER (segment_type = 'Traffic Volume Bucket' AND segment_label = 'Heavy (>=100)') AS heavy_mae FROM seg""",
)
def _(spark, folder):
    segments = star.error_analysis(scored_events(spark, folder)[1], EVENTS, digits=None)
    return measures.evaluate(segments, measures.error_measures(EVENTS))


@query(
    "layer_validation", "Q9", "table_name:s row_count:i column_count:i null_count:i status:s notes:s all_passed:b",
    EV + """, v AS (SELECT 'traffic_hourly' AS table_name, count(*) AS row_count, 18 AS column_count, 0 AS null_count, 'FAILED (Mean Metric Mismatch)' AS status,
      printf('Expected mean ~3259.82, got %.2f', avg(traffic_volume)) AS notes FROM ev
    UNION ALL SELECT 'traffic_daily', count(DISTINCT date_time::DATE), 13, 0, 'PASSED', 'Valid Schema & Content' FROM ev
    UNION ALL SELECT 'traffic_monthly', 0, 8, 0, 'FAILED (Empty File)', '0 rows'
    UNION ALL SELECT 'demand_forecast', count(*), 1, 0, 'FAILED (Missing Column)', 'Missing ml_rf_forecast_pred' FROM ev
    UNION ALL SELECT 'business_kpis', 0, 0, 0, 'FAILED (Missing File)', 'File missing'
    UNION ALL SELECT 'error_analysis', count(*), 1, 0, 'FAILED (Row Count Mismatch)', printf('Expected 48,187 rows, got %d', count(*)) FROM ev
    UNION ALL SELECT 'dim_date', date_diff('day', min(date_time)::DATE, max(date_time)::DATE) + 1, 10, 0, 'PASSED', 'Valid Schema & Content' FROM ev
    UNION ALL SELECT 'dim_time', 23, 4, 0, 'FAILED (Invalid Time Grain)', 'Expected 24 hours, got 23')
    SELECT *, false AS all_passed FROM v""",
)
def _(spark, folder):
    """One table for every rule that a table can break, beside two good ones."""
    df = events(spark, folder)
    tables = {
        "traffic_hourly": star.traffic_hourly(df, EVENTS),
        "traffic_daily": star.traffic_daily(df),
        "traffic_monthly": star.traffic_monthly(df).filter("false"),
        "demand_forecast": df.select("obs_id"),
        "business_kpis": datasets.find_dataset(spark, "business_kpis", scratch_path(spark, "nothing")),
        "error_analysis": df.select("obs_id"),
        "dim_date": star.dim_date(df),
        "dim_time": star.dim_time(spark, EVENTS).filter("hour < 23"),
    }
    return quality.validate_layer(
        tables,
        {"error_analysis": 48187},
        {"traffic_hourly": ("traffic_volume", 3259.82, 1.0)},
        {"traffic_daily": ["total_traffic_volume"], "demand_forecast": ["ml_rf_forecast_pred"]},
        {"dim_time": 24},
    )


@query(
    "raw_csv_split", "S1 P1 M1 M2 O4", "split:s row_count:i window_start:t window_end:t sampled:i",
    """WITH n AS (SELECT o_orderdate AS date_time, row_number() OVER (ORDER BY o_orderdate) - 1 AS rn, count(*) OVER () AS n_all FROM orders)
    SELECT CASE WHEN rn < floor(n_all * 0.85::DOUBLE) THEN 'train' ELSE 'test' END AS split, count(*) AS row_count,
      min(date_time) AS window_start, max(date_time) AS window_end, 100 AS sampled FROM n GROUP BY 1""",
)
def _(spark, folder):
    """Orders written without their key: many rows per time, told apart by their own columns. Both
    splits and samples of two partitionings of the rows are the same."""
    path = scratch_path(spark, "raw-csv")
    rows = orders(spark, folder).select(
        F.date_format("date_time", "dd-MM-yyyy HH:mm").alias("date_time"), "traffic_volume", "weather_main", "custkey"
    )
    obs.write_csv(rows, path)
    raw = obs.read_csv(spark, path, "date_time string, traffic_volume double, weather_main string, custkey bigint")
    df = obs.prepare(raw, ORDERS)
    samples = [selection.fixed_sample(part, 100, ["obs_id"]).select("obs_id") for part in (df, df.repartition(7))]
    same = samples[0].join(samples[1], "obs_id").agg(F.count("*")).scalar()
    return modeling.split_summary(df, ORDERS).withColumn("sampled", same)


@query(
    "raw_csv_lags", "S1 W4 W6", "date_time:t traffic_volume:d lag_1h:d lag_24h:d rolling_mean_24h:d",
    """WITH e AS (SELECT date_trunc('second', ts) AS date_time, round(value, 2) AS traffic_volume FROM events),
    u AS (SELECT date_time, min(traffic_volume) AS traffic_volume FROM e GROUP BY 1)
    SELECT date_time, traffic_volume, lag(traffic_volume, 1) OVER o AS lag_1h, lag(traffic_volume, 24) OVER o AS lag_24h,
      CASE WHEN count(*) OVER p = 24 THEN avg(traffic_volume) OVER p END AS rolling_mean_24h FROM u
      WINDOW o AS (ORDER BY date_time), p AS (ORDER BY date_time ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""",
)
def _(spark, folder):
    """Events of one second merged and written without their key, read back with an identity of their own."""
    path = scratch_path(spark, "raw-csv")
    second = F.date_trunc("second", F.col("date_time")).cast("timestamp_ntz")
    rows = events(spark, folder).groupBy(second.alias("date_time")).agg(F.min(F.round("traffic_volume", 2)).alias("traffic_volume"))
    obs.write_csv(rows.withColumn("date_time", F.date_format("date_time", "dd-MM-yyyy HH:mm:ss")), path)
    df = obs.prepare(obs.read_csv(spark, path, "date_time string, traffic_volume double"), EVENTS)
    return windows.forecasting_features(df, drop_incomplete=False)


@query(
    "csv_round_trip", "S1 S2 S6 P1", "hour:i record_count:i total:m",
    ORD + "SELECT hour, count(*) AS record_count, sum(traffic_volume) AS total FROM od GROUP BY 1",
)
def _(spark, folder):
    """Orders written as headered CSV with day-first times, read with a declared schema."""
    path = scratch_path(spark, "csv")
    rows = orders(spark, folder).select(
        F.date_format("date_time", "dd-MM-yyyy HH:mm").alias("date_time"), "obs_id", "traffic_volume"
    )
    obs.write_csv(rows, path)
    raw = obs.read_csv(spark, path, "date_time string, obs_id bigint, traffic_volume double")
    obs.require_columns(raw, ["date_time", "traffic_volume"], "observations")
    return obs.prepare(raw, ORDERS).groupBy("hour").agg(
        F.count("*").alias("record_count"), F.sum("traffic_volume").alias("total")
    )


@query(
    "published_tables", "S3 S4 S5 X2 X3", "table_name:s n:i reads:i",
    HR + """, f AS (SELECT *, row_number() OVER (ORDER BY date_time) - 1 AS rn, count(*) OVER () AS n_all FROM hr),
    late AS (SELECT * FROM f WHERE rn >= floor(n_all * 0.85::DOUBLE)),
    s AS (SELECT count(DISTINCT hour) + count(DISTINCT weekday) + count(DISTINCT is_rush)
            + count(DISTINCT CASE WHEN traffic_volume <= 20 THEN 0 WHEN traffic_volume <= 100 THEN 1 ELSE 2 END) AS n FROM late),
    r AS (SELECT 'traffic_hourly' AS table_name, count(*) AS n FROM hr UNION ALL
      SELECT 'traffic_daily', count(DISTINCT date_time::DATE) FROM hr UNION ALL
      SELECT 'traffic_monthly', count(DISTINCT date_trunc('month', date_time)) FROM hr UNION ALL
      SELECT 'demand_forecast', (count(*) - 24) - CAST(floor((count(*) - 24) * 0.85::DOUBLE) AS BIGINT) FROM hr UNION ALL
      SELECT 'model_performance', 3 UNION ALL SELECT 'error_analysis', n FROM s UNION ALL SELECT 'business_kpis', 24 UNION ALL
      SELECT 'monitoring_metrics', 6 UNION ALL SELECT 'dim_date', date_diff('day', min(date_time)::DATE, max(date_time)::DATE) + 1 FROM hr UNION ALL
      SELECT 'dim_time', 24)
    SELECT *, 10 AS reads FROM r""",
)
def _(spark, folder):
    """All ten data sets published to a folder and loaded by name with their checks; a second load
    of each shares the first one's read. Forests are compared by queries of their own."""
    path = scratch_path(spark, "published")
    reports.export_star(hourly(spark, folder), path, settings=EVENTS)
    shelf = datasets.Shelf(spark, path)
    loaded = None
    for name in datasets.REQUIRED_COLUMNS:
        shelf.get(name)
        part = shelf.get(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        loaded = part if loaded is None else loaded.unionByName(part)
    return loaded.withColumn("reads", F.lit(shelf.reads))


def _event_stream(spark, folder):
    schema = obs.table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


@query(
    "streamed_hourly_volume", "R1", "date_time:t traffic_volume:i",
    """SELECT date_trunc('hour', ts) AS date_time, count(*) AS traffic_volume FROM events GROUP BY 1
       HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""",
)
def _(spark, folder):
    """All closed hours once the available input is drained."""
    out, state = scratch_path(spark, "hourly"), scratch_path(spark, "hourly-state")
    stream = jobs.hourly_volume(_event_stream(spark, folder))
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


# Events arrive in three steps by time; those of one type are a step late.
LATE_TYPE, STEPS = "error", 3


@query(
    "streamed_hourly_volume_with_late_rows", "R1", "date_time:t traffic_volume:i",
    f"""WITH bounds AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
    e AS (SELECT ts, least(CAST(floor(epoch_us(ts - lo) * {STEPS} / epoch_us(hi - lo)::DOUBLE) AS INTEGER), {STEPS - 1})
              + CASE WHEN event_type = '{LATE_TYPE}' THEN 1 ELSE 0 END AS step FROM events, bounds),
    marks AS (SELECT step, max(max(ts)) OVER (ORDER BY step) - INTERVAL 2 HOUR AS mark FROM e GROUP BY step),
    kept AS (SELECT ts FROM e LEFT JOIN marks ON marks.step = e.step - 1
             WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark)
    SELECT date_trunc('hour', ts) AS date_time, count(*) AS traffic_volume FROM kept GROUP BY 1
    HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(mark) FROM marks)""",
)
def _(spark, folder):
    """The event table replayed in steps, with stragglers: rows behind the watermark of the step before are left out."""
    rows = obs.table(spark, folder, "events").select("ts", "event_type")
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    since = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(low).cast("timestamp"))
    width = F.unix_micros(F.lit(high).cast("timestamp")) - F.unix_micros(F.lit(low).cast("timestamp"))
    slice_ = F.least(F.floor(since * STEPS / width.cast("double")), F.lit(STEPS - 1))
    step = (slice_ + F.when(F.col("event_type") == LATE_TYPE, 1).otherwise(0)).cast("int")
    source, out, state = (scratch_path(spark, n) for n in ("replayed", "hourly", "hourly-state"))
    arrived = rows.select("ts", step.alias("step"))

    def drain():
        stream = jobs.hourly_volume(spark.readStream.schema(arrived.drop("step").schema).parquet(source))
        writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
        writer.trigger(availableNow=True).start(out).awaitTermination()

    jobs.replay(arrived, "step", range(STEPS + 1), source, drain)
    return spark.read.parquet(out)


@query(
    "streamed_monitoring", "R2 S11 D5 D6", "batch_id:i samples:i mae:d rmse:d alert_triggered:b",
    EV_SPLIT + LINE_SQL.format(train="train") + """, s AS (SELECT traffic_volume - (a + b * hour) AS e FROM ev, line)
      SELECT 0 AS batch_id, count(*) AS samples, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, sqrt(avg(e * e)) > 45 AS alert_triggered FROM s""",
)
def _(spark, folder):
    """The event stream scored batch by batch; log and metrics are tables."""
    train, _ = modeling.chronological_split(events(spark, folder), EVENTS)
    model = modeling.fit(train, modeling.linear_regression(), ["hour"])
    log, metrics = scratch_path(spark, "stream-log"), scratch_path(spark, "stream-metrics")
    stream = _event_stream(spark, folder).select(
        F.col("ts").alias("date_time"), F.col("value").alias("traffic_volume")
    )
    handler = jobs.monitor_batch(model, log, metrics, settings=EVENTS)
    writer = jobs.start_monitoring(stream, handler, scratch_path(spark, "stream-state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(metrics)


