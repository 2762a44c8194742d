"""Views, grouped summaries, profiles, sorts and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import WEEKDAY_NAMES
from tidemark.functions import calendar, labels
from tidemark.operators import aggregates, quality, selection, windows
from tidemark.plans import views
from tidemark.sources import observations as obs
from tidemark.workload.inputs import EV, EVENTS, HR, ORD, ORDERS, events, hourly, orders
from tidemark.workload.registry import query

STATS = "record_count:i avg_traffic_volume:d min_traffic_volume:d max_traffic_volume:d"
STATS_SQL = (
    "count(*) AS record_count, avg(traffic_volume) AS avg_traffic_volume, "
    "min(traffic_volume) AS min_traffic_volume, max(traffic_volume) AS max_traffic_volume"
)


@query(
    "daily_summary", "V1 P4 S7", f"date_val:y total_traffic_volume:m {STATS}",
    EV + f"SELECT date_time::DATE AS date_val, sum(traffic_volume) AS total_traffic_volume, {STATS_SQL} FROM ev GROUP BY 1",
)
def _(spark, folder):
    return views.daily_traffic_summary(events(spark, folder), None)


@query("hourly_summary", "V2 P2 P5", f"hour:i {STATS}", EV + f"SELECT hour, {STATS_SQL} FROM ev GROUP BY 1")
def hourly_summary(spark, folder):
    return views.hourly_traffic_summary(events(spark, folder), None)


@query(
    "day_type", "V3 P3 P11", f"day_type:s {STATS}",
    EV + f"SELECT CASE WHEN weekday >= 5 THEN 'Weekend' ELSE 'Weekday' END AS day_type, {STATS_SQL} FROM ev GROUP BY 1",
)
def _(spark, folder):
    return views.day_type_comparison(events(spark, folder), None)


@query(
    "rush_summary", "V4 P12", f"rush_status:s {STATS}",
    EV + f"SELECT CASE WHEN is_rush = 1 THEN 'Rush Hour' ELSE 'Non-Rush Hour' END AS rush_status, {STATS_SQL} FROM ev GROUP BY 1",
)
def _(spark, folder):
    return views.rush_hour_summary(events(spark, folder), None)


@query(
    "monthly_trends", "V5", "month:i record_count:i avg_traffic_volume:d total_traffic_volume:m",
    ORD + "SELECT month, count(*) AS record_count, avg(traffic_volume) AS avg_traffic_volume, sum(traffic_volume) AS total_traffic_volume FROM od GROUP BY 1",
)
def _(spark, folder):
    return views.monthly_traffic_trends(orders(spark, folder), None)


@query(
    "rolling_24", "V6 W1", "date_time:t hour:i weekday:i traffic_volume:d rolling_24h_avg:d",
    EV + """SELECT date_time, hour, weekday, traffic_volume,
      avg(traffic_volume) OVER (ORDER BY date_time, obs_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS rolling_24h_avg FROM ev""",
)
def _(spark, folder):
    return views.rolling_24h_traffic(events(spark, folder), None)


@query(
    "rolling_24_tied_times", "V6 W1", "obs_id:i rolling_24h_avg:d",
    ORD + """SELECT obs_id, avg(traffic_volume) OVER (ORDER BY date_time, obs_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS rolling_24h_avg FROM od""",
)
def _(spark, folder):
    rows = orders(spark, folder).select("obs_id", "date_time", "traffic_volume")
    return windows.rolling_average(rows, digits=None)


PEAK = "date_time:t hour:i weekday:i month:i traffic_volume:d volume_rank:i"


@query(
    "peak_rank", "V7 W2", PEAK,
    EV + "SELECT date_time, hour, weekday, month, traffic_volume, rank() OVER (ORDER BY traffic_volume DESC) AS volume_rank FROM ev",
)
def _(spark, folder):
    return views.peak_traffic_rankings(events(spark, folder))


@query(
    "peak_rank_heavy_ties", "W2", "obs_id:i volume:i volume_rank:i",
    ORD + "SELECT obs_id, month AS volume, rank() OVER (ORDER BY month DESC) AS volume_rank FROM od",
)
def _(spark, folder):
    ranked = windows.volume_rank(orders(spark, folder).withColumn("volume", F.col("month")), "volume")
    return ranked


@query(
    "volume_buckets", "V8 P9 A12", "volume_bucket:s record_count:i percentage:d",
    EV + """SELECT CASE WHEN traffic_volume < 20 THEN 'Low (<20)' WHEN traffic_volume < 100 THEN 'Moderate (20-100)' ELSE 'Heavy (>=100)' END AS volume_bucket,
      count(*) AS record_count, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ev) AS percentage FROM ev GROUP BY 1""",
)
def _(spark, folder):
    return views.traffic_volume_buckets(events(spark, folder), EVENTS, None)


@query(
    "category_impact", "V9", "weather_main:s record_count:i avg_traffic_volume:d avg_temp_kelvin:d avg_rain_mm:d",
    EV + """SELECT weather_main, count(*) AS record_count, avg(traffic_volume) AS avg_traffic_volume,
      avg(temp) AS avg_temp_kelvin, avg(rain_1h) AS avg_rain_mm FROM ev GROUP BY 1""",
)
def _(spark, folder):
    return views.weather_impact_summary(events(spark, folder), None, None)


@query(
    "top10_peaks", "V10 O3", PEAK,
    EV + """SELECT date_time, hour, weekday, month, traffic_volume, rank() OVER (ORDER BY traffic_volume DESC) AS volume_rank
      FROM ev ORDER BY traffic_volume DESC, date_time, obs_id LIMIT 10""",
)
def _(spark, folder):
    return views.top_peaks(events(spark, folder))


@query(
    "view_preview", "V11 S8 S9", f"date_val:y total_traffic_volume:m {STATS}",
    ORD + f"SELECT date_time::DATE AS date_val, sum(traffic_volume) AS total_traffic_volume, {STATS_SQL} FROM od GROUP BY 1 ORDER BY 1 LIMIT 100",
)
def _(spark, folder):
    daily = views.daily_traffic_summary(orders(spark, folder), None)
    return views.preview(daily)


@query(
    "named_view", "S7 S8 S9", "hour:i record_count:i min_traffic_volume:d max_traffic_volume:d",
    EV + f"SELECT hour, {STATS_SQL} FROM ev GROUP BY 1",
)
def _(spark, folder):
    views.register_views(events(spark, folder), EVENTS, ["v_hourly_traffic_summary"])
    return views.named_result(spark, "v_hourly_traffic_summary")


@query(
    "select_statement", "S9", "weather_main:s n:i top:d",
    EV + "SELECT weather_main, count(*) AS n, max(traffic_volume) AS top FROM ev WHERE hour >= 12 GROUP BY 1",
)
def _(spark, folder):
    views.register_views(events(spark, folder), EVENTS, [])
    events(spark, folder).createOrReplaceTempView(views.BASE_TABLE)
    return views.named_result(
        spark,
        f"SELECT weather_main, count(*) AS n, max(traffic_volume) AS top FROM {views.BASE_TABLE} WHERE hour >= 12 GROUP BY 1",
    )


@query(
    "calendar_columns", "P2 P3 P4 P5 P6 P7 P11 P12 P13 P14 P15",
    "obs_id:i hour:i day:i month:i weekday:i is_rush:i year:i date:y month_name:s weekday_name:s is_weekday:i "
    "day_type:s rush_status:s period:s label:s year_month:s iso:s",
    ORD.replace("o_orderdate AS date_time", "o_orderdate + INTERVAL (o_orderkey % 24) HOUR AS date_time")
    + """SELECT obs_id, hour, day, month, weekday, is_rush, year(date_time) AS year, date_time::DATE AS date,
      strftime(date_time, '%b') AS month_name, dayname(date_time) AS weekday_name, CASE WHEN weekday < 5 THEN 1 ELSE 0 END AS is_weekday,
      CASE WHEN weekday >= 5 THEN 'Weekend' ELSE 'Weekday' END AS day_type,
      CASE WHEN is_rush = 1 THEN 'Rush Hour' ELSE 'Non-Rush Hour' END AS rush_status,
      CASE WHEN hour BETWEEN 7 AND 9 THEN 'Morning Rush' WHEN hour BETWEEN 17 AND 19 THEN 'Evening Rush'
           WHEN hour BETWEEN 10 AND 16 THEN 'Midday Off-Peak' WHEN hour >= 20 THEN 'Late Evening' ELSE 'Overnight Low' END AS period,
      printf('%02d:00', hour) AS label, strftime(date_time, '%Y-%m') AS year_month, strftime(date_time, '%Y-%m-%d %H:%M:%S') AS iso FROM od""",
)
def _(spark, folder):
    shifted = F.col("date_time") + F.make_dt_interval(F.lit(0), (F.col("obs_id") % 24).cast("int"))
    df = orders(spark, folder).withColumn("date_time", shifted)
    df = calendar.with_calendar_names(calendar.with_calendar(df, ORDERS))
    t, hour = F.col("date_time"), F.col("hour")
    return df.withColumns(
        {
            "day_type": calendar.day_type(F.col("weekday")),
            "rush_status": calendar.rush_status(F.col("is_rush")),
            "period": calendar.time_of_day_period(hour),
            "label": calendar.time_label(hour),
            "year_month": calendar.year_month(t),
            "iso": calendar.iso_text(t),
        }
    )


@query(
    "day_first_times", "P1 P15", "obs_id:i iso:s",
    "SELECT o_orderkey AS obs_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS iso FROM orders",
)
def _(spark, folder):
    """Times written in several spellings, read back by the day-first parser."""
    t = F.col("o_orderdate")
    spelled = (
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format(t, "dd-MM-yyyy HH:mm"))
        .when(F.col("o_orderkey") % 3 == 1, F.date_format(t, "dd/MM/yyyy HH:mm:ss"))
        .otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
    )
    text = obs.table(spark, folder, "orders").select(F.col("o_orderkey").alias("obs_id"), spelled.alias("raw"))
    return text.withColumn("iso", calendar.iso_text(calendar.parse_time(F.col("raw"))))


@query(
    "row_labels", "P8 P9 P10 P18", "obs_id:i temp_celsius:d bucket:s cut_bucket:s flow:s",
    EV + """SELECT obs_id, round(temp - 273.15::DOUBLE, 2) AS temp_celsius,
      CASE WHEN traffic_volume < 20 THEN 'Low (<20)' WHEN traffic_volume < 100 THEN 'Moderate (20-100)' ELSE 'Heavy (>=100)' END AS bucket,
      CASE WHEN traffic_volume <= -1 THEN NULL WHEN traffic_volume <= 20 THEN 'Low (<20)' WHEN traffic_volume <= 100 THEN 'Moderate (20-100)'
           WHEN traffic_volume <= 10000 THEN 'Heavy (>=100)' END AS cut_bucket,
      CASE WHEN traffic_volume < 20 THEN 'Smooth Traffic Flow' WHEN traffic_volume < 100 THEN 'Moderate Traffic' ELSE 'Heavy Traffic' END AS flow FROM ev""",
)
def _(spark, folder):
    v = F.col("traffic_volume")
    return events(spark, folder).withColumns(
        {
            "temp_celsius": calendar.celsius(F.col("temp")),
            "bucket": labels.volume_bucket(v, EVENTS),
            "cut_bucket": labels.volume_bucket_right_closed(v, EVENTS),
            "flow": labels.flow_class(v, EVENTS),
        }
    )


@query(
    "sliced_summary", "P21", f"weekday:i {STATS}",
    EV + f"""SELECT weekday, {STATS_SQL} FROM ev WHERE date_time::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
      AND is_rush = 1 AND weekday < 5 AND weather_main IN ('click', 'view') AND year(date_time) = 2024 AND hour <= 18 GROUP BY 1""",
)
def _(spark, folder):
    sliced = selection.slice_observations(
        events(spark, folder), "2024-01-05", "2024-01-20", rush=True, weekday=True,
        years=[2024], categories=["click", "view"], hours=range(19),
    )
    return aggregates.volume_summary(sliced, {"weekday": F.col("weekday")}, views.MEASURES, None)


@query(
    "pattern_filter", "P22", "weather_main:s n:i",
    ORD + "SELECT weather_main, count(*) AS n FROM od WHERE regexp_matches(weather_main, '(?i)high|urgent') GROUP BY 1",
)
def _(spark, folder):
    return (
        selection.matching(orders(spark, folder), "weather_main", "high|urgent")
        .groupBy("weather_main")
        .agg(F.count("*").alias("n"))
    )


@query(
    "range_violations", "P25", "hour:i month:i day:i",
    ORD + "SELECT count(*) FILTER (hour NOT BETWEEN 0 AND 23) AS hour, count(*) FILTER (month NOT BETWEEN 1 AND 6) AS month, count(*) FILTER (day NOT BETWEEN 1 AND 28) AS day FROM od",
)
def _(spark, folder):
    return quality.range_violations(orders(spark, folder), {"hour": (0, 23), "month": (1, 6), "day": (1, 28)})


@query(
    "drop_missing", "P26", "n:i total:m",
    EV + "SELECT count(*) AS n, sum(v) AS total FROM (SELECT nullif(weather_main, 'error') AS w, CASE WHEN clouds_all < 90 THEN traffic_volume END AS v FROM ev) WHERE w IS NOT NULL AND v IS NOT NULL",
)
def _(spark, folder):
    holes = events(spark, folder).select(
        F.nullif(F.col("weather_main"), F.lit("error")).alias("w"),
        F.when(F.col("clouds_all") < 90, F.col("traffic_volume")).alias("v"),
    )
    return selection.drop_missing(holes, ["w", "v"]).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(
    "table_overview", "Q1", "row_count:i position:i column_name:s",
    """SELECT (SELECT count(*) FROM orders) AS row_count, unnest(range(6)) AS position,
       unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS column_name""",
)
def _(spark, folder):
    return quality.overview(obs.table(spark, folder, "orders"))


@query(
    "table_head", "Q1 O3", "obs_id:i date_time:t traffic_volume:d",
    EV + "SELECT obs_id, date_time, traffic_volume FROM ev ORDER BY date_time, obs_id LIMIT 5",
)
def _(spark, folder):
    return quality.head(events(spark, folder), ["date_time", "obs_id"])


def _describe_sql(columns: list[str]) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, "
        f"quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q3, max({c})::DOUBLE AS max FROM ev"
        for c in columns
    ]
    return EV + " UNION ALL ".join(parts)


DESCRIBED = ["traffic_volume", "temp", "rain_1h", "clouds_all", "hour"]


@query(
    "describe_columns", "Q2", "column_name:s count:i mean:d std:d min:d q1:d median:d q3:d max:d",
    _describe_sql(DESCRIBED),
)
def _(spark, folder):
    return quality.describe(events(spark, folder), DESCRIBED)


@query(
    "null_profile", "Q3", "column_name:s missing_count:i missing_pct:d",
    EV + """, holes AS (SELECT nullif(weather_main, 'error') AS category, CASE WHEN clouds_all < 90 THEN traffic_volume END AS volume, hour FROM ev)
    SELECT 'category' AS column_name, count(*) FILTER (category IS NULL) AS missing_count, count(*) FILTER (category IS NULL) * 100.0::DOUBLE / count(*) AS missing_pct FROM holes
    UNION ALL SELECT 'volume', count(*) FILTER (volume IS NULL), count(*) FILTER (volume IS NULL) * 100.0::DOUBLE / count(*) FROM holes
    UNION ALL SELECT 'hour', count(*) FILTER (hour IS NULL), count(*) FILTER (hour IS NULL) * 100.0::DOUBLE / count(*) FROM holes""",
)
def _(spark, folder):
    return quality.null_profile(
        events(spark, folder).select(
            F.nullif(F.col("weather_main"), F.lit("error")).alias("category"),
            F.when(F.col("clouds_all") < 90, F.col("traffic_volume")).alias("volume"),
            "hour",
        )
    )


@query(
    "duplicate_count", "Q4", "row_count:i duplicate_count:i duplicate_pct:d",
    EV + """SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT weather_main, hour, rain_1h FROM ev)) AS duplicate_count,
      (count(*) - (SELECT count(*) FROM (SELECT DISTINCT weather_main, hour, rain_1h FROM ev))) * 100.0::DOUBLE / count(*) AS duplicate_pct FROM ev""",
)
def _(spark, folder):
    return quality.duplicate_profile(events(spark, folder).select("weather_main", "hour", "rain_1h"))


@query(
    "distinct_rows", "Q5", "weather_main:s hour:i rain_1h:d",
    EV + "SELECT DISTINCT weather_main, hour, rain_1h FROM ev",
)
def _(spark, folder):
    return quality.deduplicate(events(spark, folder).select("weather_main", "hour", "rain_1h"))


@query(
    "time_range", "Q6", "earliest:t latest:t",
    EV + "SELECT min(date_time) AS earliest, max(date_time) AS latest FROM ev",
)
def _(spark, folder):
    return quality.time_range(events(spark, folder))


@query(
    "negative_count", "Q7", "negative_count:i",
    "SELECT count(*) AS negative_count FROM customer WHERE c_acctbal < 0",
)
def _(spark, folder):
    return quality.negative_count(obs.table(spark, folder, "customer"), "c_acctbal")


@query(
    "iqr_outliers", "Q8", "q1:d q3:d iqr:d lower_bound:d upper_bound:d outliers_below:i outliers_above:i outliers_total:i outliers_pct:d",
    EV + """, b AS (SELECT quantile_cont(traffic_volume, 0.25) AS q1, quantile_cont(traffic_volume, 0.75) AS q3 FROM ev)
    SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5::DOUBLE * (q3 - q1) AS lower_bound, q3 + 1.5::DOUBLE * (q3 - q1) AS upper_bound,
      (SELECT count(*) FROM ev WHERE traffic_volume < q1 - 1.5::DOUBLE * (q3 - q1)) AS outliers_below,
      (SELECT count(*) FROM ev WHERE traffic_volume > q3 + 1.5::DOUBLE * (q3 - q1)) AS outliers_above,
      (SELECT count(*) FROM ev WHERE NOT traffic_volume BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)) AS outliers_total,
      (SELECT avg(CASE WHEN traffic_volume BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) THEN 0 ELSE 100 END) FROM ev) AS outliers_pct FROM b""",
)
def _(spark, folder):
    return quality.iqr_outliers(events(spark, folder))


@query(
    "daily_fact", "A1 X2", "date:y year:i month:i month_name:s day:i weekday:i weekday_name:s is_weekday:i total_traffic_volume:m avg_traffic_volume:d min_traffic_volume:d max_traffic_volume:d record_count:i",
    ORD + """SELECT date_time::DATE AS date, year(date) AS year, month(date) AS month, strftime(date, '%b') AS month_name, day(date) AS day,
      isodow(date) - 1 AS weekday, dayname(date) AS weekday_name, CASE WHEN isodow(date) < 6 THEN 1 ELSE 0 END AS is_weekday,
      sum(traffic_volume) AS total_traffic_volume, avg(traffic_volume) AS avg_traffic_volume, min(traffic_volume) AS min_traffic_volume,
      max(traffic_volume) AS max_traffic_volume, count(traffic_volume) AS record_count FROM od GROUP BY date_time::DATE""",
)
def _(spark, folder):
    return aggregates.daily_fact(orders(spark, folder), None)


@query(
    "monthly_fact", "A2 X3 P14", "year:i month:i year_month:s month_name:s avg_traffic_volume:d total_traffic_volume:m peak_hourly_volume:d record_count:i",
    ORD + """SELECT year(date_time) AS year, month(date_time) AS month, strftime(min(date_time), '%Y-%m') AS year_month, strftime(min(date_time), '%b') AS month_name,
      avg(traffic_volume) AS avg_traffic_volume, sum(traffic_volume) AS total_traffic_volume, max(traffic_volume) AS peak_hourly_volume, count(*) AS record_count
      FROM od GROUP BY 1, 2""",
)
def _(spark, folder):
    return aggregates.monthly_fact(orders(spark, folder), None)


@query(
    "diurnal_profile", "A3", "hour:i day_type:s avg_traffic_volume:d",
    EV + "SELECT hour, CASE WHEN weekday >= 5 THEN 'Weekend' ELSE 'Weekday' END AS day_type, avg(traffic_volume) AS avg_traffic_volume FROM ev GROUP BY 1, 2",
)
def _(spark, folder):
    return aggregates.diurnal_profile(events(spark, folder))


@query(
    "weekday_means", "A4", "weekday:i weekday_name:s avg_traffic_volume:d",
    EV + """SELECT w AS weekday, ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][w + 1] AS weekday_name,
      (SELECT avg(traffic_volume) FROM ev WHERE weekday = w) AS avg_traffic_volume FROM range(7) AS r(w)""",
)
def _(spark, folder):
    return aggregates.weekday_means(events(spark, folder))


@query(
    "hour_weekday_pivot", "A5", "hour:i " + " ".join(f"{d}:d" for d in WEEKDAY_NAMES),
    EV + "SELECT hour, " + ", ".join(f"avg(traffic_volume) FILTER (weekday = {i}) AS {d}" for i, d in enumerate(WEEKDAY_NAMES)) + " FROM ev GROUP BY 1",
)
def _(spark, folder):
    return aggregates.hour_weekday_pivot(events(spark, folder))


@query(
    "bucket_mix", "A6", "volume_bucket:s count:i",
    EV + "SELECT CASE WHEN traffic_volume < 20 THEN 'Low (<20)' WHEN traffic_volume < 100 THEN 'Moderate (20-99)' ELSE 'Heavy (>=100)' END AS volume_bucket, count(*) AS count FROM ev GROUP BY 1",
)
def _(spark, folder):
    return aggregates.bucket_mix(events(spark, folder), EVENTS)


@query(
    "calendar_means", "A7", "dimension:s value:i avg_traffic_volume:d",
    ORD + "SELECT 'hour' AS dimension, hour AS value, avg(traffic_volume) AS avg_traffic_volume FROM od GROUP BY 2 UNION ALL SELECT 'weekday', weekday, avg(traffic_volume) FROM od GROUP BY 2 UNION ALL SELECT 'month', month, avg(traffic_volume) FROM od GROUP BY 2",
)
def _(spark, folder):
    return aggregates.calendar_means(orders(spark, folder))


def _box_sql(by: str) -> str:
    return EV + f"""SELECT {by} g, count(*) AS n, min(q1) AS q1, min(median) AS median, min(q3) AS q3,
      min(traffic_volume) FILTER (traffic_volume >= q1 - 1.5::DOUBLE * (q3 - q1)) AS whisker_low,
      max(traffic_volume) FILTER (traffic_volume <= q3 + 1.5::DOUBLE * (q3 - q1)) AS whisker_high
      FROM (SELECT *, quantile_cont(traffic_volume, 0.25) OVER (PARTITION BY {by}) AS q1,
              quantile_cont(traffic_volume, 0.5) OVER (PARTITION BY {by}) AS median,
              quantile_cont(traffic_volume, 0.75) OVER (PARTITION BY {by}) AS q3 FROM ev) GROUP BY 1"""


BOX = "n:i q1:d median:d q3:d whisker_low:d whisker_high:d"


@query("box_by_rush", "A8", f"is_rush:i {BOX}", _box_sql("is_rush").replace(" g,", " AS is_rush,"))
def _(spark, folder):
    return aggregates.box_summary(events(spark, folder), ["is_rush"])


@query("box_overall", "A8", BOX, _box_sql("1"))
def _(spark, folder):
    return aggregates.box_summary(events(spark, folder))


@query(
    "histogram", "A9", "bin:i bin_start:d bin_end:d count:i",
    EV + """, m AS (SELECT min(traffic_volume) AS lo, (max(traffic_volume) - min(traffic_volume)) / 50 AS w FROM ev),
    c AS (SELECT least(floor((traffic_volume - lo) / w), 49)::INTEGER AS bin, count(*) AS n FROM ev, m GROUP BY 1)
    SELECT b AS bin, b * w + lo AS bin_start, (b + 1) * w + lo AS bin_end, coalesce(n, 0) AS count FROM range(50) AS r(b) CROSS JOIN m LEFT JOIN c ON c.bin = b""",
)
def _(spark, folder):
    return aggregates.histogram(events(spark, folder))


@query(
    "kde", "A10", "point:i x:d density:d",
    EV + """, s AS (SELECT min(traffic_volume) AS lo, max(traffic_volume) AS hi, count(*) AS n, stddev_samp(traffic_volume) * pow(count(*), -0.2::DOUBLE) AS h FROM ev)
    SELECT p AS point, lo + p * (hi - lo) / 199 AS x,
      sum(exp(-0.5::DOUBLE * pow((lo + p * (hi - lo) / 199 - traffic_volume) / h, 2))) / (n * h * sqrt(2 * pi())) AS density
    FROM range(200) AS r(p) CROSS JOIN s CROSS JOIN ev GROUP BY p, lo, hi, n, h""",
)
def _(spark, folder):
    return aggregates.density(events(spark, folder))


SHIFT = "rush_mean:d non_rush_mean:d weekday_mean:d weekend_mean:d rush_diff:d rush_pct_shift:d weekday_diff:d weekday_pct_shift:d"
SHIFT_SQL = """avg(traffic_volume) FILTER (is_rush = 1) AS rush_mean, avg(traffic_volume) FILTER (is_rush = 0) AS non_rush_mean,
      avg(traffic_volume) FILTER (weekday < 5) AS weekday_mean, avg(traffic_volume) FILTER (weekday >= 5) AS weekend_mean,
      rush_mean - non_rush_mean AS rush_diff, (rush_mean - non_rush_mean) / non_rush_mean * 100 AS rush_pct_shift,
      weekday_mean - weekend_mean AS weekday_diff, (weekday_mean - weekend_mean) / weekend_mean * 100 AS weekday_pct_shift"""


@query("conditional_shift", "A11", SHIFT, EV + f"SELECT {SHIFT_SQL} FROM ev")
def _(spark, folder):
    return aggregates.conditional_shift(events(spark, folder), EVENTS)


@query(
    "share_of_total", "J2", "weather_main:s record_count:i percentage:d",
    ORD + "SELECT weather_main, count(*) AS record_count, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM od) AS percentage FROM od GROUP BY 1",
)
def _(spark, folder):
    return aggregates.share_of_total(orders(spark, folder), "weather_main")


@query(
    "chronological_rows", "O1", "obs_id:i date_time:t traffic_volume:d",
    ORD + "SELECT obs_id, date_time, traffic_volume FROM od ORDER BY date_time, obs_id",
)
def _(spark, folder):
    return selection.chronological(orders(spark, folder))


@query(
    "top_hours", "O2", "hour:i mean_value:d",
    EV + "SELECT hour, avg(traffic_volume) AS mean_value FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
)
def _(spark, folder):
    return selection.top_groups_by_mean(events(spark, folder), "hour")


@query(
    "first_week", "O3", "date_time:t traffic_volume:d",
    HR + "SELECT date_time, traffic_volume FROM hr ORDER BY date_time LIMIT 168",
)
def _(spark, folder):
    return selection.first_rows(hourly(spark, folder), 168, ["date_time"])


@query(
    "seeded_sample", "O4", "obs_id:i date_time:t traffic_volume:d",
    EV + "SELECT obs_id, date_time, traffic_volume FROM ev ORDER BY md5(concat_ws(':', obs_id::VARCHAR, '42')), obs_id LIMIT 1000",
)
def _(spark, folder):
    return selection.fixed_sample(events(spark, folder), 1000, ["obs_id"], 42)


@query(
    "by_magnitude", "O5", "hour:i shift:d",
    EV + """, m AS (SELECT hour, avg(traffic_volume) - (SELECT avg(traffic_volume) FROM ev) AS shift FROM ev GROUP BY 1)
    SELECT hour, shift FROM m ORDER BY abs(shift) DESC, hour""",
)
def _(spark, folder):
    df = events(spark, folder)
    overall = df.agg(F.avg("traffic_volume")).scalar()
    means = df.groupBy("hour").agg(F.avg("traffic_volume").alias("m"))
    return selection.by_magnitude(means.select("hour", (F.col("m") - overall).alias("shift")), "shift", "hour")


@query(
    "top_k_per_year", "W3", "year:i obs_id:i traffic_volume:d volume_rank:i",
    ORD + """SELECT year, obs_id, traffic_volume, volume_rank FROM (SELECT year(date_time) AS year, obs_id, traffic_volume,
      dense_rank() OVER (PARTITION BY year(date_time) ORDER BY traffic_volume DESC) AS volume_rank FROM od) WHERE volume_rank <= 5""",
)
def _(spark, folder):
    return selection.top_k_per_year(orders(spark, folder), 5)
