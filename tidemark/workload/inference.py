"""Windows, statistics and hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import statistics, windows
from tidemark.session import materialize
from tidemark.workload.inputs import EV, EV_FEATURES, HR, ORD, events, hourly, orders, series
from tidemark.workload.registry import query

LAGS = "obs_id:i lag_1h:d lag_24h:d"


@query("lags", "W4", LAGS, EV_FEATURES + "SELECT obs_id, lag_1h, lag_24h FROM features")
def _(spark, folder):
    return windows.lag_features(series(spark, folder))


@query("lag_168", "W5", "obs_id:i lag_168h:d", EV_FEATURES + "SELECT obs_id, lag_168h FROM features")
def _(spark, folder):
    return windows.lag_features(series(spark, folder), [168])


@query(
    "rolling_mean_std", "W6 W7", "obs_id:i rolling_mean_24h:d rolling_std_24h:d",
    EV_FEATURES + "SELECT obs_id, rolling_mean_24h, rolling_std_24h FROM features",
)
def _(spark, folder):
    return windows.forecasting_features(series(spark, folder), drop_incomplete=False)


@query("ewma", "W8", "obs_id:i ewma_24h:d", EV_FEATURES + "SELECT obs_id, ewma_24h FROM features")
def _(spark, folder):
    return windows.forecasting_features(series(spark, folder), drop_incomplete=False)


@query(
    "forecasting_features", "W4 W6 W7 W8 P26",
    "obs_id:i traffic_volume:d hour:i lag_1h:d lag_24h:d rolling_mean_24h:d rolling_std_24h:d ewma_24h:d",
    EV_FEATURES + "SELECT * FROM features WHERE lag_24h IS NOT NULL AND rolling_mean_24h IS NOT NULL",
)
def _(spark, folder):
    return windows.forecasting_features(series(spark, folder))


@query(
    "lags_by_category", "W4 W6", "obs_id:i lag_1h:d lag_24h:d rolling_mean_24h:d",
    EV + """SELECT obs_id, lag(traffic_volume, 1) OVER o AS lag_1h, lag(traffic_volume, 24) OVER o AS lag_24h,
      CASE WHEN count(*) OVER p = 24 THEN avg(traffic_volume) OVER p END AS rolling_mean_24h FROM ev
      WINDOW o AS (PARTITION BY weather_main ORDER BY date_time, obs_id),
             p AS (PARTITION BY weather_main ORDER BY date_time, obs_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""",
)
def _(spark, folder):
    return windows.forecasting_features(
        events(spark, folder).select("obs_id", "date_time", "traffic_volume", "weather_main"),
        series=["weather_main"],
        drop_incomplete=False,
    )


@query(
    "time_features", "W9", "date_time:t traffic_volume:d rolling_24h_avg:d lag_1h:d lag_24h:d rolling_mean_24h:d rolling_std_24h:d",
    EV + """, h AS (SELECT date_trunc('hour', date_time) AS date_time, avg(traffic_volume) AS traffic_volume FROM ev GROUP BY 1)
    SELECT date_time, traffic_volume,
      avg(traffic_volume) OVER (ORDER BY date_time RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW) AS rolling_24h_avg,
      max(traffic_volume) OVER (ORDER BY date_time RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS lag_1h,
      max(traffic_volume) OVER (ORDER BY date_time RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 24 HOUR PRECEDING) AS lag_24h,
      avg(traffic_volume) OVER w AS rolling_mean_24h, stddev_samp(traffic_volume) OVER w AS rolling_std_24h FROM h
      WINDOW w AS (ORDER BY date_time RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)""",
)
def _(spark, folder):
    return windows.time_features(events(spark, folder))


@query(
    "descriptive", "T1", "n:i mean:d std_dev:d median:d min:d max:d q1:d q3:d iqr:d skewness:d kurtosis:d",
    EV + """SELECT count(*) AS n, avg(traffic_volume) AS mean, stddev_samp(traffic_volume) AS std_dev, median(traffic_volume) AS median,
      min(traffic_volume) AS min, max(traffic_volume) AS max, quantile_cont(traffic_volume, 0.25) AS q1, quantile_cont(traffic_volume, 0.75) AS q3,
      q3 - q1 AS iqr, skewness(traffic_volume) AS skewness, kurtosis(traffic_volume) AS kurtosis FROM ev""",
)
def _(spark, folder):
    return statistics.descriptive(events(spark, folder), digits=None)


# Intervals need t quantiles, which SQL lacks; at these sample sizes the oracle inverts the t tail
# by its Cornish-Fisher expansion around the normal quantile, good to nine digits.
T975, T995 = "1.959963984540054::DOUBLE", "2.5758293035489004::DOUBLE"


def _t975(df: str) -> str:
    return _t_quantile(df, T975)


def _t_quantile(df: str, z: str) -> str:
    return (
        f"({z} + (pow({z},3) + {z}) / (4 * ({df})) + (5*pow({z},5) + 16*pow({z},3) + 3*{z}) / (96 * pow({df}, 2))"
        f" + (3*pow({z},7) + 19*pow({z},5) + 17*pow({z},3) - 15*{z}) / (384 * pow({df}, 3)))"
    )


def _area_sql(density: str, start: str, length: str) -> str:
    """Simpson's rule over 2,000 steps; ``density`` is a formula of {u}."""
    u = f"(({start}) + i * ({length}) / 2000.0::DOUBLE)"
    weight = "CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"({length}) * list_sum(list_transform(range(0, 2001), lambda i: ({weight}) * {density.format(u=u)}))"


def _t_two_sided_sql(t: str, df: str) -> str:
    """Both tails of t by quadrature: with t = sqrt(df) tan(u / sqrt(df)) the density is cos(u / sqrt(df)) ^ (df - 1)."""
    density, end = f"pow(greatest(cos({{u}} / sqrt({df})), 0), {df} - 1)", f"(pi() / 2 * sqrt({df}))"
    start = f"(sqrt({df}) * atan(abs({t}) / sqrt({df})))"
    tail = _area_sql(density, start, f"least(40 / greatest({start}, 1), {end} - {start})")
    return f"({tail}) / ({_area_sql(density, '0', f'least(40, {end})')})"


def _normal_two_sided_sql(z: str) -> str:
    density = "exp(-{u} * {u} / 2)"
    return f"({_area_sql(density, z, f'40 / greatest({z}, 1)')}) / sqrt(pi() / 2) / 6000"


@query(
    "mean_interval", "T2", "n:i mean:d sem:d ci_low:d ci_high:d",
    EV + f"""SELECT count(*) AS n, avg(traffic_volume) AS mean, stddev_samp(traffic_volume) / sqrt(count(*)) AS sem,
      mean - {_t975("count(*) - 1")} * sem AS ci_low, mean + {_t975("count(*) - 1")} * sem AS ci_high FROM ev""",
)
def _(spark, folder):
    return statistics.mean_confidence(events(spark, folder))


@query(
    "difference_interval", "T3", "group1_ci_low:d group1_ci_high:d group2_ci_low:d group2_ci_high:d diff_ci_low:d diff_ci_high:d",
    EV + f""", g AS (SELECT count(*) FILTER (weekday < 5)::DOUBLE AS n1, avg(traffic_volume) FILTER (weekday < 5) AS m1, var_samp(traffic_volume) FILTER (weekday < 5) AS v1,
       count(*) FILTER (weekday >= 5)::DOUBLE AS n2, avg(traffic_volume) FILTER (weekday >= 5) AS m2, var_samp(traffic_volume) FILTER (weekday >= 5) AS v2 FROM ev),
     w AS (SELECT *, sqrt(v1 / n1 + v2 / n2) AS se, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS f FROM g)
     SELECT m1 - {_t975("n1 - 1")} * sqrt(v1 / n1) AS group1_ci_low, m1 + {_t975("n1 - 1")} * sqrt(v1 / n1) AS group1_ci_high,
       m2 - {_t975("n2 - 1")} * sqrt(v2 / n2) AS group2_ci_low, m2 + {_t975("n2 - 1")} * sqrt(v2 / n2) AS group2_ci_high,
       m1 - m2 - {_t975("f")} * se AS diff_ci_low, m1 - m2 + {_t975("f")} * se AS diff_ci_high FROM w""",
)
def _(spark, folder):
    return statistics.group_mean_confidence(events(spark, folder), F.col("weekday") < 5)


def _uniform_sql(i: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', v::VARCHAR, r::VARCHAR, '42', ({i})::VARCHAR)), 1, 13) AS BIGINT) / {float(1 << 52)!r}::DOUBLE"


# Poisson weights of 1,000 replicates: values met fewer than ten times add up draws of mean one, read off the
# distribution function; the others take the first accepted of 24 tries (the next one fails once in 10^16).
BOOTSTRAP_SQL = f"""
counts AS (SELECT traffic_volume AS v, count(*)::DOUBLE AS n FROM hr GROUP BY 1),
drawn AS (SELECT v, n, r FROM counts, range(1000) AS t(r)),
single AS (SELECT v, n, r, {_uniform_sql('i')} AS u FROM drawn, range(1, 10) AS t(i) WHERE n < 10 AND i <= n),
few AS (SELECT v, r, sum(len(list_filter([{', '.join(f'{s!r}::DOUBLE' for s in statistics.POISSON_STEPS)}], lambda s: s <= u))) AS w FROM single GROUP BY v, r),
tries AS (SELECT v, n, r, i, {_uniform_sql('2 * i')} - 0.5 AS u, {_uniform_sql('2 * i + 1')} AS y, 0.931 + 2.53 * sqrt(n) AS b
  FROM drawn, range(1, 25) AS t(i) WHERE n >= 10),
widths AS (SELECT *, -0.059 + 0.02483 * b AS a, greatest(0.5 - abs(u), 1e-18::DOUBLE) AS edge FROM tries),
spots AS (SELECT *, floor((2 * a / edge + b) * u + n + 0.43) AS k FROM widths),
many AS (SELECT v, r, arg_min(k, i) AS w FROM spots
  WHERE (edge >= 0.07 AND y <= 0.9277 - 3.6224 / (b - 2)) OR (k >= 0 AND NOT (edge < 0.013 AND y > edge)
    AND ln(greatest(y, 1e-300::DOUBLE)) + ln(1.1239 + 1.1328 / (b - 3.4)) - ln(a / (edge * edge) + b) <= k * ln(n) - n - lgamma(greatest(k, 0) + 1))
  GROUP BY v, r),
means AS (SELECT sum(w * v) / sum(w) AS m FROM (SELECT * FROM few UNION ALL SELECT * FROM many) GROUP BY r)"""


@query(
    "bootstrap_ci", "T4 T5", "confidence_level:s n:i mean:d sem:d ci_low:d ci_high:d boot_low:d boot_high:d",
    HR + "," + BOOTSTRAP_SQL + f""" SELECT '95%' AS confidence_level, count(*) AS n, avg(traffic_volume) AS mean, stddev_samp(traffic_volume) / sqrt(count(*)) AS sem,
      mean - {_t975("count(*) - 1")} * sem AS ci_low, mean + {_t975("count(*) - 1")} * sem AS ci_high,
      (SELECT quantile_cont(m, 0.025) FROM means) AS boot_low, (SELECT quantile_cont(m, 0.975) FROM means) AS boot_high FROM hr""",
)
def _(spark, folder):
    return statistics.confidence_report(hourly(spark, folder))


FEATURES = ["temp", "rain_1h", "clouds_all", "hour", "day", "weekday", "is_rush"]


def _ranks(column: str) -> str:
    return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0::DOUBLE"


@query(
    "correlations", "T6 T7 T8 O5", "feature:s n:i pearson_r:d pearson_p:d spearman_r:d spearman_p:d significant:b",
    "SELECT *, " + ", ".join(f"{_t_two_sided_sql(f'(abs({c}_r) * sqrt((n - 2) / (1 - {c}_r * {c}_r)))', '(n - 2)')} AS {c}_p" for c in ("pearson", "spearman")) + " FROM ("
    + EV + f", r AS (SELECT *, {_ranks('traffic_volume')} AS ry, " + ", ".join(f"{_ranks(f)} AS r_{f}" for f in FEATURES) + " FROM ev) "
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS n, corr({f}, traffic_volume) AS pearson_r, corr(r_{f}, ry) AS spearman_r, abs(corr({f}, traffic_volume)) * sqrt((count(*) - 2) / (1 - pow(corr({f}, traffic_volume), 2))) > {_t_quantile('count(*) - 2', T995)} AS significant FROM r" for f in FEATURES) + ")",
)
def _(spark, folder):
    return statistics.correlations(events(spark, folder), FEATURES)


MATRIX = ["traffic_volume", "temp", "rain_1h", "clouds_all", "hour", "day", "weekday", "is_rush"]


@query(
    "correlation_matrix", "T9", "column_a:s column_b:s r:d",
    EV + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM ev" for a in MATRIX for b in MATRIX),
)
def _(spark, folder):
    return statistics.correlation_matrix(events(spark, folder), MATRIX)


def _two_sample_sql(base: str, table: str, condition: str) -> str:
    sigma = "sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))))"
    z = f"((greatest(mann_whitney_u, n1 * n2 - mann_whitney_u) - n1 * n2 / 2 - 0.5::DOUBLE) / {sigma})"
    return f"""SELECT *, {_t_two_sided_sql("sqrt(levene_statistic)", "(n1 + n2 - 2)")} AS levene_p,
      {_t_two_sided_sql("welch_t", "welch_f")} AS welch_p,
      CASE WHEN {z} > 0 THEN least(1, {_normal_two_sided_sql(z)}) ELSE 1 END AS mann_whitney_p
      FROM ({_two_sample_statistics_sql(base, table, condition)})"""


def _two_sample_statistics_sql(base: str, table: str, condition: str) -> str:
    return base + f""", s AS (SELECT traffic_volume AS v, CASE WHEN {condition} THEN 1 ELSE 2 END AS g FROM {table}),
    ranked AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS rk,
                      median(v) OVER (PARTITION BY g) AS med FROM s),
    m AS (SELECT count(*) FILTER (g = 1)::DOUBLE AS n1, count(*) FILTER (g = 2)::DOUBLE AS n2,
       avg(v) FILTER (g = 1) AS m1, avg(v) FILTER (g = 2) AS m2, var_samp(v) FILTER (g = 1) AS v1, var_samp(v) FILTER (g = 2) AS v2,
       max(med) FILTER (g = 1) AS median1, max(med) FILTER (g = 2) AS median2, sum(rk) FILTER (g = 1) AS r1,
       avg(abs(v - med)) FILTER (g = 1) AS z1, avg(abs(v - med)) FILTER (g = 2) AS z2, avg(abs(v - med)) AS z,
       var_pop(abs(v - med)) FILTER (g = 1) AS zv1, var_pop(abs(v - med)) FILTER (g = 2) AS zv2 FROM ranked)
    SELECT n1, n2, (SELECT sum(pow(c, 3) - c) FROM (SELECT count(*)::DOUBLE AS c FROM s GROUP BY v)) AS ties,
       pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS welch_f,
       m1 AS mean1, m2 AS mean2, median1, median2, m1 - m2 AS mean_difference,
       (n1 + n2 - 2) * (n1 * pow(z1 - z, 2) + n2 * pow(z2 - z, 2)) / (n1 * zv1 + n2 * zv2) AS levene_statistic,
       (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS welch_t, r1 - n1 * (n1 + 1) / 2 AS mann_whitney_u,
       (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS cohens_d,
       1 - 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2) AS rank_biserial,
       CASE WHEN abs(welch_t) > {_t975("pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))")} THEN 'Reject H0' ELSE 'Fail to reject H0' END AS conclusion,
       CASE WHEN abs(cohens_d) < 0.2 THEN 'Negligible Effect Size (|d| < 0.2)' WHEN abs(cohens_d) < 0.5 THEN 'Small Effect Size (|d| < 0.5)' WHEN abs(cohens_d) < 0.8 THEN 'Medium Effect Size (|d| < 0.8)' ELSE 'Large Effect Size (|d| >= 0.8)' END AS effect_size FROM m"""


TWO = "n1:i n2:i mean1:d mean2:d median1:d median2:d mean_difference:d levene_statistic:d levene_p:d welch_t:d welch_p:d mann_whitney_u:d mann_whitney_p:d cohens_d:d rank_biserial:d conclusion:s effect_size:s"


@query("weekday_test", "T10 T11 T12 T13 T14 T15", TWO, _two_sample_sql(EV, "ev", "weekday < 5"))
def _(spark, folder):
    return statistics.weekday_test(events(spark, folder))


@query("rush_test", "T10 T11 T12 T13 T14 T16", TWO, _two_sample_sql(HR, "hr", "is_rush = 1"))
def _(spark, folder):
    """Hourly counts: few distinct values, so ties are heavy."""
    return statistics.rush_test(hourly(spark, folder))


@query(
    "rush_test_p_values", "T10 T11 T12 T16", "levene_p:d welch_p:d mann_whitney_p:d effect_size:s conclusion:s",
    _two_sample_sql(HR, "hr", "is_rush = 1"),
)
def _(spark, folder):
    return statistics.rush_test(hourly(spark, folder))


def _category_sql(base: str, table: str) -> str:
    """Both p-values in the closed form of five categories, which events and orders have."""
    return base + f""", k AS (SELECT weather_main AS c, traffic_volume AS v, rank() OVER (ORDER BY traffic_volume) + (count(*) OVER (PARTITION BY traffic_volume) - 1) / 2.0::DOUBLE AS rk FROM {table}),
    g AS (SELECT c, count(*)::DOUBLE AS n, avg(v) AS m, var_samp(v) AS s2, sum(rk) AS r FROM k GROUP BY c),
    a AS (SELECT count(*)::DOUBLE AS k, sum(n) AS n, sum(n * pow(m - (SELECT avg(v) FROM k), 2)) AS b, sum((n - 1) * s2) AS w, sum(r * r / n) AS rr FROM g),
    t AS (SELECT sum(pow(cnt, 3) - cnt) AS ties FROM (SELECT count(*)::DOUBLE AS cnt FROM k GROUP BY v))
    SELECT k AS categories, n, (b / (k - 1)) / (w / (n - k)) AS anova_f,
      (12 / (n * (n + 1)) * rr - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)) AS kruskal_h,
      pow((n - k) / (n - k + 4 * anova_f), (n - k) / 2) * (1 + (n - k) / 2 * 4 * anova_f / (n - k + 4 * anova_f)) AS anova_p,
      exp(-kruskal_h / 2) * (1 + kruskal_h / 2) AS kruskal_p FROM a, t"""


@query("category_test", "T17 T18", "categories:i n:i anova_f:d kruskal_h:d anova_p:d kruskal_p:d", _category_sql(EV, "ev"))
def _(spark, folder):
    return statistics.category_test(events(spark, folder))


@query(
    "category_test_heavy_ties", "T17 T18", "categories:i n:i anova_f:d kruskal_h:d anova_p:d kruskal_p:d",
    _category_sql(ORD.replace("o_totalprice AS traffic_volume", "floor(o_totalprice / 100000) AS traffic_volume"), "od"),
)
def _(spark, folder):
    df = orders(spark, folder).withColumn("traffic_volume", F.floor(F.col("traffic_volume") / 100000))
    return statistics.category_test(df)


