"""Descriptive statistics, intervals, correlations and hypothesis tests.

Row data is only ever aggregated by Spark: into moments, or into counts per distinct value whose
ranks come from distributed running totals. The driver sees one row of sums per report, from which
it takes the final ratios and tail probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import distributions as dist
from tidemark.functions.labels import effect_size
from tidemark.operators.ordering import ROWS_PER_BLOCK, block_cuts, point_block, ranked_values, running_totals, value_counts
from tidemark.operators.quality import require_values
from tidemark.operators.quantiles import QUARTILES, overall_quantiles, pick_quantiles
from tidemark.session import materialize, small_table

TARGET = "traffic_volume"
NAN = float("nan")


def one_row(spark: SparkSession, values: dict) -> DataFrame:
    """A typed one-row result. Whole numbers stay bigint, everything else is double or text."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    schema = ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in values.items())
    return small_table(spark, [tuple(values.values())], schema)


def _ratio(a: float, b: float) -> float:
    return a / b if b else NAN


def bias_corrected_shape(n: Column, skewness: Column, kurtosis: Column) -> tuple[Column, Column]:
    """Sample skewness and excess kurtosis from their population forms; null for too few rows."""
    n = n.cast("double")
    g1 = F.when(n > 2, skewness * F.sqrt(n * (n - 1)) / (n - 2))
    g2 = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurtosis + 6))
    return g1, g2


def descriptive(df: DataFrame, value: str = TARGET, digits: tuple[int, int] | None = (2, 4)) -> DataFrame:
    """Count, mean, sample deviation, median, range, quartiles, IQR, skewness and kurtosis."""
    require_values(df, value)
    v = F.col(value)
    moments = df.agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std_dev"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.skewness(v).alias("_g1"),
        F.kurtosis(v).alias("_g2"),
    )
    marks = overall_quantiles(df, value, QUARTILES)
    skew, kurt = bias_corrected_shape(F.col("n"), F.col("_g1"), F.col("_g2"))

    def rounded(c: Column, place: int) -> Column:
        return c if digits is None else F.round(c, digits[place])

    return moments.select(
        "n",
        rounded(F.col("mean"), 0).alias("mean"),
        rounded(F.col("std_dev"), 0).alias("std_dev"),
        rounded(F.lit(marks["median"]), 0).alias("median"),
        "min",
        "max",
        rounded(F.lit(marks["q1"]), 0).alias("q1"),
        rounded(F.lit(marks["q3"]), 0).alias("q3"),
        rounded(F.lit(marks["q3"] - marks["q1"]), 0).alias("iqr"),
        rounded(skew, 1).alias("skewness"),
        rounded(kurt, 1).alias("kurtosis"),
    )


def mean_interval(n: int, mean: float, sd: float, confidence: float = 0.95) -> tuple[float, float]:
    """t interval of a mean; (0, 0) where one row or none leaves it undefined."""
    if n <= 1:
        return 0.0, 0.0
    half = dist.t_quantile(confidence, n - 1) * sd / math.sqrt(n)
    return mean - half, mean + half


def welch_df(n1: int, var1: float, n2: int, var2: float) -> float:
    a, b = var1 / n1, var2 / n2
    return _ratio((a + b) ** 2, a * a / (n1 - 1) + b * b / (n2 - 1))


def difference_interval(
    n1: int, mean1: float, var1: float, n2: int, mean2: float, var2: float, confidence: float = 0.95
) -> tuple[float, float]:
    """Welch interval for the difference of two means."""
    if n1 <= 1 or n2 <= 1:
        return 0.0, 0.0
    spread = math.sqrt(var1 / n1 + var2 / n2)
    if spread == 0.0:
        return mean1 - mean2, mean1 - mean2
    half = dist.t_quantile(confidence, welch_df(n1, var1, n2, var2)) * spread
    return mean1 - mean2 - half, mean1 - mean2 + half


def mean_confidence(df: DataFrame, value: str = TARGET, confidence: float = 0.95) -> DataFrame:
    require_values(df, value)
    s = df.agg(F.count(value), F.avg(value), F.stddev_samp(value)).first()
    low, high = mean_interval(s[0], s[1], s[2] or 0.0, confidence)
    sem = s[2] / math.sqrt(s[0]) if s[0] > 1 else NAN
    return one_row(
        df.sparkSession,
        {"n": s[0], "mean": s[1], "sem": sem, "ci_low": low, "ci_high": high},
    )


def group_mean_confidence(
    df: DataFrame, first: Column, value: str = TARGET, confidence: float = 0.95
) -> DataFrame:
    """Interval of each group's mean and of their difference; ``first`` says who is in group one."""
    m = _group_moments(df, first, value)
    low1, high1 = mean_interval(m["n1"], m["m1"], math.sqrt(m["v1"]), confidence)
    low2, high2 = mean_interval(m["n2"], m["m2"], math.sqrt(m["v2"]), confidence)
    low, high = difference_interval(m["n1"], m["m1"], m["v1"], m["n2"], m["m2"], m["v2"], confidence)
    return one_row(
        df.sparkSession,
        {
            "group1_ci_low": low1,
            "group1_ci_high": high1,
            "group2_ci_low": low2,
            "group2_ci_high": high2,
            "diff_ci_low": low,
            "diff_ci_high": high,
        },
    )


# P(X <= k) of a Poisson variable with mean 1, for k = 0, 1, 2, ...
POISSON_STEPS = [
    sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(18)
]


def _poisson_one(uniform: Column) -> Column:
    draw = F.lit(len(POISSON_STEPS))
    for k in reversed(range(len(POISSON_STEPS))):
        draw = F.when(uniform < POISSON_STEPS[k], k).otherwise(draw)
    return draw


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5, which any SQL engine can repeat."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def _log_factorial(k: Column) -> Column:
    small = F.array(*[F.lit(math.lgamma(i + 1.0)) for i in range(10)])
    x = k + 1.0
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    large = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series
    return F.when(k < 10, F.get(small, k.cast("int"))).otherwise(large)


def _poisson(mean: Column, key: Sequence[Column]) -> Column:
    """A Poisson draw with a mean of 10 or more from hashed uniforms, by transformed rejection.

    A try fails with a probability below a fifth; that all of the tries do is out of the question.
    """
    b = 0.931 + 2.53 * F.sqrt(mean)
    a = -0.059 + 0.02483 * b
    scale, quick = 1.1239 + 1.1328 / (b - 3.4), 0.9277 - 3.6224 / (b - 2.0)

    def accepted(u: Column, v: Column) -> Column:
        edge = F.greatest(0.5 - F.abs(u), F.lit(1e-18))
        k = F.floor((2 * a / edge + b) * u + mean + 0.43)
        inside = (edge >= 0.07) & (v <= quick)
        level = F.log(F.greatest(v, F.lit(1e-300))) + F.log(scale) - F.log(a / (edge * edge) + b)
        below = level <= k * F.log(mean) - mean - _log_factorial(k)
        return F.when(inside | ((k >= 0) & ~((edge < 0.013) & (v > edge)) & below), k)

    def attempt(i: Column) -> Column:
        # As elements of an array the two numbers are hashed once, however often they are used.
        pair = F.struct((_uniform(*key, 2 * i) - 0.5).alias("u"), _uniform(*key, 2 * i + 1).alias("v"))
        return F.get(F.transform(F.array(pair), lambda p: accepted(p["u"], p["v"])), F.lit(0))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(64)), F.lit(None).cast("bigint"), lambda found, i: F.coalesce(found, attempt(i))
    )


def bootstrap_replicates(
    df: DataFrame, value: str = TARGET, replicates: int = 1000, seed: int = 42
) -> DataFrame:
    """Mean of each bootstrap resample, with Poisson resampling weights.

    A weight depends on the value, the replicate and the seed only, so the result does not depend
    on the partitioning. Equal values share one draw, Poisson with their number as its mean. Each
    task sends one partial sum per replicate.
    """
    counts = value_counts(df, value).select(F.col(value).cast("double").alias("_v"), "n")
    drawn = counts.select("_v", "n", F.explode(F.expr(f"sequence(0, {replicates - 1})")).alias("replicate"))
    key = [F.col("_v"), F.col("replicate"), F.lit(seed)]
    few = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")),
        F.lit(0),
        lambda total, i: total + _poisson_one(_uniform(*key, i)),
    ).cast("double")
    weight = F.when(F.col("n") == 1, _poisson_one(_uniform(*key, F.lit(1))).cast("double"))
    weight = weight.when(F.col("n") < 10, few).otherwise(_poisson(F.col("n").cast("double"), key).cast("double"))
    weighted = drawn.withColumn("_w", weight)
    return weighted.groupBy("replicate").agg(
        F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("mean_value")
    )


def bootstrap_interval(
    df: DataFrame, value: str = TARGET, confidence: float = 0.95, replicates: int = 1000, seed: int = 42
) -> DataFrame:
    """Percentile interval over the replicate means, a table with one row per replicate."""
    tail = (1.0 - confidence) / 2.0
    means = bootstrap_replicates(df, value, replicates, seed)
    return means.agg(
        F.percentile("mean_value", F.lit(tail)).alias("boot_low"),
        F.percentile("mean_value", F.lit(1.0 - tail)).alias("boot_high"),
    )


def confidence_report(
    df: DataFrame, value: str = TARGET, confidence: float = 0.95, replicates: int = 1000, seed: int = 42
) -> DataFrame:
    """Level, mean, standard error, parametric and bootstrap interval."""
    boot = bootstrap_interval(df, value, confidence, replicates, seed)
    return (
        mean_confidence(df, value, confidence)
        .withColumn("confidence_level", F.lit(f"{round(confidence * 100)}%"))
        .withColumn("_b", boot.select(F.struct("boot_low", "boot_high")).scalar())
        .select("confidence_level", "n", "mean", "sem", "ci_low", "ci_high", "_b.boot_low", "_b.boot_high")
    )


def _correlation_p(r: float | None, n: int) -> float:
    if r is None or math.isnan(r) or n < 3:
        return NAN
    if abs(r) >= 1.0:
        return 0.0
    return dist.t_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)


def _pair_counts(
    df: DataFrame, features: Sequence[str], value: str
) -> tuple[DataFrame, dict[str, list[float]], list[float]]:
    """Rows per (feature, ``x``, target ``y``), from the only read of the facts, and values that cut each
    feature and the target into blocks, if there are many rows."""
    spark, seen = df.sparkSession, Observation()
    y, x = F.col(value).cast("double"), F.col("x")
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"), y.alias("y")) for f in features]
    counts = df.select(value, *features).na.drop().select(F.inline(F.array(*pairs))).groupBy("feature", "x", "y").agg(
        F.count("*").alias("n")
    )
    watched = counts.observe(
        seen,
        F.count("*").alias("rows"),
        block_cuts(spark, F.col("y")).alias("cuts"),
        *[block_cuts(spark, F.when(F.col("feature") == f, x)).alias(f"cuts_{i}") for i, f in enumerate(features)],
    )
    written, found = materialize(watched, "pair-counts"), seen.get
    if (found.get("rows") or 0) <= ROWS_PER_BLOCK:
        return written, {f: [] for f in features}, []
    by_feature = {f: sorted(set(found[f"cuts_{i}"])) for i, f in enumerate(features)}
    return written, by_feature, sorted(set(found["cuts"]))


def _starts(totals: dict[int, int], cuts: Sequence[float]) -> list[int]:
    """Rows in the blocks before each block."""
    starts = [0]
    for b in range(2 * len(cuts)):
        starts.append(starts[-1] + totals.get(b, 0))
    return starts


def _constants(values: Sequence[int]) -> Column:
    return F.expr("array({})".format(", ".join(f"{v}L" for v in values)))


def correlation_sums(df: DataFrame, features: Sequence[str], value: str = TARGET) -> list[dict]:
    """Pearson and Spearman coefficient of every feature with the target, ties sharing their mid-rank.

    Works on rows per (feature, value, target). Both ranks are running totals inside blocks of values
    that follow on the rows of the blocks before. A value that holds more than a block's share is a block
    of its own: its rank is a constant and its rows are spread over the tasks. Sums are taken of
    deviations from the means.
    """
    counts, x_cuts, y_cuts = _pair_counts(df, features, value)
    feature, x, y, n = F.col("feature"), F.col("x"), F.col("y"), F.col("n")

    def each(choose) -> Column:
        return F.coalesce(*[F.when(feature == f, choose(f)) for f in features])

    x_block = each(lambda f: point_block(x_cuts[f], x))
    y_block = point_block(y_cuts, y)
    # The rows of one feature are all rows, so the target is counted once.
    sides = F.array(
        F.struct(F.lit("x").alias("side"), x_block.alias("block"), x.alias("v")),
        F.struct(F.when(feature == features[0], "y").alias("side"), y_block.alias("block"), y.alias("v")),
    )
    totals = counts.select("feature", "n", F.inline(sides)).filter("side IS NOT NULL").groupBy("feature", "side", "block").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("s")
    ).collect()  # some blocks for each named feature
    if not totals:
        return []
    size = sum(r["n"] for r in totals if r["side"] == "y")
    y_rows = {r["block"]: r["n"] for r in totals if r["side"] == "y"}
    x_rows = {f: {r["block"]: r["n"] for r in totals if r["side"] == "x" and r["feature"] == f} for f in features}
    y_mean = math.fsum(r["s"] for r in totals if r["side"] == "y") / size
    x_mean = {f: math.fsum(r["s"] for r in totals if r["side"] == "x" and r["feature"] == f) / size for f in features}
    middle = (size + 1) / 2

    single = F.col("_yb") % 2 == 1
    placed = counts.withColumn("_yb", y_block).withColumn(
        "_spread", F.when(single, F.pmod(F.xxhash64("x"), F.lit(1000))).otherwise(F.lit(0))
    )
    block = ["feature", "_yb", "_spread"]
    upto = F.sum("n").over(Window.partitionBy(*block).orderBy("y").rangeBetween(Window.unboundedPreceding, 0))
    ties = F.sum("n").over(Window.partitionBy(*block, "y"))
    start = F.get(_constants(_starts(y_rows, y_cuts)), F.col("_yb"))
    held = F.get(_constants([y_rows.get(b, 0) for b in range(2 * len(y_cuts) + 1)]), F.col("_yb"))
    ranked = placed.withColumns({"_upto": upto, "_ties": ties}).withColumn(
        "_ry",
        start + F.when(single, (held + 1) / 2).otherwise(F.col("_upto") - F.col("_ties") + (F.col("_ties") + 1) / 2) - middle,
    )
    ry, dy = F.col("_ry"), y - y_mean
    per_value = ranked.groupBy("feature", "x").agg(
        F.sum("n").alias("n"),
        F.sum(n * ry).alias("_sr"),
        F.sum(n * ry * ry).alias("_srr"),
        F.sum(n * dy).alias("_sy"),
        F.sum(n * dy * dy).alias("_syy"),
    )
    below = F.sum("n").over(Window.partitionBy("feature", "_xb").orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    x_start = each(lambda f: F.get(_constants(_starts(x_rows[f], x_cuts[f])), F.col("_xb")))
    both = per_value.withColumn("_xb", x_block).withColumn("_below", F.coalesce(below, F.lit(0)))
    rx, dx = x_start + F.col("_below") + (n + 1) / 2 - middle, x - each(lambda f: F.lit(x_mean[f]))
    sums = both.withColumns({"_rx": rx, "_dx": dx}).groupBy("feature").agg(
        F.try_divide(F.sum(F.col("_dx") * F.col("_sy")), F.sqrt(F.sum(n * F.col("_dx") * F.col("_dx")) * F.sum("_syy"))).alias("pearson_r"),
        F.try_divide(F.sum(F.col("_rx") * F.col("_sr")), F.sqrt(F.sum(n * F.col("_rx") * F.col("_rx")) * F.sum("_srr"))).alias("spearman_r"),
    )
    return [r.asDict() | {"n": size} for r in sums.collect()]  # one row per feature


def correlations(
    df: DataFrame, features: Sequence[str], value: str = TARGET, alpha: float = 0.01
) -> DataFrame:
    """Pearson and Spearman coefficient and p-value per feature, strongest first. The facts are read
    once, while this is called; what is returned is a table of one row per feature."""
    rows = []
    for s in correlation_sums(df, features, value):
        p = _correlation_p(s["pearson_r"], s["n"])
        rows.append(
            (s["feature"], s["n"], s["pearson_r"], p, s["spearman_r"], _correlation_p(s["spearman_r"], s["n"]), p < alpha)
        )
    schema = (
        "feature string, n bigint, pearson_r double, pearson_p double, "
        "spearman_r double, spearman_p double, significant boolean"
    )
    table = small_table(df.sparkSession, rows, schema)
    return table.orderBy(F.abs("pearson_r").desc_nulls_last(), "feature")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every ordered pair of columns, from one aggregate over the unordered pairs."""
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs]
    )
    cells = []
    for a, b in pairs:
        for x, y in {(a, b), (b, a)}:
            cells.append(
                F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), F.col(f"{a}|{b}").alias("r"))
            )
    return row.select(F.inline(F.array(*cells)))


def _group_moments(df: DataFrame, first: Column, value: str) -> dict:
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    row = df.agg(
        F.count(a).alias("n1"), F.avg(a).alias("m1"), F.var_samp(a).alias("v1"),
        F.count(b).alias("n2"), F.avg(b).alias("m2"), F.var_samp(b).alias("v2"),
    ).first()
    if not row["n1"] or not row["n2"]:
        raise ValueError("both groups need at least one value")
    return {k: (0.0 if v is None else v) for k, v in row.asDict().items()}


def two_sample(
    df: DataFrame,
    first: Column,
    value: str = TARGET,
    test_name: str = "Two-Sample Hypothesis Test",
    group1: str = "group1",
    group2: str = "group2",
    confidence: float = 0.95,
) -> DataFrame:
    """Everything the two-sample report holds, from one scan of the data.

    The scan leaves a table of distinct values with a count per group. Its running totals give the
    mid-ranks for Mann-Whitney and the medians; weighted sums over it give moments and Levene.
    """
    require_values(df, value)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.col(value).cast("double").alias("v"))
        .agg(F.count_if(first).alias("c1"), F.count_if(~first).alias("c2"))
    )
    ranked = running_totals(counted, ["v"], {"u1": "c1", "u2": "c2"})
    ranked = materialize(
        ranked.select("v", "c1", "c2", (F.col("u1") - F.col("c1")).alias("b1"), (F.col("u2") - F.col("c2")).alias("b2")),
        "two-sample",
    )
    v, c1, c2 = F.col("v"), F.col("c1"), F.col("c2")
    n = c1 + c2
    # Twice the mid-rank is a whole number; rank sums of any size are exact as decimals.
    twice_mid = (2 * (F.col("b1") + F.col("b2")) + n + 1).cast("decimal(19,0)")
    tied = n.cast("double")
    s = ranked.agg(
        F.sum("c1").alias("n1"),
        F.sum("c2").alias("n2"),
        F.sum(c1 * v).alias("s1"),
        F.sum(c2 * v).alias("s2"),
        F.sum(c1.cast("decimal(18,0)") * twice_mid).alias("r1"),
        F.sum(tied * tied * tied - tied).alias("ties"),
    ).first()
    n1, n2 = s["n1"] or 0, s["n2"] or 0
    if not n1 or not n2:
        raise ValueError("both groups need at least one value")
    m1, m2 = s["s1"] / n1, s["s2"] / n2
    med1 = pick_quantiles(ranked, "v", {"m": 0.5}, {None: n1}, n="c1", before="b1")[None]["m"]
    med2 = pick_quantiles(ranked, "v", {"m": 0.5}, {None: n2}, n="c2", before="b2")[None]["m"]
    z1, z2 = F.abs(v - med1), F.abs(v - med2)
    d = ranked.agg(
        F.sum(c1 * (v - m1) * (v - m1)).alias("q1"),
        F.sum(c2 * (v - m2) * (v - m2)).alias("q2"),
        F.sum(c1 * z1).alias("z1"),
        F.sum(c2 * z2).alias("z2"),
        F.sum(c1 * z1 * z1).alias("zz1"),
        F.sum(c2 * z2 * z2).alias("zz2"),
    ).first()
    total = n1 + n2
    var1 = d["q1"] / (n1 - 1) if n1 > 1 else 0.0
    var2 = d["q2"] / (n2 - 1) if n2 > 1 else 0.0

    zm1, zm2 = d["z1"] / n1, d["z2"] / n2
    zm = (d["z1"] + d["z2"]) / total
    between = n1 * (zm1 - zm) ** 2 + n2 * (zm2 - zm) ** 2
    within = d["zz1"] - n1 * zm1**2 + d["zz2"] - n2 * zm2**2
    levene = _ratio((total - 2) * between, within)

    spread = math.sqrt(var1 / n1 + var2 / n2)
    t = _ratio(m1 - m2, spread)
    t_p = dist.t_two_sided(t, welch_df(n1, var1, n2, var2)) if spread else NAN

    u = float(int(s["r1"]) - n1 * (n1 + 1)) / 2.0
    sigma = math.sqrt(n1 * n2 / 12.0 * (total + 1 - s["ties"] / (total * (total - 1.0))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sigma if sigma else 0.0
    u_p = min(1.0, dist.normal_two_sided(z)) if z > 0 else 1.0

    pooled = math.sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (total - 2)) if total > 2 else 0.0
    cohen = (m1 - m2) / pooled if pooled > 0 else 0.0
    low1, high1 = mean_interval(n1, m1, math.sqrt(var1), confidence)
    low2, high2 = mean_interval(n2, m2, math.sqrt(var2), confidence)
    low, high = difference_interval(n1, m1, var1, n2, m2, var2, confidence)
    return one_row(
        df.sparkSession,
        {
            "test_name": test_name,
            "group1": group1,
            "n1": n1,
            "mean1": m1,
            "median1": med1,
            "mean1_ci_low": low1,
            "mean1_ci_high": high1,
            "group2": group2,
            "n2": n2,
            "mean2": m2,
            "median2": med2,
            "mean2_ci_low": low2,
            "mean2_ci_high": high2,
            "mean_difference": m1 - m2,
            "diff_ci_low": low,
            "diff_ci_high": high,
            "levene_statistic": levene,
            "levene_p": dist.f_upper(levene, 1, total - 2) if levene == levene else NAN,
            "welch_t": t,
            "welch_p": t_p,
            "mann_whitney_u": u,
            "mann_whitney_p": u_p,
            "cohens_d": cohen,
            "rank_biserial": 1.0 - 2.0 * u / (n1 * n2),
            "effect_size": effect_size(cohen),
            "conclusion": "Reject H0" if t_p < 0.05 else "Fail to reject H0",
        },
    )


def weekday_test(df: DataFrame, value: str = TARGET) -> DataFrame:
    name = "Weekday vs. Weekend Hypothesis Test"
    return two_sample(df, F.col("weekday") < 5, value, name, "Weekday", "Weekend")


def rush_test(df: DataFrame, value: str = TARGET) -> DataFrame:
    name = "Rush Hour vs. Non-Rush Hour Hypothesis Test"
    return two_sample(df, F.col("is_rush") == 1, value, name, "Rush Hour", "Non-Rush Hour")


def category_test(df: DataFrame, category: str = "weather_main", value: str = TARGET) -> DataFrame:
    """One-way ANOVA and Kruskal-Wallis across the values of a category.

    ANOVA needs one row of moments per category. Kruskal-Wallis needs the rank sum per category,
    from counts per (value, category) in value order. Both are summed by Spark.
    """
    rows = df.filter(F.col(value).isNotNull() & F.col(category).isNotNull())
    require_values(rows, value)
    pairs = materialize(value_counts(rows, value, [category]), "kruskal-pairs")
    groups = rows.groupBy(category).agg(
        F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")
    )
    overall = pairs.agg(F.sum(F.col("n") * F.col(value)) / F.sum("n")).scalar()
    a = groups.withColumn("_g", overall).agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("m") - F.col("_g")) * (F.col("m") - F.col("_g"))).alias("between"),
        F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("within"),
    ).first()
    k, n = a["k"], a["n"]
    f = _ratio(a["between"] / (k - 1), a["within"] / (n - k)) if k > 1 and n > k else NAN

    per_value = pairs.groupBy(value).agg(F.sum("n").alias("n"))
    # Twice the distance of a mid-rank from the mean rank: whole numbers that add up to zero.
    off = 2 * F.col("_upto") - F.col("n") - int(n)
    ranked = running_totals(per_value, [value], {"_upto": "n"}).select(value, "n", off.alias("off"))
    ranked = materialize(ranked, "kruskal-ranks")
    rank_sums = (
        pairs.withColumnRenamed("n", "c")
        .join(ranked, value)
        .groupBy(category)
        .agg(F.sum(F.col("off").cast("decimal(19,0)") * F.col("c").cast("decimal(18,0)")).alias("r"), F.sum("c").alias("c"))
    )
    r = F.col("r").cast("double") / 2
    squares = rank_sums.agg(F.sum(r * r / F.col("c"))).first()[0]
    tied = F.col("n").cast("double")
    ties = ranked.agg(F.sum(tied * tied * tied - tied)).first()[0]
    h = 12.0 / (n * (n + 1.0)) * squares
    h = _ratio(h, 1.0 - ties / (float(n) ** 3 - n)) if n > 1 else NAN
    return one_row(
        df.sparkSession,
        {
            "categories": k,
            "n": n,
            "anova_f": f,
            "anova_p": dist.f_upper(f, k - 1, n - k) if f == f else NAN,
            "kruskal_h": h,
            "kruskal_p": dist.chi2_upper(h, k - 1) if h == h and k > 1 else NAN,
        },
    )
