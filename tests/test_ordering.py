import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import ordering, windows
from tidemark.operators.quantiles import quantiles

SLOW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value, which also spans several blocks."""
    rng = np.random.default_rng(7)
    values = np.where(np.arange(6000) % 3 == 0, 5.0, rng.integers(0, 400, 6000) / 4.0)
    keys = rng.permutation(6000)
    return spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, values)], "id bigint, v double")


@pytest.mark.parametrize("partitions", [1, 40])
def test_ordinal_does_not_depend_on_partitioning(skewed, partitions):
    got = ordering.with_ordinal(skewed.repartition(partitions), ["v", "id"]).orderBy("ordinal").collect()
    expected = sorted((r.v, r.id) for r in skewed.collect())
    assert [(r.v, r.id) for r in got] == expected
    assert [r.ordinal for r in got] == list(range(len(expected)))


def test_blocks_split_a_hot_value(skewed):
    skewed.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = ordering.layout(skewed, ["v", "id"])
        sizes = [r["count"] for r in laid.groupBy(ordering.BLOCK).count().collect()]
    finally:
        skewed.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 2 * 6000 / 8


def test_running_totals_restart_per_group_across_blocks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("big", i, 1 + i % 3) for i in range(3000)] + [(g, i, 2) for g in "abcxyz" for i in range(4)]
        df = spark.createDataFrame(rows, "g string, k bigint, n bigint")
        got = ordering.running_totals(df, ["k"], {"total": "n"}, ["g"]).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = pd.DataFrame(rows, columns=["g", "k", "n"]).sort_values(["g", "k"])
    expected["total"] = expected.groupby("g")["n"].cumsum()
    got = got.sort_values(["g", "k"]).reset_index(drop=True)
    assert got["total"].tolist() == expected["total"].tolist()


def test_ranks_match_pandas(skewed):
    got = ordering.ranked_values(skewed, "v").toPandas().set_index("v")
    v = skewed.toPandas()["v"]
    average = pd.DataFrame({"v": v, "r": v.rank()}).groupby("v")["r"].first()
    lowest = pd.DataFrame({"v": v, "r": v.rank(method="min")}).groupby("v")["r"].first()
    assert (got["avg_rank"].sort_index() == average).all()
    assert (got["min_rank"].sort_index() == lowest).all()


@pytest.mark.parametrize("partitions", [1, 40])
def test_volume_rank_with_ties_and_nulls(spark, skewed, partitions):
    df = skewed.withColumnRenamed("v", "traffic_volume").repartition(partitions)
    df = df.unionByName(spark.createDataFrame([(-1, None), (-2, None)], "id bigint, traffic_volume double"))
    got = windows.volume_rank(df).toPandas()
    assert len(got) == 6002
    known = got.dropna()
    assert (known["volume_rank"] == known["traffic_volume"].rank(method="min", ascending=False)).all()
    assert got[got["traffic_volume"].isna()]["volume_rank"].isna().all()


def test_lookup_keeps_copies_of_a_row(spark):
    df = spark.createDataFrame([(5.0,)] * 500 + [(float(i),) for i in range(1000, 3000)], "v double")
    ranks = ordering.ranked_values(df, "v")
    got = ordering.lookup(df, ranks, "v", ["min_rank"])
    assert got.count() == 2500
    assert got.filter("v = 5.0").select("min_rank").distinct().collect()[0][0] == 1
    assert got.filter("v = 5.0").count() == 500


@pytest.mark.parametrize("position", [0, 1999, 2000, 4321, 5999])
def test_key_at_and_before_key(skewed, position):
    bound = ordering.key_at(skewed, ["v", "id"], position)
    expected = sorted((r.v, r.id) for r in skewed.collect())
    assert bound == expected[position][: len(bound)]
    assert skewed.filter(ordering.before_key(["v", "id"], bound)).count() == position


@pytest.mark.parametrize("position", [0, 3, 49, 50, 80, 99])
def test_missing_keys_come_last_and_no_row_is_lost(spark, position):
    rows = [(k % 7 if k % 3 else None, k if k % 2 else None) for k in range(100)]
    df = spark.createDataFrame(rows, "v int, id int").repartition(5)
    order = sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))
    bound = ordering.key_at(df, ["v", "id"], position)
    assert bound == order[position]
    before = df.filter(ordering.before_key(["v", "id"], bound)).count()
    assert before == order.index(order[position])
    assert before + df.filter(ordering.from_key(["v", "id"], bound)).count() == 100


def test_key_at_beyond_the_end(skewed):
    assert ordering.key_at(skewed, ["v", "id"], 6000) is None


def test_split_position_inside_a_crowded_hour(make_series):
    df = make_series(range(400), hours=[min(i, 100) for i in range(400)])
    bound = ordering.time_key_at(df, ["date_time", "obs_id"], 0.85)
    assert df.filter(ordering.before_key(["date_time", "obs_id"], bound)).count() == 340
    assert ordering.time_key_at(df.filter("false"), ["date_time", "obs_id"], 0.85) is None


@pytest.mark.parametrize("missing", [0, 10, 60, 100])
def test_split_position_with_rows_without_time_or_id(make_series, missing):
    df = make_series(range(100), hours=[k // 9 for k in range(100)])
    df = df.withColumn("date_time", F.when(F.col("obs_id") >= missing, F.col("date_time")))
    df = df.withColumn("obs_id", F.when(F.col("obs_id") % 2 == 0, F.col("obs_id")))
    keys = ["date_time", "obs_id"]
    bound = ordering.time_key_at(df, keys, 0.85)
    early, late = df.filter(ordering.before_key(keys, bound)), df.filter(ordering.from_key(keys, bound))
    # Rows alike in all keys cannot be told apart; they stay together on the late side.
    same = df.filter(F.col("date_time").eqNullSafe(F.lit(bound[0])) & F.col("obs_id").eqNullSafe(F.lit(bound[1]))).count()
    assert early.count() + late.count() == 100
    assert 85 - same < early.count() <= 85


def test_halo_rows_are_never_owned_twice(spark):
    df = spark.range(1000).withColumnRenamed("id", "ordinal")
    chunked = ordering.halo_chunks(df, lookback=10, chunk_rows=64)
    owned = chunked.filter("owned")
    assert owned.count() == 1000 and owned.select("ordinal").distinct().count() == 1000
    per_chunk = chunked.groupBy("chunk").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert per_chunk == 74


@SLOW
@given(st.lists(st.floats(-1e6, 1e6).map(lambda x: round(x, 3)), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probabilities = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.93, "f": 1.0}
    got = quantiles(df, "v", probabilities).first()
    assert np.allclose(list(got), np.quantile(values, list(probabilities.values())), rtol=1e-9, atol=1e-9)


def test_quantiles_per_group(spark, skewed):
    df = skewed.withColumn("g", F.when(F.col("id") % 3 == 0, "x").otherwise("y"))
    got = {r.g: (r.q, r.m) for r in quantiles(df, "v", {"q": 0.9, "m": 0.5}, ["g"]).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx((part["v"].quantile(0.9), part["v"].median()))


def _row_level_single_partitions(df, row_columns):
    """Exchanges to a single partition whose input still holds row-level columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    found = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = lines[i + 1] if i + 1 < len(lines) else ""
            if not any(k in below for k in ("Aggregate", "partial_")):
                found.append(below)
    return found


def test_no_window_gathers_all_rows(make_series):
    df = make_series(range(500))
    for result in (
        windows.rolling_average(df),
        windows.lag_features(df),
        windows.forecasting_features(df),
        windows.time_features(df),
        windows.volume_rank(df),
    ):
        assert _row_level_single_partitions(result, df.columns) == []


def _exchanges(df, columns):
    """Shuffles that carry all of ``columns``, of a plan without adaptive execution."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    return found, plan


def test_bounded_frames_exchange_rows_once(spark, make_series, monkeypatch):
    """One exchange over row columns before the blocks are written; only block ends are exchanged again."""
    plans = []

    def written(df, name):
        plans.append((name, *_exchanges(df, df.columns)))
        return materialize(df, name)

    materialize = ordering.materialize
    monkeypatch.setattr(ordering, "materialize", written)
    df = make_series([float(i % 97) for i in range(9000)]).repartition(6).persist()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for make in (windows.rolling_average, windows.lag_features, windows.forecasting_features):
            plans.clear()
            result = make(df, chunk_rows=1000)
            assert [name for name, *_ in plans] == ["blocks"]
            own = [line for line in plans[0][1] if "RoundRobin" not in line]
            assert len(own) == 1 and "_block" in own[0]
            # What is read back is filtered, not shuffled, but for the heads and tails of blocks.
            after, plan = _exchanges(result, df.columns)
            assert len(after) == 1 and "_owned" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        df.unpersist()


@pytest.mark.parametrize("chunk", [1, 5, 60, 400])
def test_one_hour_spans_many_blocks(make_series, chunk):
    """A third of all rows share an hour, blocks are shorter than the frame, and rows without a time come last."""
    rng = np.random.default_rng(11)
    hours = np.sort(np.where(np.arange(600) % 3 == 0, 50, rng.integers(0, 100, 600)))
    values = rng.integers(0, 7000, 600).astype(float)
    df = make_series(values, hours=hours)
    df = df.withColumn("date_time", F.when(F.col("obs_id") < 590, F.col("date_time"))).repartition(7)
    got = windows.lag_features(df, [1, 24], chunk_rows=chunk).toPandas().sort_values("obs_id")
    assert np.allclose(got["lag_24h"], pd.Series(values).shift(24), equal_nan=True)
    got = windows.rolling_average(df, digits=None, chunk_rows=chunk).toPandas().sort_values("obs_id")
    assert np.allclose(got["rolling_24h_avg"], pd.Series(values).rolling(24, min_periods=1).mean())


def test_series_that_cross_blocks(make_series):
    """Series of every length, one over many blocks, one null; only those that cross a cut are mended."""
    names = [None] * 50 + ["big"] * 700 + [f"s{i % 40}" for i in range(400)]
    values = np.random.default_rng(5).integers(0, 7000, len(names)).astype(float)
    df = make_series(values, site=names).repartition(5)
    got = windows.lag_features(df, [1, 30], series=["site"], chunk_rows=64).toPandas()
    assert len(got) == len(names)
    for _, part in got.groupby(got["site"].fillna("-")):
        part = part.sort_values("date_time")
        assert np.allclose(part["lag_30h"], part["traffic_volume"].shift(30), equal_nan=True)
        assert np.allclose(part["lag_1h"], part["traffic_volume"].shift(1), equal_nan=True)
