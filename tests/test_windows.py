import numpy as np
import pandas as pd
import pytest

from tidemark.operators import selection, windows

FEATURES = ["lag_1h", "lag_24h", "rolling_mean_24h", "rolling_std_24h", "ewma_24h"]


def reference(values):
    s = pd.Series(values, dtype=float)
    past = s.shift(1)
    return pd.DataFrame(
        {
            "lag_1h": past,
            "lag_24h": s.shift(24),
            "rolling_mean_24h": past.rolling(24).mean(),
            "rolling_std_24h": past.rolling(24).std(),
            "ewma_24h": past.ewm(span=24).mean(),
        }
    )


@pytest.fixture(scope="module")
def volumes():
    return np.random.default_rng(3).integers(0, 7000, 3000).astype(float)


@pytest.mark.parametrize("partitions,chunk", [(1, None), (40, 600)])
def test_features_match_pandas(make_series, volumes, partitions, chunk):
    df = make_series(volumes).repartition(partitions)
    got = windows.forecasting_features(df, chunk_rows=chunk, drop_incomplete=False).orderBy("date_time").toPandas()
    for c, expected in reference(volumes).items():
        assert np.allclose(got[c], expected, rtol=1e-9, equal_nan=True), c


def test_incomplete_rows_are_dropped(make_series, volumes):
    got = windows.forecasting_features(make_series(volumes[:100]))
    assert got.count() == 76
    assert got.filter(" OR ".join(f"{c} IS NULL" for c in FEATURES)).count() == 0


def test_kept_row_24_averages_the_kept_rows_before_it(make_series, volumes):
    got = windows.forecasting_features(make_series(volumes[:100])).orderBy("date_time").toPandas()
    assert got["rolling_mean_24h"][24] == pytest.approx(got["traffic_volume"][:24].mean())


def test_changing_a_row_leaves_its_own_features_alone(make_series, volumes):
    base, changed = list(volumes[:200]), list(volumes[:200])
    changed[150] = 1e6
    a, b = (
        windows.forecasting_features(make_series(v)).orderBy("date_time").toPandas() for v in (base, changed)
    )
    assert a.loc[:126, FEATURES].equals(b.loc[:126, FEATURES])
    assert not np.isclose(a.loc[127, "lag_1h"], b.loc[127, "lag_1h"])


def test_missing_volumes_follow_pandas(make_series, volumes):
    values = [None if i in (30, 31, 90) else v for i, v in enumerate(volumes[:150])]
    got = windows.forecasting_features(make_series(values), drop_incomplete=False).orderBy("date_time").toPandas()
    for c, expected in reference(values).items():
        assert np.allclose(got[c], expected, rtol=1e-9, equal_nan=True), c


@pytest.mark.parametrize("span", [2, 200])
def test_other_spans(make_series, volumes, span):
    values = volumes[:1500]
    got = windows.forecasting_features(make_series(values), span=span, drop_incomplete=False)
    got = got.orderBy("date_time").toPandas()[f"ewma_{span}h"]
    assert np.allclose(got, pd.Series(values).shift(1).ewm(span=span).mean(), rtol=1e-9, equal_nan=True)


def test_tied_times_are_ordered_by_id(make_series, volumes):
    df = make_series(volumes[:300], hours=[i // 4 for i in range(300)])
    got = windows.forecasting_features(df, drop_incomplete=False).orderBy("obs_id").toPandas()
    assert np.allclose(got["lag_1h"], pd.Series(volumes[:300]).shift(1), equal_nan=True)


def test_rolling_average_is_partial_at_the_start(make_series, volumes):
    df = make_series(volumes[:500])
    got = windows.rolling_average(df, digits=None, chunk_rows=100).orderBy("date_time").toPandas()
    expected = pd.Series(volumes[:500]).rolling(24, min_periods=1).mean()
    assert np.allclose(got["rolling_24h_avg"], expected)


def test_lag_list_includes_a_week(make_series, volumes):
    got = windows.lag_features(make_series(volumes[:400]), [1, 168], chunk_rows=170).orderBy("date_time").toPandas()
    assert np.allclose(got["lag_168h"], pd.Series(volumes[:400]).shift(168), equal_nan=True)


def test_series_do_not_mix(make_series, volumes):
    names = ["a" if i % 3 else "b" for i in range(900)]
    df = make_series(volumes[:900], site=names)
    got = windows.forecasting_features(df, series=["site"], chunk_rows=520, drop_incomplete=False).toPandas()
    for site, part in got.groupby("site"):
        part = part.sort_values("date_time")
        expected = reference(part["traffic_volume"].to_numpy())
        for c in FEATURES:
            assert np.allclose(part[c], expected[c].to_numpy(), rtol=1e-9, equal_nan=True), (site, c)


def test_time_mode_respects_gaps_and_repeats(make_series):
    hours = [h for h in range(1200) if h % 7 != 3] + [5, 5]
    values = [float(h) for h in hours[:-2]] + [100.0, 200.0]
    got = windows.time_features(make_series(values, hours)).orderBy("date_time").toPandas()
    series = pd.Series(values, index=hours).groupby(level=0).mean()
    full = series.reindex(range(0, 1200))
    for name, expected in {
        "lag_1h": full.shift(1),
        "lag_24h": full.shift(24),
        "rolling_mean_24h": full.shift(1).rolling(24, min_periods=1).mean(),
        "rolling_std_24h": full.shift(1).rolling(24, min_periods=2).std(),
        "rolling_24h_avg": full.rolling(24, min_periods=1).mean(),
    }.items():
        assert np.allclose(got[name], expected[series.index], equal_nan=True), name


def test_top_k_per_year_keeps_ties(make_series):
    df = make_series([5, 5, 4, 3, 3, 1], hours=[0, 1, 2, 3, 4, 9000])
    got = selection.top_k_per_year(df, 2).orderBy("obs_id").collect()
    assert [(r.obs_id, r.volume_rank) for r in got] == [(0, 1), (1, 1), (2, 2), (5, 1)]


def test_long_lags_leave_the_average_alone(make_series):
    """A lag of a year over hours stretches the halo, not the weights of the average."""
    values = np.random.default_rng(4).integers(0, 7000, 20000).astype(float)
    df = make_series(values).repartition(6)
    got = windows.forecasting_features(df, lags=(1, 24, 8760), drop_incomplete=False).orderBy("date_time").toPandas()
    expected = reference(values)
    assert np.allclose(got["ewma_24h"], expected["ewma_24h"], rtol=1e-9, equal_nan=True)
    assert np.allclose(got["lag_8760h"], pd.Series(values).shift(8760), equal_nan=True)
    assert windows.forecasting_features(df, lags=(1, 24, 8760)).count() == 20000 - 8760


def test_values_that_are_not_numbers_do_not_drop_rows(make_series):
    values = [float(k) for k in range(100)]
    values[50] = float("nan")
    assert windows.forecasting_features(make_series(values)).count() == 76


@pytest.mark.parametrize("span", [1, 2, 24, 400])
def test_any_span(make_series, volumes, span):
    got = windows.forecasting_features(make_series(volumes), span=span, chunk_rows=500, drop_incomplete=False)
    got = got.orderBy("date_time").toPandas()[f"ewma_{span}h"]
    assert np.allclose(got, pd.Series(volumes).shift(1).ewm(span=span).mean(), rtol=1e-9, equal_nan=True)
