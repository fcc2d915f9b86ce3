"""Operators against NumPy, invariants and odd series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import anomaly, calendar, correlation, descriptive, detectors_np, forecasting, multivariate, quality, seasonality, series, stationarity, trend, windows

AIRLINE = [112, 118, 132, 129, 121, 135, 148, 148, 136, 119, 104, 118, 115, 126, 141, 135, 125, 149, 170, 170, 158, 133, 114, 140, 145, 150, 178, 163, 172, 178, 199, 199, 184, 162, 146, 166, 171, 180, 193, 181, 183, 218, 230, 242, 209, 191, 172, 194]


def make(spark, values, name="s", step=3600):
    rows = [(name, i * step, None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, t long, value double").select("series_id", F.timestamp_seconds(F.lit(1_000_000_000) + F.col("t")).alias("ts"), "value")
    return series.with_index(series.canonicalize(series.to_series(df, "series_id", "ts", "value")))


def one(df):
    (row,) = df.collect()
    return row


def test_ramp_has_population_variance(spark):
    r = one(descriptive.describe(make(spark, range(100))))
    assert (r.n, r.mean, r.variance, r.p50, r.range, r.mode) == (100, 49.5, 833.25, 49.5, 99.0, None)
    assert abs(r.skewness) < 1e-9


def test_duplicates_are_averaged_and_nan_is_missing(spark):
    df = spark.createDataFrame([("s", 5, 1.0), ("s", 5, 3.0), ("s", 6, math.nan), ("s", 6, 4.0), ("s", 7, math.nan), ("s", None, 9.0)], "k string, t long, v double").select("k", F.timestamp_seconds("t").alias("ts"), "v")
    rows = series.indexed(df, "k", "ts", "v").orderBy("idx").collect()
    assert [(r.value, r.idx, r.vidx) for r in rows] == [(2.0, 0, 0), (4.0, 1, 1), (None, 2, None)]


@pytest.mark.parametrize("values", [[], [1.0], [2.0, 2.0], [None, None], [5.0] * 30, [math.inf, 1.0, 2.0, None], [1e308, -1e308, 1e308]])
def test_odd_series_do_not_fail(spark, values):
    s = make(spark, values)
    for f in (series.summary, descriptive.histogram, anomaly.zscore, anomaly.iqr, anomaly.modified_zscore, trend.pettitt, trend.linear_trend, windows.linear_fill, windows.temporal_coverage, quality.profile, trend.directional_consistency, seasonality.auto_period):
        f(s).collect()
    for f in (forecasting.moving_average, forecasting.FORECASTERS["ses"], detectors_np.isolation_forest, stationarity.cusum_changepoints, stationarity.partial_autocorrelation):
        f(s).collect()


def test_autocorrelation_and_partial(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=80)) * 0.3 + rng.normal(size=80)
    d = x - x.mean()
    want = [float((d[: 80 - k] * d[k:]).sum() / (d * d).sum()) for k in range(6)]
    got = {r.lag: r.acf for r in correlation.autocorrelation(make(spark, x), 5).collect()}
    assert np.allclose([got[k] for k in range(6)], want)
    p = [r.pacf for r in stationarity.partial_autocorrelation(make(spark, x), 5).orderBy("lag").collect()]
    for k in range(1, 6):
        m = np.array([[want[abs(i - j)] for j in range(k)] for i in range(k)])
        assert math.isclose(p[k - 1], np.linalg.solve(m, want[1 : k + 1])[-1], abs_tol=1e-9)


def test_decomposition_adds_up_and_finds_the_pattern(spark):
    x = [0.5 * i + (3, -1, -2)[i % 3] for i in range(60)]
    rows = trend.decompose(make(spark, x), 3).orderBy("idx").collect()
    assert all(abs(r.trend + r.seasonal + r.residual - r.value) < 1e-9 for r in rows)
    assert np.allclose([r.seasonal for r in rows[:3]], [3, -1, -2]) and np.allclose([r.trend for r in rows], [0.5 * i for i in range(60)])
    rows = trend.decompose(make(spark, AIRLINE), 12, True).collect()
    assert all(abs(r.trend * r.seasonal * r.residual - r.value) < 1e-6 for r in rows)


def test_trend_tests(spark):
    s = make(spark, AIRLINE)
    a, b = one(trend.mann_kendall(s)), one(detectors_np.mann_kendall(s))
    want = sum(np.sign(AIRLINE[j] - AIRLINE[i]) for i in range(48) for j in range(i + 1, 48))
    assert a.s == b.s == want and math.isclose(a.z, b.z) and abs(a.p_value - b.p_value) < 1e-6
    slopes = [(AIRLINE[j] - AIRLINE[i]) / (j - i) for i in range(48) for j in range(i + 1, 48)]
    assert math.isclose(one(trend.sens_slope(s)).slope, float(np.median(slopes)))
    u = [sum(np.sign(AIRLINE[i] - AIRLINE[j]) for i in range(t + 1, 48) for j in range(t + 1)) for t in range(48)]
    assert one(trend.pettitt(s)).k == max(map(abs, u))
    d = [np.sign(y - x) for x, y in zip(AIRLINE, AIRLINE[1:], strict=False) if y != x]
    pairs = [d[i] == d[j] for i in range(len(d)) for j in range(i)]
    assert math.isclose(one(trend.directional_consistency(s)).consistency, np.mean(pairs))


def test_changes_and_outliers_are_found(spark):
    rng = np.random.default_rng(3)
    x = np.append(rng.normal(size=60), 6 + rng.normal(size=60))
    s = make(spark, x)
    assert any(abs(r.idx - 59) <= 1 for r in stationarity.pelt(s).collect())
    assert any(abs(r.idx - 60) <= 1 for r in stationarity.binary_segmentation(s).collect())
    assert stationarity.cusum_changepoints(s).count() >= 1
    y = rng.normal(size=200)
    y[50], y[120] = 15, -12
    s = make(spark, y)
    for f in (anomaly.zscore, anomaly.modified_zscore, anomaly.iqr, lambda t: detectors_np.isolation_forest(t, 0.02), lambda t: detectors_np.local_outlier_factor(t, 10, 0.02), lambda t: detectors_np.dbscan(t, 1.0, 3)):
        assert {50, 120} <= {r.idx for r in f(s).collect()}
    assert anomaly.detect(s).count() <= 10


def test_temporal_iqr_decides_by_its_score(spark):
    """A value on the fence: the score is a last place above 0, the fence itself no different from the value."""
    before = [22.43, 14.27, 99.26, 21.95, 99.09, 33.92, 80.69, 13.1, 29.94, 101.59, 50.38, 7.53, 19.07, 77.63, 8.74, 8.87, 49.72, 33.46, 71.39, 116.32]
    (r,) = anomaly.temporal_iqr(make(spark, [*before, 173.12]), 20).collect()
    assert r.idx == 20 and 0 < r.score < 1e-12 and r.severity == "low"


@pytest.mark.parametrize("k,run", [(10, 1), (3, 50), (200, 64)])
def test_local_outlier_factor_in_runs(spark, monkeypatch, k, run):
    """Factors of runs are those of the whole series: ties, ends, series shorter than k, too short ones and one without a name."""
    monkeypatch.setattr(detectors_np, "RUN", run)
    rng = np.random.default_rng(12)
    named = {"long": rng.exponential(50, 400).round(2), "ties": rng.integers(0, 9, 300).astype(float), "seven": rng.normal(size=7), "two": np.array([1.0, 5.0]), None: rng.normal(size=40)}
    rows = [(key, i, float(v)) for key, x in named.items() for i, v in enumerate(x)]
    found = detectors_np.local_outlier_factor(spark.createDataFrame(rows, "series_id string, idx long, value double").repartition(5), k, 0.1).collect()
    for key, x in named.items():
        got = sorted((r.idx, r.score) for r in found if r.series_id == key)
        if len(x) < 3:
            assert not got
            continue
        order = np.argsort(x, kind="stable")
        y, few = x[order], min(k, len(x) - 1)
        # the nearest others, of equal distances those of lower values, of equal values the nearer places
        near = np.array([sorted((i for i in range(len(y)) if i != j), key=lambda i: (abs(y[i] - y[j]), i > j, abs(i - j)))[:few] for j in range(len(y))])
        dist = np.abs(y[near] - y[:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            lrd = 1 / np.maximum(dist[:, -1][near], dist).mean(1)
            lof = np.nan_to_num(lrd[near].mean(1) / lrd, nan=1.0, posinf=np.finfo(float).max)
        want = sorted(zip(order.tolist(), lof.tolist(), strict=True), key=lambda r: (-round(r[1], 9), r[0]))[: math.ceil(len(x) * 0.1)]
        assert np.allclose([v for _, v in got], [v for _, v in sorted(want)]) and [i for i, _ in got] == [i for i, _ in sorted(want)]


def test_cusum_window_form_is_the_recursion(spark):
    x = np.random.default_rng(4).normal(size=50)
    m, sd, up, want = x.mean(), x.std(), 0.0, []
    for v in x:
        up = max(0.0, up + v - m - 0.5 * sd)
        want.append(up)
    assert np.allclose([r.up for r in stationarity.cusum(make(spark, x)).orderBy("idx").collect()], want)


def test_kpss_matches_numpy(spark):
    x = np.random.default_rng(5).normal(size=60).cumsum()
    r = x - x.mean()
    q = int(4 * (60 / 100) ** (2 / 9))
    lrv = (r @ r + 2 * sum((1 - k / (q + 1)) * (r[k:] @ r[:-k]) for k in range(1, q + 1))) / 60
    assert math.isclose(one(stationarity.kpss(make(spark, x))).statistic, (np.cumsum(r) ** 2).sum() / 60**2 / lrv)


def test_hodrick_prescott_is_the_exact_solution(spark):
    x = np.random.default_rng(6).normal(size=40).cumsum()
    d = np.diff(np.eye(40), 2, axis=0)
    want = np.linalg.solve(np.eye(40) + 100 * d.T @ d, x)
    assert np.allclose([r.trend for r in detectors_np.hodrick_prescott(make(spark, x), 100).orderBy("idx").collect()], want)


def test_forecasts(spark):
    s = make(spark, [10 + 2 * i for i in range(30)])
    assert np.allclose([r.forecast for r in forecasting.linear(s, 3).orderBy("step").collect()], [70, 72, 74])
    assert [r.forecast for r in forecasting.moving_average(s, 2, 3).collect()] == [66.0, 66.0]
    dates = [r.ts for r in forecasting.linear(s, 2).orderBy("step").collect()]
    assert (dates[1] - dates[0]).total_seconds() == 3600
    season = make(spark, [1, 5, 9, 2] * 10)
    for name in ("seasonal_naive", "holt_winters"):
        assert np.allclose([r.forecast for r in forecasting.forecast(season, name, 4, period=4).orderBy("step").collect()], [1, 5, 9, 2], atol=0.2)
    for name in forecasting.FORECASTERS:
        assert forecasting.forecast(make(spark, AIRLINE), name, 5).count() == 5
    m = one(forecasting.metrics(forecasting.holdout(s, "linear", 5), s))
    assert m.mae < 1e-9 and m.n == 5 and m.mase < 1e-9


def test_correlations(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=60)
    y = 0.6 * x + rng.normal(size=60)
    s = make(spark, x, "a").unionByName(make(spark, y, "b"))
    r = one(correlation.correlation_matrix(s))
    assert math.isclose(r.r, np.corrcoef(x, y)[0, 1]) and r.ci_low < r.r < r.ci_high
    ranks = lambda v: np.argsort(np.argsort(v))
    assert math.isclose(one(correlation.correlation_matrix(s, "spearman")).r, np.corrcoef(ranks(x), ranks(y))[0, 1])
    tau = np.mean([np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(60) for j in range(i)])
    assert math.isclose(one(correlation.kendall_tau(s)).tau, tau)
    pairs = correlation.pair_up(s).withColumn("key", F.lit("k"))
    for method, want in (("kendall", lambda a, b: np.mean([np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i in range(10) for j in range(i)])), ("spearman", lambda a, b: np.corrcoef(ranks(a), ranks(b))[0, 1])):
        got = {q.idx: q.r for q in correlation.rolling_correlation(pairs, 10, method).collect()}
        assert len(got) == 51 and math.isclose(got[30], want(x[21:31], y[21:31]))


def test_johansen_against_regressions(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=(200, 7)).cumsum(0)
    y[:, 1] = y[:, 0] + rng.normal(size=200)
    s = make(spark, y[:, 0], "v0")
    for i in range(1, 7):
        s = s.unionByName(make(spark, y[:, i], f"v{i}"))
    d = np.diff(y, axis=0)
    z0, z1, z2 = d[1:], y[1:-1], np.hstack([np.ones((198, 1)), d[:-1]])
    r0, r1 = (z - z2 @ np.linalg.lstsq(z2, z, rcond=None)[0] for z in (z0, z1))
    m = np.linalg.solve(r1.T @ r1, r1.T @ r0) @ np.linalg.solve(r0.T @ r0, r0.T @ r1)
    got = multivariate.johansen(s).orderBy("rank").collect()
    assert np.allclose([r.eigenvalue for r in got], sorted(np.linalg.eigvals(m).real, reverse=True), atol=1e-8)
    assert got[0].rejected is None and got[0].critical_5 is None and got[1].critical_5 == 95.75 and got[1].rejected is not None


def test_median_slope_counts_pairs(spark):
    rng = np.random.default_rng(5)
    for z in (rng.normal(size=257), rng.integers(0, 4, 100), np.zeros(9), np.array([1.0])):
        assert detectors_np.rising_pairs(z) == sum(int((z[i + 1 :] > z[i]).sum()) for i in range(len(z)))
    for x in (rng.normal(size=120).cumsum() + 1e6, rng.integers(0, 5, 61).astype(float), np.full(7, 3.0), np.array([2.0, 5.0]), -np.arange(40.0)):
        slopes = [(x[j] - x[i]) / (j - i) for i in range(len(x)) for j in range(i + 1, len(x))]
        assert math.isclose(one(trend.sens_slope(make(spark, x))).slope, float(np.median(slopes)), rel_tol=1e-8, abs_tol=1e-12)
    assert trend.sens_slope(make(spark, [4.0])).count() == 0


def test_patterns_and_moments(spark):
    x = [math.sin(2 * math.pi * i / 12) for i in range(240)]
    found = {r.period: r.confidence for r in correlation.seasonal_patterns(correlation.autocorrelation(make(spark, x), 52)).collect()}
    assert found[12] == found[24] == 0.8
    assert one(stationarity.optimal_lag(stationarity.partial_autocorrelation(make(spark, x)))).optimal_lag == 1
    v = np.array([1.0, 2, 2, 3, 9])
    z = (v - v.mean()) / v.std()
    r = one(descriptive.standardized_moments(make(spark, v)))
    assert math.isclose(r.skewness, 5 / 12 * (z**3).sum()) and math.isclose(r.kurtosis, 30 / 24 * (z**4).sum() - 48 / 6)
    for odd in ([4.0] * 6, [1.0, 2.0]):
        r = one(descriptive.standardized_moments(make(spark, odd)))
        assert r.skewness == 0 and r.kurtosis == 0


def test_causality_and_systems(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=300)
    y = np.append(0, 0.9 * x[:-1]) + 0.2 * rng.normal(size=300)
    s = make(spark, x, "x").unionByName(make(spark, y, "y"))
    g = {(r.cause, r.effect): r.is_significant for r in multivariate.granger(s, 2).collect()}
    assert g["x", "y"] and len(g) == 2
    assert math.isclose(multivariate.f_tail(4.0, 1, 10), multivariate.t_tail(2.0, 10)) and abs(multivariate.t_tail(2.228, 10) - 0.05) < 1e-4
    assert multivariate.var_forecast(s, 1, 3).count() == 6
    shares = multivariate.impulse_responses(s, 1, 3).groupBy("response", "step").agg(F.sum("fevd").alias("t")).collect()
    assert all(abs(r.t - 1) < 1e-9 for r in shares)
    want, y2 = [], np.column_stack([x, y])
    z = np.hstack([np.ones((298, 1)), y2[1:-1], y2[:-2]])
    b = np.linalg.lstsq(z, y2[2:], rcond=None)[0]
    past = [*y2]
    for _ in range(3):
        past.append(np.concatenate([[1], past[-1], past[-2]]) @ b)
        want += list(past[-1])
    got = multivariate.var_forecast(s, 2, 3).orderBy("step", "series_id").collect()
    assert np.allclose([r.forecast for r in got], want, atol=1e-9)
    e = y2[2:] - z @ b
    irf = {(r.impulse, r.response): r.irf for r in multivariate.impulse_responses(s, 2, 1).where("step = 0").collect()}
    chol = np.linalg.cholesky(e.T @ e / 297)
    assert np.allclose([irf["x", "x"], irf["x", "y"], irf["y", "y"]], [chol[0, 0], chol[1, 0], chol[1, 1]])
    assert multivariate.var_forecast(s.where("idx < 1"), 2, 3).count() == 0 and multivariate.johansen(s.where("idx < 0")).count() == 0
    walk = rng.normal(size=300).cumsum()
    c = make(spark, walk, "a").unionByName(make(spark, 2 * walk + rng.normal(size=300), "b"))
    assert one(multivariate.engle_granger(c)).is_cointegrated
    assert multivariate.johansen(c).where("rank = 0").first().rejected
    pc = multivariate.principal_components(s).where("component = 1").collect()
    assert abs(sum(r.loading**2 for r in pc) - 1) < 1e-9


def test_warping():
    x, y = np.array([0.0, 1, 2, 1, 0]), np.array([0.0, 0, 1, 2, 1, 0])
    d, path = multivariate.warp(x, y)
    assert d == 0 and path[0] == (0, 0) and path[-1] == (4, 5)
    assert multivariate.warp(x, x, window=0)[0] == 0 and multivariate.warp(x, x + 1, itakura=2.0)[0] > 0
    assert abs(multivariate.soft_warp(x, x, 0.001)) < 0.01
    assert np.allclose(multivariate.barycenter([x, x]), x)


def test_calendar(spark):
    years = {1999: "1999-04-04", 2000: "2000-04-23", 2024: "2024-03-31", 2025: "2025-04-20", 2038: "2038-04-25"}
    df = spark.createDataFrame([(y,) for y in years], "y int").select("y", calendar.easter(F.col("y")).cast("string").alias("e"), calendar.thanksgiving(F.col("y")).cast("string").alias("t"))
    got = {r.y: (r.e, r.t) for r in df.collect()}
    assert {y: e for y, (e, _) in got.items()} == years and got[2024][1] == "2024-11-28" and got[2025][1] == "2025-11-27"
    day = spark.sql("SELECT DATE'2024-02-10' AS d").select(calendar.days_in_month(F.col("d")).alias("n"), calendar.working_days_in_month(F.col("d")).alias("w"), calendar.is_leap_year(F.year("d")).alias("l"))
    assert tuple(one(day)) == (29, 21, True)


def test_fills_and_smoothing(spark):
    s = make(spark, [None, 1.0, None, None, 4.0, math.inf, None])
    col = lambda df: [r.filled for r in df.orderBy("idx").collect()]
    assert col(windows.forward_fill(s)) == [None, 1, 1, 1, 4, 4, 4] and col(windows.backward_fill(s)) == [1, 1, 4, 4, 4, None, None]
    assert col(windows.linear_fill(s)) == col(windows.linear_fill(s, "ts")) == [None, 1, 2, 3, 4, None, None]
    t = make(spark, [1.0, 2.0, None, 4.0])
    assert [r.smooth for r in windows.ewma(t, 0.5).orderBy("idx").collect()] == [1, 1.5, 1.5, 2.75]
    assert col(windows.exponential_fill(t, 0.5)) == [1, 2, 1.5, 4]
    up = windows.upsample(make(spark, [0.0, 6.0]), "10 minutes").orderBy("idx").collect()
    assert [r.filled for r in up] == [0, 1, 2, 3, 4, 5, 6]


def test_quality(spark):
    good = one(quality.scores(make(spark, [50 + i % 20 for i in range(100)])))
    assert good.completeness == 100 and good.overall > 90 and good.passes
    values = [50 + i % 20 for i in range(100)]
    values[25], values[50], values[75] = 500, -100, 300
    s = make(spark, values).where("idx not between 30 and 32").select("series_id", "ts", "value")
    bad = one(quality.scores(series.with_index(s)))
    assert bad.overall < good.overall and bad.accuracy < 100 and one(quality.profile(series.with_index(s))).n_gaps == 1
    assert quality.recommendations(quality.scores(series.with_index(s)), 99.5).count() >= 1
    cleaned = quality.clean(make(spark, values), outliers="remove")
    assert cleaned.agg(F.max("value")).first()[0] < 100


def test_scale_and_shift_invariance(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=40)
    a, b = one(descriptive.describe(make(spark, x))), one(descriptive.describe(make(spark, 3 * x + 7)))
    assert math.isclose(b.variance, 9 * a.variance) and math.isclose(a.skewness, b.skewness) and a.min <= a.mean <= a.max and math.isclose(a.std**2, a.variance)
    assert {r.idx for r in anomaly.zscore(make(spark, x), 2).collect()} == {r.idx for r in anomaly.zscore(make(spark, 3 * x + 7), 2).collect()}


def test_seasonality(spark):
    s = make(spark, [math.sin(2 * math.pi * i / 12) + 0.01 * (i % 5) for i in range(240)])
    assert one(seasonality.auto_period(s)).period == 12
    top = seasonality.periodogram(s, 2, 30).orderBy(F.desc("power")).first()
    assert top.period == 12 and top.is_peak
    assert one(seasonality.seasonal_strength(s, 12)).strength > 0.95 and one(seasonality.pattern_consistency(s, 12)).consistency > 0.95
    assert seasonality.fourier(s).orderBy(F.desc("power")).first().k == 20
    factors = seasonality.adjust_x13(make(spark, AIRLINE), 12).select("idx", "factor").where("idx < 12").collect()
    assert abs(np.mean([r.factor for r in factors]) - 1) < 1e-9
    assert seasonality.consolidate([(12, 0.9), (12.5, 0.5), (7, 0.3), (3, 0.05)]) == [(12, 0.9), (7, 0.3)] and seasonality.period_relations([7, 365, 14]) == [(7, 14)] + [(7, 365)] * (abs(365 / 7 - 52) < 0.1) + [(14, 365)] * (abs(365 / 14 - 26) < 0.1)


def test_merged_anomalies_are_compared_with_the_one_held(spark):
    from tidegauge.operators import anomaly

    rows = [("a", i, s) for i, s in ((0, 5.0), (3, 1.0), (6, 2.0), (8, 2.0), (20, 1.0), (22, 4.0), (25, 4.5))]
    base = anomaly.zscore(spark.createDataFrame([("a", "2024-01-01", 0, 1.0)], "series_id string, d string, idx long, value double").selectExpr("series_id", "cast(d as timestamp_ntz) ts", "idx", "value"), 1.0)
    found = spark.createDataFrame(rows, "series_id string, idx long, score double")
    found = found.select(*[f.name if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in base.select(*anomaly.COLUMNS).schema])
    assert sorted((r.idx, r.score) for r in anomaly.merge_nearby(found, 3).collect()) == [(0, 5.0), (6, 2.0), (25, 4.5)]


def test_variance_changes_keep_their_distance(spark):
    from tidegauge.operators import series as s, stationarity

    rows = [("a", i, float((-1) ** i * (1 if i // 40 % 2 else 20))) for i in range(200)]
    df = s.with_index(spark.createDataFrame(rows, "series_id string, i long, value double").selectExpr("series_id", "timestamp_seconds(i) ts", "value"))
    got = sorted(r.idx for r in stationarity.variance_changes(df).collect())
    everything = sorted(r.idx for r in stationarity.variance_changes(df, min_distance=1).collect())
    want = []
    for i in everything:
        if not want or i >= want[-1] + 10:
            want.append(i)
    assert got == want and len(everything) > len(got) > 3
