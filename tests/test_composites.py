"""Dispatchers and composites, and windows that follow a series' length."""

import numpy as np
import pytest

from tidegauge.operators import anomaly, descriptive, trend
from tidegauge.plans import compose


@pytest.fixture(scope="module")
def named():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=300)
    return {"noise": noise, "walk": np.cumsum(rng.normal(size=300)), "rise": np.arange(300) * 0.05 + noise, "shift": noise + np.where(np.arange(300) < 150, 0, 8.0), "few": noise[:12]}


@pytest.fixture(scope="module")
def frame(spark, named):
    rows = [(k, i, float(v)) for k, x in named.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, idx long, value double").selectExpr("*", "timestamp_seconds(idx) ts")


def test_dispatchers(frame):
    got = {(r.series_id, r.test): r.is_stationary for r in compose.stationarity_test(frame, "all").collect()}
    assert {t for _, t in got} == {"adf", "kpss", "pp"} and all(got["noise", t] for t in ("adf", "kpss", "pp")) and not any(got["walk", t] for t in ("adf", "kpss", "pp"))
    one = compose.stationarity_test(frame, "pp")
    assert {r.test for r in one.collect()} == {"pp"}
    with pytest.raises(KeyError):
        compose.stationarity_test(frame, "other")
    d = {(r.series_id, r.test): r.direction for r in compose.trend_test(frame, "all").collect()}
    assert d["rise", "mann_kendall"] == d["rise", "linear"] == "increasing" and d["noise", "mann_kendall"] == d["noise", "linear"] == "none"


def test_correlation_analysis(frame, named):
    rows = {(r.var1, r.var2): r for r in compose.correlation_analysis(frame, 0.3, 2).collect()}
    r = rows["noise", "rise"]
    assert abs(r.pearson - np.corrcoef(named["noise"], named["rise"])[0, 1]) < 1e-9 and abs(r.kendall) <= 1 and len(rows) == 10
    up = sorted((x for x in rows.values() if x.pearson >= 0), key=lambda x: -x.pearson)
    assert [x.place for x in up] == [1, 2] + [None] * (len(up) - 2)


def around(x, i, w, gap):
    b, a = x[i - w : i], x[i + gap : i + gap + w]
    return b.mean(), b.var(), a.mean(), a.var()


def test_windows_follow_the_length(frame, named):
    shifts = {(r.series_id, r.idx): r.score for r in anomaly.level_shift(frame, 2.0).collect()}
    breaks = {(r.series_id, r.idx): (r.score, r.kind) for r in trend.breakpoints(frame, 0.5).collect()}
    want_shifts, want_breaks = {}, {}
    for k, x in named.items():
        w = max(5, min(20, len(x) // 10))
        for i in range(w, len(x) - w):
            m0, v0, m1, v1 = around(x, i, w, 1)
            s = abs(m1 - m0) / max((np.sqrt(v0) + np.sqrt(v1)) / 2, 0.001)
            if s > 2:
                want_shifts[k, i] = s
            m0, v0, m1, v1 = around(x, i, w, 0)
            s = abs(m1 - m0) / np.sqrt((v0 + v1) / w) / 3
            if s > 0.5:
                want_breaks[k, i] = (s, "variance" if v1 > 1.5 * v0 else "level")
    assert shifts.keys() == want_shifts.keys() and all(abs(shifts[k] - v) < 1e-6 * v for k, v in want_shifts.items())
    assert breaks.keys() == want_breaks.keys() and all(abs(breaks[k][0] - v) < 1e-6 * max(1, v) and breaks[k][1] == kind for k, (v, kind) in want_breaks.items())
    assert ("shift", 150) in shifts


def test_normality_has_a_row_for_each_length(spark):
    rng = np.random.default_rng(2)
    x = {"long": rng.normal(size=6000), "short": rng.normal(size=100), "tiny": rng.normal(size=7)}
    s = spark.createDataFrame([(k, i, float(v)) for k, y in x.items() for i, v in enumerate(y)], "series_id string, idx long, value double")
    got = {r.series_id: (r.test, r.is_normal) for r in descriptive.normality(s).collect()}
    assert got == {"long": ("kolmogorov_smirnov", True), "short": ("shapiro_wilk", True)}
    assert {r.series_id for r in descriptive.shapiro_wilk(s).collect()} == {"long", "short"}
