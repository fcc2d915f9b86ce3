"""Search and alignment under warping against plain dynamic programming."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import multivariate, warping


def plain(x, y, band):
    c = np.full((len(x) + 1, len(y) + 1), np.inf)
    c[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(y)):
            if abs(i - j) <= band:
                c[i + 1, j + 1] = abs(x[i] - y[j]) + min(c[i, j], c[i, j + 1], c[i + 1, j])
    return c[-1, -1]


def test_bounds_and_distances():
    rng = np.random.default_rng(1)
    for n, m, w in ((1, 1, 0), (1, 7, 0), (7, 1, 3), (20, 20, 0), (20, 20, 3), (31, 24, 2), (24, 31, 50), (40, 40, 5)):
        for _ in range(5):
            x, y = rng.normal(size=n).cumsum(), rng.normal(size=m).cumsum()
            band = max(w, abs(n - m))
            d = plain(x, y, band)
            assert abs(warping.banded(x, y, band) - d) < 1e-9 and warping.lower_bound(x, y, band) <= d + 1e-9
            assert warping.banded(x, y, band, d * 0.5 - 1e-9) in (np.inf, d) and abs(warping.banded(x, y, band, d + 1e-9) - d) < 1e-9
            low, high = warping.envelope(y, n, band)
            for i in range(n):
                near = y[max(0, i - band) : i + band + 1]
                assert low[i] == near.min() and high[i] == near.max()
            got, path = warping.path_of(x, y, band)
            assert abs(got - d) < 1e-9 and abs(np.abs(x[path[:, 0]] - y[path[:, 1]]).sum() - d) < 1e-9 and tuple(path[0]) == (0, 0) and tuple(path[-1]) == (n - 1, m - 1)
            assert set(map(tuple, np.diff(path, axis=0))) <= {(1, 1), (0, 1), (1, 0)}


def frame(spark, named):
    rows = [(k, i, None if v is None else float(v)) for k, x in named.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, idx long, value double").repartition(4)


def test_many_at_once():
    rng = np.random.default_rng(9)
    x, ys = rng.normal(size=17), [rng.normal(size=n) for n in (1, 5, 17, 30)]
    bands = [max(2, abs(17 - len(y))) for y in ys]
    assert np.allclose(warping.banded_many(x, ys, bands), [plain(x, y, b) for y, b in zip(ys, bands, strict=True)])


@pytest.mark.parametrize("window,block,long", [(3, 16, 1 << 18), (None, 64, 0)])
def test_nearest_equals_brute_force(spark, window, block, long, monkeypatch):
    monkeypatch.setattr(warping, "BLOCK", block)
    monkeypatch.setattr(warping, "LONG", long)
    monkeypatch.setattr(warping, "AT_ONCE", 2)
    rng = np.random.default_rng(2)
    named = {f"s{i:02d}": rng.normal(size=int(rng.integers(5, 25))).cumsum() + 3 * (i % 5) for i in range(30)}
    named["copy"] = named["s03"].copy()
    named |= {"none": [None, None], "holes": [None, *named["s04"], None]}
    xs = {k: np.array([v for v in x if v is not None], float) for k, x in named.items() if k != "none"}
    rows = warping.nearest(frame(spark, named), 3, window).collect()
    got = {(r.series_id, r["rank"]): (r.other, round(r.distance, 9)) for r in rows}
    for q, x in xs.items():
        want = sorted((round(plain(x, y, max(window if window is not None else 99, abs(len(x) - len(y)))), 9), o) for o, y in xs.items() if o != q)[:3]
        assert [got[q, i + 1][1] for i in range(3)] == [d for d, _ in want]
        assert got[q, 1][0] == want[0][1]
    assert len(got) == 3 * len(xs) and got["copy", 1] == ("s03", 0)
    assert all(r.tried + r.pruned == len(xs) - 1 for r in rows)
    assert warping.nearest(frame(spark, named).limit(0), 2).count() == 0


def test_pairs_at_once_are_the_pairs(monkeypatch):
    """Bounds and distances of many pairs of unequal lengths, also given up or without the columns."""
    rng = np.random.default_rng(11)
    xs = [rng.normal(size=int(k)).cumsum() for k in [1, 2, 90, *rng.integers(3, 60, 20)]]
    n = np.array([len(x) for x in xs])
    a, b = np.triu_indices(len(xs), 1)
    x, _ = warping._columns(xs)
    for window, pairs in ((0, 1024), (3, 7), (200, 50)):
        monkeypatch.setattr(warping, "PAIRS", pairs)
        bands = np.maximum(window, np.abs(n[a] - n[b]))
        want = np.array([plain(xs[i], xs[j], w) for i, j, w in zip(a, b, bands, strict=True)])
        assert np.allclose(warping._bounds(xs, x, n, a, b, bands), [warping.lower_bound(xs[i], xs[j], w) for i, j, w in zip(a, b, bands, strict=True)])
        assert (warping._bounds(xs, None, n, a, b, bands) <= want + 1e-9).all()
        for columns in (x, None):
            assert np.allclose(warping._distances(xs, columns, n, a, b, bands, np.full(len(a), np.inf)), want)
            got = warping._distances(xs, columns, n, a, b, bands, np.full(len(a), np.median(want)))
            assert np.allclose(got[want <= np.median(want)], want[want <= np.median(want)]) and (np.isinf(got) | np.isclose(got, want)).all() and np.isinf(got).any()


def test_nearest_of_many_series_is_quick(spark):
    """A quarter of a million warpings, which took minutes one by one."""
    s = spark.range(700 * 40).select((F.col("id") % 700).cast("string").alias("series_id"), F.floor(F.col("id") / 700).alias("idx"), (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 100).alias("value"))
    start = time.monotonic()
    rows = warping.nearest(s, 3, 3).collect()
    assert time.monotonic() - start < 60
    assert len(rows) == 2100 and all(r.tried + r.pruned == 699 for r in rows)
    xs = {}
    for r in s.orderBy("idx").collect():
        xs.setdefault(r.series_id, []).append(r.value)
    xs = {k: np.array(x) for k, x in xs.items()}
    for q in ("0", "333"):
        want = sorted((warping.banded(xs[q], y, 3), o) for o, y in xs.items() if o != q)[:3]
        assert [(r.distance, r.other) for r in sorted(rows, key=lambda r: r["rank"]) if r.series_id == q] == want


def test_bounds_spare_warpings(spark):
    rng = np.random.default_rng(7)
    named = {f"s{i:03d}": rng.normal(size=40) * 0.3 + 4 * (i % 8) for i in range(60)}
    rows = warping.nearest(frame(spark, named), 2, 2).where("rank = 1").collect()
    assert all(int(r.series_id[1:]) % 8 == int(r.other[1:]) % 8 for r in rows)
    assert sum(r.pruned for r in rows) > 0.5 * sum(r.tried + r.pruned for r in rows)


def test_ranking_and_quality(spark):
    t = np.arange(60)
    named = {"q": np.sin(t / 5), "same": np.sin(t / 5), "late": np.sin((t - 4) / 5), "other": np.cos(t / 2) * 3, "short": np.sin(np.arange(0, 60, 2) / 5)}
    rows = {r.series_id: r for r in warping.ranking(frame(spark, named), "q", 10).collect()}
    assert set(rows) == {"same", "late", "other", "short"} and rows["same"]["rank"] == 1 and rows["other"]["rank"] == 4
    assert (rows["same"].distance, rows["same"].score, rows["same"].diagonal) == (0, 100, 1) and rows["late"].score < 100 and rows["same"].confidence > 0 and rows["late"].confidence is None
    d, path = warping.path_of(named["q"], named["short"], 30)
    q, steps = warping.quality(path, 60, 30), np.diff(path, axis=0)
    distortion = sum(abs((a / b if b else 2.0) - 2.0) for a, b in steps) / len(path)
    assert np.isclose(q["distortion"], distortion) and np.isclose(q["efficiency"], 60 / len(path)) and np.isclose(q["score"], min(100, 40 * q["efficiency"] + 30 * (1 - min(1, distortion)) + 30 * q["diagonal"]))
    assert warping.ranking(frame(spark, named), "missing").count() == 0


def test_distances_by_sums(spark):
    rng = np.random.default_rng(3)
    named = {"a": rng.normal(size=40), "b": rng.normal(size=40) + 1, "c": rng.normal(size=25), "zero": np.zeros(40)}
    s = frame(spark, named)
    for m in ("euclidean", "manhattan", "cosine"):
        got = {(r.var1, r.var2): r.distance for r in multivariate.pairwise_distances(s, m).collect()}
        assert len(got) == 6
        for (p, q), d in got.items():
            k = min(len(named[p]), len(named[q]))
            x, y = named[p][:k], named[q][:k]
            want = {"euclidean": np.linalg.norm(x - y), "manhattan": np.abs(x - y).sum(), "cosine": 1 - x @ y / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-300)}[m]
            assert abs(d - want) < 1e-9
    plan = multivariate.pairwise_distances(s, "euclidean")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Python" not in plan


def test_tau_counts_pairs(spark):
    from tidegauge.operators.correlation import kendall_tau

    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 9, 120), rng.integers(0, 5, 120)
    got = kendall_tau(frame(spark, {"x": x, "y": y, "z": y[:1]})).collect()
    want = np.sign(np.subtract.outer(x, x) * np.subtract.outer(y, y)).sum() / (120 * 119)
    assert [(r.var1, r.var2) for r in got] == [("x", "y")] and abs(got[0].tau - want) < 1e-12


def test_spectrum_and_long_lags(spark):
    from tidegauge.operators import correlation, seasonality

    x = np.random.default_rng(5).normal(size=401).cumsum()
    s = frame(spark, {"x": x})
    rows = {r.k: r for r in seasonality.fourier(s).collect()}
    t, d = np.arange(401), x - x.mean()
    assert len(rows) == 200
    for k in (1, 7, 200):
        power = abs((d * np.exp(-2j * np.pi * k * t / 401)).sum()) ** 2 / 401
        assert abs(rows[k].power - power) < 1e-9 * max(1, power) and abs(rows[k].share - 2 * power / (d @ d)) < 1e-9
    assert abs(sum(r.share for r in rows.values()) - 1) < 1e-9
    short = {r.lag: (r.acf, r.bound, r.ljung_box) for r in correlation.autocorrelation(s, 60).collect()}
    long = {r.lag: (r.acf, r.bound, r.ljung_box) for r in correlation.autocorrelation(s, 1000).collect()}
    assert len(long) == 401 and all(np.allclose(short[k], long[k], atol=1e-9) for k in short)
    assert abs(long[300][0] - (d[300:] @ d[:101]) / (d @ d)) < 1e-9


def test_weekly_period_is_found_at_any_length(spark):
    from tidegauge.plans import compose

    n = 5000
    x = 10 * np.sin(2 * np.pi * np.arange(n) / 7) + np.random.default_rng(6).normal(size=n)
    s = frame(spark, {"x": x}).withColumn("ts", F.timestamp_seconds("idx"))
    rows = {r.period: r.n_methods for r in compose.combined_periods(s).collect()}
    assert rows[7.0] == 3 and max(rows.values()) == 3
