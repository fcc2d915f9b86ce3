"""Breaks, alarms and outliers at planted places, and the figures against direct computation."""

import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators import breaks


def frame(spark, named):
    rows = [(k, i, float(v)) for k, x in named.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, idx long, value double").withColumn("ts", F.timestamp_seconds(F.col("idx") * 86_400))


def waves(n, seed, change=None, at=None, noise=1.0):
    t = np.arange(n)
    x = 10 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(seed).normal(size=n) * noise
    if change == "amplitude":
        x[at:] += 10 * np.sin(2 * np.pi * t[at:] / 7)
    if change == "phase":
        x[at:] += 10 * np.sin(2 * np.pi * (t[at:] + 2) / 7) - 10 * np.sin(2 * np.pi * t[at:] / 7)
    if change == "level":
        x[at:] += 25
    if change == "shape":
        x[at:] += 4 * np.cos(4 * np.pi * t[at:] / 7)
    return x


def test_breaks_at_planted_places(spark):
    kinds = ("amplitude", "phase", "level", "shape")
    s = frame(spark, {"none": waves(560, 1), **{k: waves(560, 2 + i, k, 280) for i, k in enumerate(kinds)}, "short": waves(50, 9)})
    rows = breaks.seasonal_breaks(s, 7, alpha=0.001).collect()
    found = {}
    for r in rows:
        if r.is_break:
            found.setdefault(r.series_id, []).append((r.at, r.kind))
    assert found == {"amplitude": [(280, "amplitude")], "phase": [(280, "phase")], "shape": [(280, "shape")]}
    level = next(r for r in rows if r.series_id == "level" and r.at == 280)
    assert abs(level.level_shift - 25) < 1 and len([r for r in rows if r.series_id == "none"]) == 19 and not [r for r in rows if r.series_id == "short"]
    turn = next(r.phase_shift for r in rows if r.series_id == "phase" and r.at == 280)
    assert abs(abs(turn) - 2 * np.pi * 2 / 7) < 0.1


def test_f_statistic_is_that_of_two_regressions(spark):
    x = waves(84, 5)
    for period, cycles, most in ((7, 3, 3), (6, 4, 3), (4, 5, 2)):
        width = period * cycles
        rows = breaks.seasonal_breaks(frame(spark, {"a": x}), period, cycles, most).orderBy("w").collect()
        assert len(rows) == 84 // width - 1
        for r in rows:
            a, b = x[(r.w - 1) * width : r.w * width], x[r.w * width : (r.w + 1) * width]
            t = np.arange(width)
            cols = [f(2 * np.pi * h * t / period) for h in range(1, min(most, period // 2) + 1) for f in (np.cos, np.sin) if not (2 * h == period and f is np.sin)]
            d, one = np.column_stack(cols), np.ones((width, 1))
            rss = lambda z, y: ((y - z @ np.linalg.lstsq(z, y, rcond=None)[0]) ** 2).sum()
            apart = rss(np.hstack([one, d]), a) + rss(np.hstack([one, d]), b)
            both = np.hstack([np.kron(np.eye(2), one), np.vstack([d, d])])
            together = rss(both, np.concatenate([a, b]))
            k = d.shape[1]
            assert abs(r.f - (together - apart) / k / (apart / (2 * width - 2 * k - 2))) < 1e-6 * max(1, r.f)


def test_cusum_of_a_phase_begins_anew(spark):
    x = waves(70 * 7, 6, noise=1.0)
    x[40 * 7 + 3 :: 7] += 3.0  # one phase drifts from its 40th cycle on
    rows = breaks.phase_cusum(frame(spark, {"a": x, "b": x[:49]}), 7, first=20).collect()
    hits = sorted(r.cycle for r in rows if r.phase == 3)
    assert 40 <= hits[0] <= 43 and len(hits) >= 5 and all(r["sum"] > 5 for r in rows if r.phase == 3) and {r.series_id for r in rows} == {"a"}
    z = (x[3::7] - x[3 : 140 : 7].mean()) / x[3 : 140 : 7].std(ddof=1)
    up = down = 0.0
    want = []
    for c, v in enumerate(z):
        up, down = max(0, up + v - 0.5), max(0, down - v - 0.5)
        if max(up, down) > 5:
            want.append(c)
            up = down = 0.0
    assert hits == want


def test_stability_evolution_and_outliers(spark):
    x = waves(300, 7)
    x[150] += 60
    x[151] += 300
    y = np.concatenate([np.full(100, 10.0), np.full(100, 30.0)])
    s = frame(spark, {"x": x, "y": y, "tiny": x[:10]})
    got = {r.series_id: r for r in breaks.pattern_stability(s).collect()}
    v = np.array([x[i : i + 60].var() for i in range(240)])
    assert set(got) == {"x", "y"} and got["x"].windows == 240 and np.isclose(got["x"].mean_variance, v.mean()) and np.isclose(got["x"].stability, 1 / (1 + v.var() / v.mean()))
    ev = {r.series_id: r for r in breaks.pattern_evolution(s).collect()}
    w, changes, before = 20, 0, y[:20].mean()
    for i in range(w, 200 - w):
        mean = y[i - w // 2 : i + w // 2].sum() / w
        changes += abs(mean - before) > 0.1 * np.abs(y).mean()
        before = mean
    assert ev["y"].changes == changes and ev["y"].trend == ("stable" if changes / 200 < 0.01 else "shifting") and set(ev) == {"x", "y"}
    out = {(r.idx, r.kind) for r in breaks.outlier_points(s, 7).where("series_id = 'x'").collect()}
    assert (151, "innovation") in out or (151, "additive") in out
    means = np.array([x[p::7].mean() for p in range(7)])
    assert {i for i, _ in out} == set(np.flatnonzero(np.abs(x - means[np.arange(300) % 7]) > 2 * x.std()).tolist())


def test_bond_of_trend_and_season(spark):
    t = np.arange(700)
    level = 50 + t * 0.2
    s = frame(spark, {"up": level + level * 0.2 * np.sin(2 * np.pi * t / 7), "down": level + (200 - level) * 0.2 * np.sin(2 * np.pi * t / 7)})
    rows = {(r.series_id, r.period): r for r in breaks.trend_interaction(s, [7, 400]).collect()}
    assert set(rows) == {("up", 7), ("down", 7)} and rows["up", 7].kind == "amplifying" and rows["down", 7].kind == "dampening" and rows["up", 7].cycles == 100
