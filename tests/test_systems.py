"""Error correction, diagnostics, common trends and factors on simulated systems and against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import systems
from tidegauge.operators.systems import chi2_tail


def frame(spark, named):
    rows = [(k, i, float(v)) for k, x in named.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, idx long, value double").repartition(5)


def cointegrated(n, seed):
    """y follows 2 x + 3 and is pulled back by 0.4; x is a random walk that nothing pulls."""
    rng = np.random.default_rng(seed)
    x, y = np.zeros(n), np.zeros(n)
    y[0] = 3
    for t in range(1, n):
        x[t] = x[t - 1] + rng.normal()
        y[t] = y[t - 1] - 0.4 * (y[t - 1] - 2 * x[t - 1] - 3) + 0.3 * (x[t] - x[t - 1]) + rng.normal() * 0.5
    return {"x": x, "y": y}


def test_tails():
    for x, df, p in ((3.841459, 1, 0.05), (18.307038, 10, 0.05), (124.342113, 100, 0.05), (0.0, 4, 1.0), (6.634897, 1, 0.01), (2.0, 2, np.exp(-1))):
        assert abs(chi2_tail(x, df) - p) < 1e-6


def parts(df):
    return {(r.part, r.equation, r.term, r.lag): r.value for r in df.collect()}


def test_vecm_on_a_cointegrated_pair(spark):
    d = cointegrated(2000, 1)
    got = parts(systems.vecm(frame(spark, d), lags=1))
    assert got["model", "", "rank", 0] == 1 and got["model", "", "n", 0] == 1998
    assert got["beta", "x", "ec1", 0] == 1 and abs(got["beta", "y", "ec1", 0] + 0.5) < 0.01
    # y moves by -0.4 (y - 2 x) = 0.8 (x - y / 2); x doesn't
    assert abs(got["alpha", "y", "ec1", 0] - 0.8) < 0.1 and abs(got["alpha", "x", "ec1", 0]) < 0.1
    assert got["model", "", "largest_root", 0] < 1
    # given beta, all else is least squares of the changes
    x, y = d["x"], d["y"]
    dx, dy = np.diff(x), np.diff(y)
    ec = x + got["beta", "y", "ec1", 0] * y
    design = np.column_stack([np.ones(1998), ec[1:-1], dx[:-1], dy[:-1]])
    residuals = []
    for name, target in (("x", dx[1:]), ("y", dy[1:])):
        b = np.linalg.lstsq(design, target, rcond=None)[0]
        want = [got["intercept", name, "", 0], got["alpha", name, "ec1", 0], got["gamma", name, "x", 1], got["gamma", name, "y", 1]]
        assert np.abs(b - want).max() < 1e-6
        residuals.append(target - design @ b)
        assert abs(got["r2", name, "", 0] - (1 - residuals[-1].var() / target.var())) < 1e-6
    omega = np.cov(residuals, bias=True)
    loglik = -0.5 * 1998 * (2 * np.log(2 * np.pi) + np.linalg.slogdet(omega)[1] + 2)
    assert abs(got["model", "", "loglik", 0] - loglik) < 1e-5 and abs(got["model", "", "aic", 0] - (2 * (2 * 4 + 1) - 2 * loglik)) < 1e-5


def test_rank_of_unrelated_walks_is_zero(spark):
    rng = np.random.default_rng(5)
    d = {k: np.cumsum(rng.normal(size=800)) for k in "abc"}
    got = parts(systems.vecm(frame(spark, d)))
    assert got["model", "", "rank", 0] == 0 and not any(k[0] in ("alpha", "beta") for k in got)
    assert systems.vecm(frame(spark, d).limit(0)).count() == 0


def var_data(a, n, seed, heavy=False):
    rng = np.random.default_rng(seed)
    e = rng.standard_t(3, size=(n, 2)) if heavy else rng.normal(size=(n, 2)) @ np.array([[1, 0.4], [0, 1]])
    y = np.zeros((n, 2))
    for t in range(1, n):
        y[t] = np.array(a) @ y[t - 1] + e[t]
    return {"u": y[:, 0], "v": y[:, 1]}


def by_test(df):
    return {(r.test, r.equation): r for r in df.collect()}


def test_diagnostics_equal_direct_computation(spark):
    d = var_data([[0.5, 0.2], [0.1, 0.6]], 700, 2)
    got, h = by_test(systems.var_diagnostics(frame(spark, d), 1, 4)), 4
    y = np.column_stack([d["u"], d["v"]])
    z = np.column_stack([np.ones(699), y[:-1]])
    # all sums run over the points that have their lags 0 to p + h
    cut = slice(h, None)
    b = np.linalg.lstsq(z[cut], y[1:][cut], rcond=None)[0]
    e = y[1:] - z @ b
    n = len(e) - h
    c = [e[h:].T @ e[h - j : len(e) - j] / n for j in range(h + 1)]
    inv = np.linalg.inv(c[0])
    q = sum(n * n / (n - j) * np.trace(c[j].T @ inv @ c[j] @ inv) for j in range(1, h + 1))
    assert abs(got["portmanteau", ""].statistic - q) < 1e-6 * q and got["portmanteau", ""].df == 4 * 3 and got["portmanteau", ""].passed
    lb = n * (n + 2) * sum((c[j][0, 0] / c[0][0, 0]) ** 2 / (n - j) for j in range(1, h + 1))
    assert abs(got["ljung_box", "u"].statistic - lb) < 1e-6 * max(lb, 1)
    r = y[1:] - z @ np.linalg.lstsq(z, y[1:], rcond=None)[0]
    s = (r - r.mean(0)) / r.std(0)
    jb = len(r) / 6 * ((s**3).mean(0) ** 2 + ((s**4).mean(0) - 3) ** 2 / 4)
    assert np.allclose([got["normality", k].statistic for k in "uv"], jb) and got["normality", ""].df == 4 and got["normality", ""].passed
    assert got["stability", ""].passed and abs(got["stability", ""].statistic - 0.7) < 0.1


def test_flags_are_right_on_both_sides(spark):
    calm = by_test(systems.var_diagnostics(frame(spark, var_data([[0.5, 0], [0, 0.9]], 600, 3)), 1, 5))
    wild = by_test(systems.var_diagnostics(frame(spark, var_data([[0.5, 0], [0, 1.02]], 300, 3)), 1, 5))
    assert calm["stability", ""].passed and not wild["stability", ""].passed
    short = by_test(systems.var_diagnostics(frame(spark, cycle(600)), 1, 8))
    assert not short["portmanteau", ""].passed  # one lag doesn't take up a cycle
    heavy = by_test(systems.var_diagnostics(frame(spark, var_data([[0.5, 0], [0, 0.5]], 600, 4, True)), 1, 5))
    assert not heavy["normality", ""].passed and not heavy["normality", "u"].passed


def cycle(n):
    rng = np.random.default_rng(6)
    x = np.zeros((n, 2))
    for t in range(4, n):
        x[t] = 0.8 * x[t - 4] + rng.normal(size=2)
    return {"u": x[:, 0], "v": x[:, 1]}


def test_common_trends_split_each_point(spark):
    d = cointegrated(1500, 7)
    s = frame(spark, d)
    out = systems.common_trends(s, lags=1).collect()
    p = {(r.series_id, r.idx): (r.permanent, r.transitory) for r in out}
    assert len(out) == 3000 and all(abs(sum(p[r.series_id, r.idx]) - d[r.series_id][r.idx]) < 1e-9 for r in out)
    beta = parts(systems.vecm(s, lags=1))["beta", "y", "ec1", 0]
    px, py = (np.array([p[k, i][0] for i in range(1500)]) for k in "xy")
    ty = np.array([p["y", i][1] for i in range(1500)])
    assert np.abs(px + beta * py).max() < 1e-6 * np.abs(px).max()  # the permanent part keeps the balance
    assert ty.std() < 0.2 * py.std() and abs(np.corrcoef(np.diff(px), np.diff(d["x"]))[0, 1]) > 0.95  # the trend is x
    full = systems.common_trends(s, rank=2).select(F.max(F.abs("permanent"))).first()[0]
    assert full == 0


@pytest.fixture(scope="module")
def factors(spark):
    rng = np.random.default_rng(8)
    true = np.array([[0.9, 0], [0.8, 0], [0.7, 0.1], [0, 0.85], [0.1, 0.75], [0, 0.6]])
    f = rng.normal(size=(4000, 2))
    x = f @ true.T + rng.normal(size=(4000, 6)) * np.sqrt(1 - (true**2).sum(1))
    return true, f, frame(spark, {f"v{i}": 10 * i + (i + 1) * x[:, i] for i in range(6)})


def test_loadings_are_recovered_up_to_sign(factors):
    true, f, s = factors
    a = systems.factor_analysis(s, 2)
    rows = {(r.factor, r.series_id): r for r in a.collect()}
    load = np.array([[rows[k, f"v{i}"].loading for k in (1, 2)] for i in range(6)])
    order = [0, 1] if abs(load[0, 0]) > abs(load[0, 1]) else [1, 0]
    assert np.abs(load[:, order] - true).max() < 0.06
    assert all(abs(r.communality + r.uniqueness - 1) < 1e-4 for r in rows.values())
    z = np.array([[r.score for r in systems.factor_scores(s, a).where(f"factor = {order[0] + 1}").orderBy("idx").collect()]])
    assert abs(np.corrcoef(z, f[:, 0])[0, 1]) > 0.9
    with pytest.raises(Exception, match="fewer"):
        systems.factor_analysis(s, 6).collect()


def test_em_reaches_the_maximum():
    """No small change of loadings or variances raises the likelihood."""
    rng = np.random.default_rng(9)
    r = np.corrcoef(rng.normal(size=(60, 1)) @ np.ones((1, 4)) + rng.normal(size=(60, 4)), rowvar=False)
    load, unique, value, rounds = systems.fit_factors(r, 1)

    def at(load, unique):
        sigma = load @ load.T + np.diag(unique)
        return -0.5 * (4 * np.log(2 * np.pi) + np.linalg.slogdet(sigma)[1] + np.trace(np.linalg.solve(sigma, r)))

    assert abs(at(load, unique) - value) < 1e-9 and rounds > 1
    for i in range(4):
        for step in (1e-3, -1e-3):
            one, two = load.copy(), unique.copy()
            one[i] += step
            two[i] += step
            assert at(one, unique) < value + 1e-9 and at(load, two) < value + 1e-9
