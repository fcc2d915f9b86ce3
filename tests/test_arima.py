"""Likelihoods against the multivariate normal density, published estimates, recovery, and Spark frames."""

import numpy as np
import pytest

from tidegauge.operators import arima, forecasting
from tidegauge.operators.arima import Filtered, Fit, Order

AIRLINE = [
    112, 118, 132, 129, 121, 135, 148, 148, 136, 119, 104, 118, 115, 126, 141, 135, 125, 149, 170, 170, 158, 133, 114, 140, 145, 150, 178, 163, 172, 178, 199, 199, 184, 162, 146, 166,
    171, 180, 193, 181, 183, 218, 230, 242, 209, 191, 172, 194, 196, 196, 236, 235, 229, 243, 264, 272, 237, 211, 180, 201, 204, 188, 235, 227, 234, 264, 302, 293, 259, 229, 203, 229,
    242, 233, 267, 269, 270, 315, 364, 347, 312, 274, 237, 278, 284, 277, 317, 313, 318, 374, 413, 405, 355, 306, 271, 306, 315, 301, 356, 348, 355, 422, 465, 467, 404, 347, 305, 336,
    340, 318, 362, 348, 363, 435, 491, 505, 404, 359, 310, 337, 360, 342, 406, 396, 420, 472, 548, 559, 463, 407, 362, 405, 417, 391, 419, 461, 472, 535, 622, 606, 508, 461, 390, 432,
]


def simulated(n, ar, ma, seed, d=0):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 300)
    w = np.zeros(n + 300)
    for t in range(len(w)):
        w[t] = e[t] + sum(a * w[t - 1 - i] for i, a in enumerate(ar) if t > i) + sum(b * e[t - 1 - i] for i, b in enumerate(ma) if t > i)
    w = w[300:]
    for _ in range(d):
        w = np.cumsum(w)
    return w


def density(w, ar, ma):
    """The same likelihood from the covariance matrix of all values."""
    psi = [1.0]
    for k in range(1, 3000):
        psi.append((ma[k - 1] if k <= len(ma) else 0) + sum(ar[j] * psi[k - 1 - j] for j in range(min(k, len(ar)))))
    psi, n = np.array(psi), len(w)
    g = np.array([psi[: len(psi) - k] @ psi[k:] for k in range(n)])
    factor = np.linalg.cholesky(g[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))])
    z = np.linalg.solve(factor, w)
    return -0.5 * n * (np.log(2 * np.pi * (z @ z) / n) + 1) - np.log(np.diag(factor)).sum()


@pytest.mark.parametrize("ar,ma", [([0.6], [0.4]), ([0.5, -0.3], []), ([], [0.8]), ([0.2], [-0.5, 0.3]), ([0.1] + [0] * 5 + [0.7], [0.0] * 6 + [-0.95]), ([], [0.2] * 80)])
def test_likelihood_is_the_density(ar, ma):
    w = simulated(250, ar, ma, 1)
    short = np.append(w[:150], np.zeros(100))
    f = Filtered(np.stack([w, short]), np.array([250, 150]), np.tile(np.array(ar, float).reshape(1, -1), (2, 1)), np.tile(np.array(ma, float).reshape(1, -1), (2, 1)))
    assert abs(f.loglik[0] - density(w, ar, ma)) < 1e-5 and abs(f.loglik[1] - density(w[:150], ar, ma)) < 1e-5


def test_published_airline_model():
    """Box and Jenkins' model of the logarithms, with the estimates that exact likelihood gives."""
    x = np.log(np.array(AIRLINE, float))
    f = Fit([x], Order(0, 1, 1, 0, 1, 1, 12))
    assert abs(f.parts[1][0, 0] + 0.4018) < 5e-4 and abs(f.parts[3][0, 0] + 0.5569) < 5e-4
    assert abs(f.sigma2[0] - 0.001348) < 2e-6 and abs(f.loglik[0] - 244.70) < 0.01 and abs(f.aic[0] + 483.40) < 0.02
    ahead, error = f.forecast([x], 3)
    assert np.abs(np.exp(ahead[0]) - [450.42, 425.72, 479.01]).max() < 0.05 and abs(error[0, 0] - 0.0367) < 1e-4


@pytest.mark.parametrize("ar,ma,d", [([0.6], [0.4], 0), ([], [0.7], 1), ([0.5, -0.3], [], 0), ([], [-0.6, 0.25], 0)])
def test_coefficients_are_recovered(ar, ma, d):
    xs = [simulated(n, ar, ma, seed, d) * 40 + 7 for seed, n in ((1, 4000), (2, 5000), (3, 4500))]
    f = Fit(xs, Order(len(ar), d, len(ma)))
    got = np.mean(np.concatenate(f.parts[:2], 1), 0)
    assert np.abs(got - [*ar, *ma]).max() < 0.05 and np.abs(f.sigma2 / 1600 - 1).max() < 0.1


def test_lot_gives_what_each_series_gives():
    xs = [simulated(n, [0.5], [0.3], n) for n in (90, 200, 333)]
    together = Fit(xs, Order(1, 0, 1))
    for i, x in enumerate(xs):
        alone = Fit([x], Order(1, 0, 1))
        assert abs(alone.loglik[0] - together.loglik[i]) < 1e-4
        assert np.abs(alone.forecast([x], 5)[0][0] - together.forecast(xs, 5)[0][i]).max() < 1e-2


def test_forecasts_are_conditional_means():
    """AR(1) with a mean decays to it; MA(1) on differences is flat after one step; errors widen by the psi weights."""
    x = simulated(600, [0.7], [], 5) + 30
    f = Fit([x], Order(1))
    phi, m = f.parts[0][0, 0], f.mean[0]
    ahead, error = f.forecast([x], 4)
    assert np.allclose(ahead[0], m + phi ** np.arange(1, 5) * (x[-1] - m)) and np.allclose(error[0], np.sqrt(f.sigma2[0] * np.cumsum(phi ** (2 * np.arange(4)))))
    y = simulated(600, [], [0.5], 6, 1)
    f = Fit([y], Order(0, 1, 1))
    ahead, error = f.forecast([y], 3)
    assert np.ptp(ahead[0]) < 1e-9 and abs(ahead[0, 0] - y[-1] - f.parts[1][0, 0] * f.residuals(0)[-1]) < 1e-6
    assert np.allclose(error[0] ** 2 / f.sigma2[0], 1 + np.arange(3) * (1 + f.parts[1][0, 0]) ** 2)


def test_search_finds_differences_and_season():
    fit, tried = arima.search(simulated(500, [], [0.6], 7, 1))
    assert fit.order.d == 1 and fit.order.q >= 1 and tried >= 4
    x = np.log(np.array(AIRLINE, float))
    fit, _ = arima.search(x, 12)
    assert (fit.order.d + fit.order.sd, fit.order.sd) in ((1, 1), (2, 1)) and fit.order.sq + fit.order.sp >= 1
    white, _ = arima.search(np.random.default_rng(8).normal(size=400))
    assert white.order.d == 0 and white.aicc[0] <= Fit([np.random.default_rng(8).normal(size=400)], Order()).aicc[0] + 1e-6


def frame(spark, named):
    rows = [(k, i, None if v is None else float(v)) for k, x in named.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, idx long, value double").selectExpr("*", "timestamp_seconds(idx * 3600) ts")


def test_frames(spark):
    x = simulated(300, [0.6], [0.4], 9)
    holes = [*x[:100], None, float("inf"), *x[100:]]
    s = frame(spark, {"a": x, "holes": holes, "short": [1, 2, 3, 4], "constant": [5.0] * 40, "line": np.arange(60.0)})
    rows = {r.series_id: r for r in arima.models(s, Order(1, 0, 1), 3, with_residuals=True).collect()}
    assert set(rows) == {"a", "holes", "constant", "line"}
    assert rows["a"].forecast == rows["holes"].forecast and rows["holes"].idx[100] == 102
    assert rows["constant"].forecast == [5.0] * 3 and rows["constant"].loglik is None and rows["constant"].sigma2 == 0
    assert abs(rows["a"].fitted[7] + rows["a"].residual[7] - x[7]) < 1e-9 and len(rows["a"].residual) == 300
    f = Fit([x], Order(1, 0, 1))
    got = {(r.part, r.lag): r.coefficient for r in arima.coefficients(arima.models(s, Order(1, 0, 1), 1)).where("series_id = 'a'").collect()}
    assert abs(got["ar", 1] - f.parts[0][0, 0]) < 1e-3 and abs(got["ma", 1] - f.parts[1][0, 0]) < 1e-3 and len(got) == 2
    line = [r.forecast for r in forecasting.forecast(s, "arima", 3, p=0, d=1, q=0).where("series_id = 'line'").orderBy("step").collect()]
    assert np.allclose(line, [60, 61, 62])  # a constant step is what stays
    out = arima.steps(arima.models(s, Order(0, 1, 1), 4)).where("series_id = 'a'").orderBy("step").collect()
    assert [r.step for r in out] == [1, 2, 3, 4] and all(r.lower < r.forecast < r.upper for r in out) and out[0].error < out[3].error
    assert arima.models(s.limit(0), Order(1), 2).count() == 0


def test_q_changes_the_forecast(spark):
    s = frame(spark, {"a": simulated(200, [0.3], [0.8], 11)})
    first = lambda **o: forecasting.forecast(s, "arima", 1, d=0, **o).first().forecast
    assert abs(first(p=1, q=0) - first(p=1, q=1)) > 1e-3
    auto = forecasting.forecast(s, "auto_arima", 5)
    assert auto.count() == 5 and auto.columns == ["series_id", "step", "ts", "forecast", "method"]
    season = frame(spark, {"w": [10 * np.sin(2 * np.pi * t / 7) + 0.1 * v for t, v in enumerate(simulated(140, [], [], 12))]})
    got = [r.forecast for r in forecasting.forecast(season, "sarima", 7).orderBy("step").collect()]
    assert np.abs(np.array(got) - [10 * np.sin(2 * np.pi * (140 + k) / 7) for k in range(7)]).max() < 0.6
