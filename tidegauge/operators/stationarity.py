"""Partial autocorrelation, stationarity tests and change points."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from .grouped import autocorrelations, least_squares, per_series
from .series import by_index, KEY, valid, val



def durbin_levinson(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of lags 1 to len(r) - 1."""
    out, phi = [], np.zeros(0)
    for k in range(1, len(r)):
        top = r[k] - (phi * r[k - 1 : 0 : -1]).sum() if k > 1 else r[1]
        low = 1 - (phi * r[1:k]).sum() if k > 1 else 1.0
        a = top / low if abs(low) > 1e-12 else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        out.append(a)
    return np.array(out)


def partial_autocorrelation(series: DataFrame, max_lag: int = 20) -> DataFrame:
    """PACF of lags 1 to min(max_lag, n / 4) and whether each is beyond 1.96 / sqrt(n)."""

    def run(x: np.ndarray, _: np.ndarray) -> dict:
        p = durbin_levinson(autocorrelations(x, min(max_lag, len(x) // 4)))
        return {"lag": np.arange(1, len(p) + 1), "pacf": p, "significant": np.abs(p) > 1.96 / math.sqrt(len(x))}

    return per_series(series, run, "lag int, pacf double, significant boolean", 10)


def optimal_lag(pacf: DataFrame) -> DataFrame:
    """The first lag of each series whose partial autocorrelation is significant, null if none is."""
    return pacf.groupBy(KEY).agg(F.min(F.when(F.col("significant"), F.col("lag"))).alias("optimal_lag"))


#: Critical values of the Dickey-Fuller t with a constant: c0 + c1 / n + c2 / n^2 (fixed values).
DICKEY_FULLER = {"1%": (-3.43035, -6.5393, -16.786), "5%": (-2.86154, -2.8903, -4.234), "10%": (-2.56677, -1.5384, -2.809)}


def _dickey_fuller_p(t: float, n: int) -> tuple[float, bool]:
    c = {k: a + b / n + d / n**2 for k, (a, b, d) in DICKEY_FULLER.items()}
    return (0.01 if t <= c["1%"] else 0.025 if t <= c["5%"] else 0.075 if t <= c["10%"] else 0.15), t <= c["5%"]


def _adf_fit(x: np.ndarray, lags: int) -> tuple[float, float]:
    """t of the level and AIC of the regression of the change on the level and ``lags`` changes."""
    d = np.diff(x)
    y = d[lags:]
    design = np.column_stack([np.ones(len(y)), x[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]])
    beta, se, r = least_squares(design, y)
    sse = max(float((r * r).sum()), 1e-300)
    return (float(beta[1] / se[1]) if se[1] else 0.0), len(y) * math.log(sse / len(y)) + 2 * design.shape[1]


def adf(series: DataFrame) -> DataFrame:
    """Augmented Dickey-Fuller with a constant; the number of lags by AIC among 1 to max(1, 0.12 n^(1/3))."""

    def run(x: np.ndarray, _: np.ndarray) -> dict:
        n = len(x)
        fits = {k: _adf_fit(x, k) for k in range(1, max(1, int(0.12 * n ** (1 / 3))) + 1)}
        k = min(fits, key=lambda i: fits[i][1])
        p, ok = _dickey_fuller_p(fits[k][0], n)
        return {"statistic": fits[k][0], "lags": k, "p_value": p, "is_stationary": ok}

    return per_series(series, run, "statistic double, lags int, p_value double, is_stationary boolean", 20)


def phillips_perron(series: DataFrame) -> DataFrame:
    """Z_t of the regression of the value on the one before, with a Bartlett long-run variance."""

    def run(x: np.ndarray, _: np.ndarray) -> dict:
        y, n = x[1:], len(x) - 1
        beta, se, r = least_squares(np.column_stack([np.ones(n), x[:-1]]), y)
        s2, q = float((r * r).sum() / n), int(4 * (n / 100) ** (2 / 9))
        long_run = s2 + 2 * sum((1 - k / (q + 1)) * float((r[k:] * r[:-k]).sum() / n) for k in range(1, q + 1))
        t = (beta[1] - 1) / se[1] if se[1] else 0.0
        mse = (r * r).sum() / (n - 2)
        z = math.sqrt(s2 / long_run) * t - (long_run - s2) * n * se[1] / (2 * math.sqrt(long_run * mse)) if long_run > 0 and mse > 0 else 0.0
        p, ok = _dickey_fuller_p(float(z), n)
        return {"statistic": float(z), "bandwidth": q, "p_value": p, "is_stationary": ok}

    return per_series(series, run, "statistic double, bandwidth int, p_value double, is_stationary boolean", 20)


def kpss(series: DataFrame, trend: bool = False) -> DataFrame:
    """Sums of squared partial sums over n^2 times a Bartlett long-run variance; bandwidth 4 (n / 100)^(2/9)."""
    x = F.col("i").cast("double")
    rows = valid(series).withColumn("i", F.row_number().over(by_index()) - 1)
    fit = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.avg(val()).alias("m"), F.regr_slope(val(), x).alias("b"), F.regr_intercept(val(), x).alias("a")).where("n >= 20")
    rows = rows.join(fit, KEY).withColumn("r", val() - (F.col("a") + F.col("b") * x if trend else F.col("m")))
    rows = rows.withColumn("s", F.sum("r").over(by_index().rowsBetween(Window.unboundedPreceding, 0)))
    q = F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))).cast("int")
    eta = rows.groupBy(KEY, "n").agg(F.sum(F.col("s") ** 2).alias("ss"), F.sum(F.col("r") ** 2).alias("g0")).withColumn("q", q)
    lagged = rows.select(KEY, "i", "r", F.explode(F.sequence(F.lit(0), q)).alias("k")).where("k > 0").withColumn("j", F.col("i") + F.col("k"))
    products = lagged.join(rows.select(KEY, F.col("i").alias("j"), F.col("r").alias("rj")), [KEY, "j"]).groupBy(KEY, "k").agg(F.sum(F.col("r") * F.col("rj")).alias("g"))
    weighted = products.join(eta.select(KEY, "q"), KEY).groupBy(KEY).agg(F.sum((1 - F.col("k") / (F.col("q") + 1)) * F.col("g")).alias("g"))
    lrv = (F.col("g0") + 2 * F.coalesce("g", F.lit(0.0))) / F.col("n")
    stat = safe_div(F.col("ss"), F.col("n") * F.col("n") * lrv)
    c1, c5, c10 = (0.216, 0.146, 0.119) if trend else (0.739, 0.463, 0.347)
    p = F.when(stat >= c1, 0.01).when(stat >= c5, 0.025).when(stat >= c10, 0.075).otherwise(0.15)
    return eta.join(weighted, KEY, "left").select(KEY, stat.alias("statistic"), p.alias("p_value"), (stat < c5).alias("is_stationary"))


def cusum(series: DataFrame, drift: float = 0.5, limit: float = 4.0) -> DataFrame:
    """Both one-sided sums of each point. S = max(0, S + d - k) is the prefix sum less its running minimum."""
    rows = valid(series)
    t = rows.groupBy(KEY).agg(F.avg(val()).alias("m"), F.stddev_pop(val()).alias("s"), F.count("*").alias("n"))
    rows = rows.join(t, KEY)
    upto = by_index().rowsBetween(Window.unboundedPreceding, 0)
    for name, sign in (("up", 1), ("down", -1)):
        rows = rows.withColumn(f"p_{name}", F.sum(sign * (val() - F.col("m")) - drift * F.col("s")).over(upto))
        rows = rows.withColumn(name, F.col(f"p_{name}") - F.least(F.lit(0.0), F.min(f"p_{name}").over(upto)))
    return rows.select(KEY, "idx", "ts", "value", "up", "down", ((F.greatest("up", "down") > limit * F.col("s")) & (F.col("s") > 0) & (F.col("n") >= 10)).alias("alarm"))


def cusum_changepoints(series: DataFrame, drift: float = 0.5, limit: float = 4.0, distance: int = 10) -> DataFrame:
    """The sums begin anew after each change point; points closer than ``distance`` to the last are passed over."""

    def run(x: np.ndarray, idx: np.ndarray) -> dict:
        m, s = x.mean(), x.std()
        up = down = 0.0
        at, score, last = [], [], -distance
        if s > 0:
            for i, d in enumerate(x - m):
                up, down = max(0.0, up + d - drift * s), max(0.0, down - d - drift * s)
                if max(up, down) > limit * s:
                    if i - last >= distance:
                        at.append(idx[i])
                        score.append(max(up, down) / s)
                        last = i
                    up = down = 0.0
        return {"idx": np.array(at, np.int64), "score": np.array(score)}

    return per_series(series, run, "idx long, score double", 10)


def _segment_costs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.append(0, np.cumsum(x)), np.append(0, np.cumsum(x * x))


def pelt(series: DataFrame, segment: int = 5, penalty: float | None = None) -> DataFrame:
    """Exact segmentation by the normal likelihood with pruning; penalty 2 ln n; ``idx`` is the last point before each change."""

    def run(x: np.ndarray, idx: np.ndarray) -> dict:
        n, (s, q) = len(x), _segment_costs(x)
        beta = penalty if penalty is not None else 2 * math.log(n)

        def cost(a: np.ndarray, b: int) -> np.ndarray:
            k = b - a
            v = np.maximum((q[b] - q[a]) / k - ((s[b] - s[a]) / k) ** 2, 1e-8)
            return k * (np.log(2 * math.pi * v) + 1)

        best, cut, live = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.array([0])
        best[0] = -beta
        for b in range(segment, n + 1):
            total = best[live] + cost(live, b) + beta
            j = int(total.argmin())
            best[b], cut[b] = total[j], live[j]
            live = live[(total - beta <= best[b]) | (b - live < 2 * segment)]
            if b - segment + 1 >= segment:
                live = np.append(live, b - segment + 1)
        points, b = [], n
        while b > 0:
            b = int(cut[b])
            if b > 0:
                points.append(b)
        return {"idx": idx[np.array(points[::-1], int) - 1] if points else np.array([], np.int64)}

    return per_series(series, run, "idx long", 10)


def binary_segmentation(series: DataFrame, segment: int = 5, critical: float = 4.0) -> DataFrame:
    """Splits at the largest pooled t statistic while it exceeds ``critical``."""

    def run(x: np.ndarray, idx: np.ndarray) -> dict:
        s, q = _segment_costs(x)
        out, todo = [], [(0, len(x))]
        while todo:
            a, b = todo.pop()
            if b - a < 2 * segment:
                continue
            k = np.arange(a + segment, b - segment + 1)
            n1, n2 = k - a, b - k
            m1, m2 = (s[k] - s[a]) / n1, (s[b] - s[k]) / n2
            ss = np.maximum(0, (q[k] - q[a]) - n1 * m1**2) + np.maximum(0, (q[b] - q[k]) - n2 * m2**2)
            t = np.abs(m1 - m2) / np.sqrt(np.maximum(ss / (b - a - 2) * (1 / n1 + 1 / n2), 1e-12))
            j = int(t.argmax())
            if t[j] > critical:
                out.append((int(idx[k[j]]), float(t[j])))
                todo += [(a, int(k[j])), (int(k[j]), b)]
        out.sort()
        return {"idx": np.array([i for i, _ in out], np.int64), "score": np.array([v for _, v in out])}

    return per_series(series, run, "idx long, score double", 10)


def variance_changes(series: DataFrame, segment: int = 5, critical: float = 4.0, min_distance: int = 10) -> DataFrame:
    """Ratio of the sample variances of the 2 ``segment`` points after and before; candidates above ``critical``, each at least ``min_distance`` valid points after the one kept before it."""
    k = 2 * segment
    before, after = by_index().rowsBetween(-k, -1), by_index().rowsBetween(0, k - 1)
    place = F.row_number().over(by_index())
    rows = valid(series).withColumns({"place": place, "v0": F.var_samp(val()).over(before), "v1": F.var_samp(val()).over(after), "n0": F.count(val()).over(before), "n1": F.count(val()).over(after)})
    f = safe_div(F.greatest("v0", "v1"), F.least("v0", "v1"))
    found = rows.withColumn("f", f).where((F.col("n0") == k) & (F.col("n1") == k) & (F.col("f") > critical)).select(KEY, "idx", "ts", "value", "f", "place")

    def spaced(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept, last = pdf.sort_values("place"), [], None
        for p in pdf["place"].tolist():
            kept.append(last is None or p >= last + min_distance)
            last = p if kept[-1] else last
        return pdf[kept]

    return found.groupBy(KEY).applyInPandas(spaced, found.schema).drop("place")
