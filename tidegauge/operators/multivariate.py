"""Causality, vector autoregression, cointegration, principal components and similarity of series.

Variables are the series of one frame, aligned by index. Systems of variables are fitted
from sums over the points, which Spark takes; only their matrix, whose size depends on the
number of variables and lags, meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import least_squares
from .series import KEY, by_index, valid


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def lagged(y: np.ndarray, p: int) -> np.ndarray:
    """Columns of all variables at lags 1 to p."""
    return np.hstack([y[p - k : len(y) - k] for k in range(1, p + 1)])


def granger_test(cause: np.ndarray, effect: np.ndarray, lags: int) -> tuple[float, float]:
    own, both = lagged(effect[:, None], lags), lagged(np.column_stack([effect, cause]), lags)
    y, one = effect[lags:], np.ones((len(effect) - lags, 1))
    r0, r1 = (least_squares(np.hstack([one, d]), y)[2] for d in (own, both))
    s0, s1, df = float((r0**2).sum()), float((r1**2).sum()), len(y) - 2 * lags - 1
    f = (s0 - s1) / lags / (s1 / df) if s1 > 0 and df > 0 else 0.0
    return f, f_tail(f, lags, df) if df > 0 else 1.0


def granger(series: DataFrame, lags: int = 5, alpha: float = 0.05) -> DataFrame:
    """F test of each ordered pair of series: whether the past of ``cause`` helps to predict ``effect``."""
    from .correlation import pair_up

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x, y, out = pdf["x"].to_numpy(), pdf["y"].to_numpy(), []
        if len(x) > 3 * lags + 1:
            for a, b, c, e in ((key[0], key[1], x, y), (key[1], key[0], y, x)):
                f, p = granger_test(c, e, lags)
                out.append((a, b, f, p, p < alpha))
        return pd.DataFrame(out, columns=["cause", "effect", "f", "p_value", "is_significant"])

    return pair_up(series).groupBy("var1", "var2").applyInPandas(run, "cause string, effect string, f double, p_value double, is_significant boolean")


class Moments:
    """Sums of products of (1, all variables at lags 0 to ``p``), variables less their means, over ``n`` points."""

    def __init__(self, rows: pd.DataFrame, p: int):
        means = rows[rows["kind"] == "mean"].sort_values(KEY)
        self.names, self.means, self.p, self.k = list(means[KEY]), means["value"].to_numpy(float), p, len(means)
        size = 1 + self.k * (p + 1)
        sums = rows[rows["kind"] == "product"].sort_values("at")["value"].to_numpy(float)
        self.sums = sums.reshape(size, size) if len(sums) else np.zeros((size, size))
        self.last, self.n = rows[rows["kind"] == "last"].sort_values("at")["value"].to_numpy(float), self.sums[0, 0]

    def lag(self, i: int) -> np.ndarray:
        """Picks the variables at lag ``i``."""
        return np.eye(1 + self.k * (self.p + 1))[1 + i * self.k : 1 + (i + 1) * self.k]

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sums of products of two sets of combinations."""
        return a @ self.sums @ b.T

    def regression(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Coefficients of least squares of ``y`` on ``z``; columns are scaled before the normal equations are solved."""
        zz = self.between(z, z)
        d = 1 / np.sqrt(np.maximum(np.diag(zz), 1e-300))
        return d[:, None] * np.linalg.lstsq(zz * np.outer(d, d), d[:, None] * self.between(z, y), rcond=None)[0]


def points_of(series: DataFrame, p: int) -> tuple[DataFrame, DataFrame]:
    """Points ``t`` with ``w``: all variables, less their means, at lags 0 to ``p``, in the order of their names; and the means."""
    rows = valid(series).select(KEY, "idx", "value")
    means = rows.groupBy(KEY).agg(F.avg("value").alias("mean"))
    variables = means.agg(F.count("*").alias("k")).scalar()
    cells = rows.join(means, KEY).select(F.explode(F.sequence(F.lit(0), F.lit(p))).alias("lag"), KEY, "idx", (F.col("value") - F.col("mean")).alias("x"))
    points = cells.groupBy((F.col("idx") + F.col("lag")).cast("long").alias("t")).agg(F.array_sort(F.collect_list(F.struct("lag", KEY, "x"))).alias("w"))
    points = points.where(F.size("w") == variables * (p + 1)).select("t", F.col("w.x").alias("w"))
    return points, means


def by_moments(series: DataFrame, p: int, finish: Callable[[Moments], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``finish`` makes of the moments of all points at which every variable has its values at lags 0 to ``p``.

    A point's values meet in a group of (p + 1) times as many as there are variables;
    tasks sum their points' products, so what is shuffled further doesn't grow with the points.
    Without any common point the result is empty.
    """
    points, means = points_of(series, p)

    def products(batches):
        sums, at, last = None, -1, None
        for b in batches:
            if not len(b):
                continue
            w = np.stack(b["w"].to_list())
            z = np.hstack([np.ones((len(w), 1)), w])
            sums = z.T @ z if sums is None else sums + z.T @ z
            i = int(b["t"].to_numpy().argmax())
            if b["t"].iat[i] > at:
                at, last = int(b["t"].iat[i]), w[i]
        if sums is not None:
            for kind, values in (("product", sums.ravel()), ("last", last)):
                yield pd.DataFrame({"kind": kind, "at": np.arange(len(values)), "t": at, "value": values})

    sums = points.mapInPandas(products, "kind string, at int, t long, value double").groupBy("kind", "at")
    sums = sums.agg(F.when(F.col("kind") == "last", F.max_by("value", "t")).otherwise(F.sum("value")).alias("value"))
    every = sums.select("kind", "at", F.lit(None).cast("string").alias(KEY), "value")
    every = every.unionByName(means.select(F.lit("mean").alias("kind"), F.lit(0).alias("at"), KEY, F.col("mean").alias("value")))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = Moments(pdf, p)
        return pd.DataFrame(finish(m) if m.n else [], columns=names, dtype=None if m.n else object)

    return every.withColumn("system", F.lit(0)).groupBy("system").applyInPandas(run, schema)


def fit_var(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intercepts (of values less their means), coefficient matrices (lag, equation, variable) and residual covariance over n - 1."""
    one = np.eye(1, m.sums.shape[0])
    z, y, k = np.vstack([one, *[m.lag(i) for i in range(1, m.p + 1)]]), m.lag(0), m.k
    b = m.regression(z, y)
    e = y - b.T @ z
    return b[0], b[1:].reshape(m.p, k, k).transpose(0, 2, 1), m.between(e, e) / max(1, m.n - 1)


def var_forecast(series: DataFrame, p: int = 1, horizon: int = 10) -> DataFrame:
    """Joint forecasts of all series by a vector autoregression."""

    def finish(m: Moments) -> list[tuple]:
        c, a, _ = fit_var(m)
        past, rows = list(m.last.reshape(p + 1, m.k)[:p][::-1]), []
        for h in range(1, horizon + 1):
            past.append(c + sum(a[i] @ past[-1 - i] for i in range(p)))
            rows += [(name, h, float(x)) for name, x in zip(m.names, past[-1] + m.means, strict=True)]
        return rows

    return by_moments(series, p, finish, f"{KEY} string, step int, forecast double")


def impulse_responses(series: DataFrame, p: int = 1, steps: int = 10) -> DataFrame:
    """Orthogonalised responses (Cholesky, variables by name), and each shock's share of the forecast variance."""

    def finish(m: Moments) -> list[tuple]:
        _, a, s = fit_var(m)
        k, names = m.k, m.names
        chol = np.linalg.cholesky((s + s.T) / 2 + 1e-12 * np.eye(k))
        psi = [np.eye(k)]
        for h in range(1, steps + 1):
            psi.append(sum(psi[h - i - 1] @ a[i] for i in range(min(p, h))))
        theta = [x @ chol for x in psi]
        share = np.cumsum([t**2 for t in theta], axis=0)
        share = share / np.maximum(share.sum(2, keepdims=True), 1e-300)
        return [(names[j], names[i], h, float(theta[h][i, j]), float(share[h][i, j])) for h in range(steps + 1) for i in range(k) for j in range(k)]

    return by_moments(series, p, finish, "impulse string, response string, step int, irf double, fevd double")


def engle_granger(series: DataFrame) -> DataFrame:
    """The line of one series on another and the Dickey-Fuller t of its residuals; 5 % critical value -3.34."""
    from .correlation import pair_up
    from .stationarity import _adf_fit

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        if len(x) < 20:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("var1", "var2", "beta", "intercept", "statistic", "is_cointegrated")})
        b, _, r = least_squares(np.column_stack([np.ones(len(x)), x]), y)
        t = _adf_fit(r, 1)[0]
        return pd.DataFrame([(key[0], key[1], float(b[1]), float(b[0]), t, t < -3.34)], columns=["var1", "var2", "beta", "intercept", "statistic", "is_cointegrated"])

    return pair_up(series).groupBy("var1", "var2").applyInPandas(run, "var1 string, var2 string, beta double, intercept double, statistic double, is_cointegrated boolean")


#: 5 % critical values of Johansen's trace statistic with a constant, by n - r (fixed values).
JOHANSEN_5 = {1: 3.84, 2: 15.49, 3: 29.80, 4: 47.86, 5: 69.82, 6: 95.75}


def johansen(series: DataFrame, lags: int = 1) -> DataFrame:
    """Eigenvalues, trace statistics and vectors of the error-correction form with ``lags`` lagged changes.

    ``rejected`` is null, as ``critical_5`` is, where more series are left than the table has critical values for.
    """

    def finish(m: Moments) -> list[tuple]:
        change = [m.lag(i) - m.lag(i + 1) for i in range(lags + 1)]
        z2 = np.vstack([np.eye(1, m.sums.shape[0]), *change[1:]])
        r0, r1 = (z - m.regression(z2, z).T @ z2 for z in (change[0], m.lag(1)))
        n, k = m.n, m.k
        s00, s01, s11 = m.between(r0, r0) / n, m.between(r0, r1) / n, m.between(r1, r1) / n
        values, vectors = np.linalg.eig(np.linalg.solve(s11, s01.T) @ np.linalg.solve(s00, s01))
        order = np.argsort(-values.real)
        lam, vec = np.clip(values.real[order], 0, 1 - 1e-12), vectors.real[:, order]
        rows = []
        for r in range(k):
            trace, crit = -n * float(np.log(1 - lam[r:]).sum()), JOHANSEN_5.get(k - r)
            v = vec[:, r] / (vec[0, r] if abs(vec[0, r]) > 1e-12 else 1)
            rows.append((r, float(lam[r]), trace, -n * math.log(1 - float(lam[r])), crit, None if crit is None else bool(trace > crit), [float(c) for c in v]))
        return rows

    return by_moments(series, lags + 1, finish, "rank int, eigenvalue double, trace double, max_eigenvalue double, critical_5 double, rejected boolean, vector array<double>")


def covariance(series: DataFrame, standardize: bool = True) -> DataFrame:
    """Covariances (or correlations) over n - 1 of all pairs of series at their common points."""
    rows = valid(series).select(KEY, "idx", "value")
    both = rows.toDF("var1", "idx", "x").join(rows.toDF("var2", "idx", "y"), "idx").where("var1 <= var2")
    c = F.covar_samp("x", "y")
    return both.groupBy("var1", "var2").agg((c / F.nullif(F.stddev_samp("x") * F.stddev_samp("y"), F.lit(0.0)) if standardize else c).alias("c"))


def principal_components(series: DataFrame, standardize: bool = True) -> DataFrame:
    """Eigenvalues, explained shares and loadings. The matrix is summed in Spark; only it is decomposed in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["var1"], *pdf["var2"]})
        at = {n: i for i, n in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for a, b, c in zip(pdf["var1"], pdf["var2"], pdf["c"].fillna(0.0), strict=True):
            m[at[a], at[b]] = m[at[b], at[a]] = c
        values, vectors = np.linalg.eigh(m)
        order = np.argsort(-values)
        total = max(values.sum(), 1e-300)
        rows = []
        for k, j in enumerate(order):
            v = vectors[:, j] * (1 if vectors[np.abs(vectors[:, j]).argmax(), j] >= 0 else -1)
            rows += [(k + 1, float(values[j]), float(values[j] / total), n, float(x), bool(values[j] > 1)) for n, x in zip(names, v, strict=True)]
        return pd.DataFrame(rows, columns=["component", "eigenvalue", "explained", KEY, "loading", "kaiser"])

    c = covariance(series, standardize).withColumn("system", F.lit(0))
    return c.groupBy("system").applyInPandas(run, f"component int, eigenvalue double, explained double, {KEY} string, loading double, kaiser boolean")


def component_scores(series: DataFrame, components: DataFrame) -> DataFrame:
    """Scores of each point: standardised values times loadings, summed by component."""
    rows = valid(series)
    t = rows.groupBy(KEY).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = rows.join(t, KEY).withColumn("z", (F.col("value") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)))
    return z.join(components.select(KEY, "component", "loading"), KEY).groupBy("idx", "component").agg(F.sum(F.col("z") * F.col("loading")).alias("score"))


#: Steps of a warping path: (rows back, columns back, weight of the local distance).
STEP_PATTERNS = {
    "symmetric": ((1, 1, 1.0), (1, 0, 1.0), (0, 1, 1.0)), "symmetric2": ((1, 1, 2.0), (1, 0, 1.0), (0, 1, 1.0)),
    "asymmetric": ((1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0)), "rabiner": ((1, 1, 1.0), (2, 1, 2.0), (1, 2, 1.0)), "diagonal": ((1, 1, 1.0), (2, 1, 1.5), (1, 2, 1.5)),
}


def warp(x: np.ndarray, y: np.ndarray, window: int | None = None, pattern: str = "symmetric", itakura: float | None = None) -> tuple[float, list[tuple[int, int]]]:
    """Distance and path of dynamic time warping with |a - b|, inside a Sakoe-Chiba band or an Itakura parallelogram."""
    n, m = len(x), len(y)
    band = max(window, abs(n - m)) if window is not None else None
    cost, came = np.full((n, m), np.inf), np.zeros((n, m, 2), int)
    local = np.abs(x[:, None] - y[None, :])
    for i in range(n):
        for j in range(m):
            if band is not None and abs(i - j) > band:
                continue
            if itakura is not None and (i or j) and (i, j) != (n - 1, m - 1):
                a, b = i / max(1, n - 1), j / max(1, m - 1)
                if not (b <= itakura * a and b >= a / itakura and 1 - b <= itakura * (1 - a) and 1 - b >= (1 - a) / itakura):
                    continue
            if i == j == 0:
                cost[i, j] = local[i, j]
                continue
            for di, dj, w in STEP_PATTERNS[pattern]:
                if i >= di and j >= dj and (c := cost[i - di, j - dj] + w * local[i, j]) < cost[i, j]:
                    cost[i, j], came[i, j] = c, (i - di, j - dj)
    path, i, j = [(n - 1, m - 1)], n - 1, m - 1
    while (i or j) and math.isfinite(cost[n - 1, m - 1]):
        i, j = map(int, came[i, j])
        path.append((i, j))
    return float(cost[n - 1, m - 1]), path[::-1]


def _by_diagonals(x: np.ndarray, y: np.ndarray, local: Callable, least: Callable) -> float:
    """Last cell of r[i, j] = local(x[i], y[j]) + least(r[i-1, j-1], r[i-1, j], r[i, j-1]), an anti-diagonal at a time, three of them held."""
    n, m = len(x), len(y)
    older, old = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    older[0] = 0
    for k in range(n + m - 1):
        lo, hi = max(0, k - m + 1), min(n, k + 1)
        new = np.full(n + 1, np.inf)
        new[lo + 1 : hi + 1] = local(x[lo:hi], y[k - hi + 1 : k - lo + 1][::-1]) + least(older[lo:hi], old[lo:hi], old[lo + 1 : hi + 1])
        older, old = old, new
    return float(old[n])


def warp_distance(x: np.ndarray, y: np.ndarray) -> float:
    """The distance of ``warp`` without its path, for long series."""
    return _by_diagonals(x, y, lambda a, b: np.abs(a - b), lambda a, b, c: np.minimum(np.minimum(a, b), c))


def soft_warp(x: np.ndarray, y: np.ndarray, gamma: float = 1.0) -> float:
    """Soft-DTW: the smooth minimum over all paths of squared differences."""

    def least(*v: np.ndarray) -> np.ndarray:
        low = np.minimum(np.minimum(v[0], v[1]), v[2])
        return low - gamma * np.log(sum(np.exp(-(a - low) / gamma) for a in v))

    return _by_diagonals(x, y, lambda a, b: (a - b) ** 2, least)


def cross_correlation_distance(x: np.ndarray, y: np.ndarray) -> float:
    """1 less the largest normalised cross-correlation."""
    a, b = x - x.mean(), y - y.mean()
    norm = math.sqrt(float((a * a).sum() * (b * b).sum()))
    return 1 - float(np.correlate(a, b, "full").max()) / norm if norm else 1.0


def _cut(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(len(a), len(b))
    return a[:n], b[:n]


DISTANCES = {
    "euclidean": lambda a, b: float(np.linalg.norm(np.subtract(*_cut(a, b)))),
    "manhattan": lambda a, b: float(np.abs(np.subtract(*_cut(a, b))).sum()),
    "cosine": lambda a, b: 1 - float(np.dot(*_cut(a, b)) / max(1e-300, np.prod([np.linalg.norm(v) for v in _cut(a, b)]))),
    "dtw": warp_distance,
    "soft_dtw": soft_warp,
    "cross_correlation": cross_correlation_distance,
}


def pairwise_distances(series: DataFrame, measure: str = "dtw") -> DataFrame:
    """Distance of each pair of series over all their values, by place; of unequal lengths the common places count, but for warping and cross-correlation.

    Euclidean, Manhattan and cosine distances are sums over a join on the place; the others see whole arrays, in groups of two blocks of series.
    """
    if measure in ("euclidean", "manhattan", "cosine"):
        rows = valid(series).select(KEY, (F.row_number().over(by_index()) - 1).alias("i"), "value")
        both = rows.toDF("var1", "i", "x").join(rows.toDF("var2", "i", "y"), "i").where("var1 < var2")
        x, y = F.col("x"), F.col("y")
        d = {
            "euclidean": F.sqrt(F.sum((x - y) ** 2)), "manhattan": F.sum(F.abs(x - y)),
            "cosine": 1 - F.sum(x * y) / F.greatest(F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y)), F.lit(1e-300)),
        }[measure]
        return both.groupBy("var1", "var2").agg(d.alias("distance"))
    from .warping import BLOCK, arrays_of

    fn, arrays = DISTANCES[measure], arrays_of(series)
    blocks = max(1, -(-arrays.count() // BLOCK))
    own = F.pmod(F.xxhash64(KEY), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    one = arrays.select(KEY, "x", F.lit(True).alias("first"), own.alias("a"), every.alias("b"))
    other = arrays.select(KEY, "x", F.lit(False).alias("first"), every.alias("a"), own.alias("b")).select(KEY, "x", "first", "a", "b")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["first"]], pdf[~pdf["first"]]
        found = [(p, q, fn(np.asarray(x, float), np.asarray(y, float))) for p, x in zip(left[KEY], left["x"], strict=True) for q, y in zip(right[KEY], right["x"], strict=True) if p < q]
        return pd.DataFrame(found, columns=["var1", "var2", "distance"])

    return one.unionByName(other).groupBy("a", "b").applyInPandas(run, "var1 string, var2 string, distance double")


def nearest_series(distances: DataFrame, k: int) -> DataFrame:
    """The k nearest of each series, with 1 - d / (largest d) as similarity."""
    from pyspark.sql import Window

    both = distances.select(F.col("var1").alias(KEY), F.col("var2").alias("other"), "distance").unionByName(distances.select(F.col("var2").alias(KEY), F.col("var1").alias("other"), "distance"))
    w = Window.partitionBy(KEY).orderBy("distance", "other")
    far = F.max("distance").over(Window.partitionBy(KEY))
    return both.withColumn("similarity", 1 - F.col("distance") / F.nullif(far, F.lit(0.0))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def barycenter(arrays: list[np.ndarray], rounds: int = 5) -> np.ndarray:
    """DBA from the first array: means of the values that warping aligns with each place."""
    center = arrays[0].astype(float).copy()
    for _ in range(rounds):
        total, count = np.zeros(len(center)), np.zeros(len(center))
        for a in arrays:
            for i, j in warp(center, a)[1]:
                total[i] += a[j]
                count[i] += 1
        center = total / np.maximum(count, 1)
    return center
