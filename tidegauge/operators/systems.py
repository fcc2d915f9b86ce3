"""Error correction, diagnostics of vector autoregressions, common trends and factors.

Coefficients, tests and loadings come from sums of products that Spark takes over all points (:class:`.multivariate.Moments`);
one task has no more than their matrix. Residuals are combinations of lagged values, so their
autocovariances come from the same sums; their higher moments take a second pass over
the points. Series of components are sums of weighted values, by index.

Defined results: points at which a variable has no finite value at one of the lags are left out. Without
any common point the result is empty. Variables are ordered by name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .multivariate import JOHANSEN_5, Moments, by_moments, fit_var, points_of
from .series import KEY, valid


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    """P(chi-square > x)."""
    return gamma_tail(df / 2, x / 2)


class Correction:
    """The error-correction form with ``lags`` lagged changes: Johansen's reduced-rank regression, from moments with ``lags`` + 1 lags."""

    def __init__(self, m: Moments, rank: int | None):
        lags = m.p - 1
        change = [m.lag(i) - m.lag(i + 1) for i in range(lags + 1)]
        z2 = np.vstack([np.eye(1, m.sums.shape[0]), *change[1:]])
        r0, r1 = (z - m.regression(z2, z).T @ z2 for z in (change[0], m.lag(1)))
        n, k = m.n, m.k
        s00, s01, s11 = m.between(r0, r0) / n, m.between(r0, r1) / n, m.between(r1, r1) / n
        # the generalised eigenproblem through a Cholesky factor, so that values stay real
        low = np.linalg.cholesky(s11)
        inner = np.linalg.solve(low, np.linalg.solve(low, s01.T @ np.linalg.solve(s00, s01)).T).T
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        lam = np.clip(values[::-1], 0, 1 - 1e-12)
        vec = np.linalg.solve(low.T, vectors[:, ::-1])
        if rank is None:
            rank = 0
            while rank < k and (c := JOHANSEN_5.get(k - rank)) is not None and -n * np.log(1 - lam[rank:]).sum() > c:
                rank += 1
        self.rank, self.n, self.k, self.lags, self.eigenvalues = rank, n, k, lags, lam
        beta = vec[:, :rank]
        if rank and abs(np.linalg.det(beta[:rank])) > 1e-12:
            beta = beta @ np.linalg.inv(beta[:rank])
        self.beta = beta
        self.alpha = s01 @ beta @ np.linalg.inv(beta.T @ s11 @ beta) if rank else np.zeros((k, 0))
        rest = change[0] - self.alpha @ self.beta.T @ m.lag(1)
        b = m.regression(z2, rest)
        e = rest - b.T @ z2
        self.intercept = b[0] - self.alpha @ self.beta.T @ m.means
        self.gamma = b[1:].reshape(lags, k, k).transpose(0, 2, 1)
        self.omega = m.between(e, e) / n
        of_changes = change[0] - m.regression(z2[:1], change[0]).T @ z2[:1]
        self.r2 = 1 - np.diag(self.omega) * n / np.maximum(np.diag(m.between(of_changes, of_changes)), 1e-300)
        self.loglik = -0.5 * n * (k * math.log(2 * math.pi) + np.linalg.slogdet(self.omega)[1] + k)
        self.size = k * (1 + rank + lags * k) + rank * (k - rank)

    def largest_root(self) -> float:
        """Modulus of the largest root of the companion matrix beyond the k - rank that are one."""
        k, p = self.k, self.lags + 1
        a = [np.zeros((k, k)) for _ in range(p)]
        a[0] = np.eye(k) + self.alpha @ self.beta.T
        for i, g in enumerate(self.gamma):
            a[i] = a[i] + g
            a[i + 1] = a[i + 1] - g
        roots = np.sort(np.abs(np.linalg.eigvals(companion(np.array(a)))))[::-1]
        rest = np.delete(roots, np.argsort(np.abs(roots - 1))[: k - self.rank])
        return float(rest.max()) if len(rest) else 0.0


def companion(a: np.ndarray) -> np.ndarray:
    p, k, _ = a.shape
    out = np.zeros((k * p, k * p))
    out[:k] = np.hstack(list(a))
    out[k:, :-k] = np.eye(k * (p - 1))
    return out


VECM = "part string, equation string, term string, lag int, value double"


def vecm(series: DataFrame, rank: int | None = None, lags: int = 1) -> DataFrame:
    """Parts of the model: ``alpha`` (term ec1 ...), ``beta``, ``gamma`` (term: variable, lag), ``intercept``, ``r2``, and
    ``model`` with loglik, aic, bic, rank, n and largest_root. ``rank`` is that of the trace test at 5 % unless given."""

    def finish(m: Moments) -> list[tuple]:
        c, rows = Correction(m, rank), []
        for j in range(c.rank):
            rows += [("alpha", m.names[i], f"ec{j + 1}", 0, float(c.alpha[i, j])) for i in range(c.k)]
            rows += [("beta", m.names[i], f"ec{j + 1}", 0, float(c.beta[i, j])) for i in range(c.k)]
        for i in range(c.k):
            rows += [("gamma", m.names[i], m.names[j], h + 1, float(c.gamma[h, i, j])) for h in range(c.lags) for j in range(c.k)]
            rows += [("intercept", m.names[i], "", 0, float(c.intercept[i])), ("r2", m.names[i], "", 0, float(c.r2[i]))]
        facts = {"loglik": c.loglik, "aic": 2 * c.size - 2 * c.loglik, "bic": c.size * math.log(c.n) - 2 * c.loglik, "rank": c.rank, "n": c.n, "largest_root": c.largest_root()}
        return rows + [("model", "", name, 0, float(v)) for name, v in facts.items()]

    return by_moments(series, lags + 1, finish, VECM)


def var_diagnostics(series: DataFrame, p: int = 1, lags: int = 10, alpha: float = 0.05) -> DataFrame:
    """``test``, ``equation`` (empty: the whole system), ``statistic``, ``df``, ``p_value``, ``passed``.

    ``stability``: largest root of the companion matrix, passed below one. ``portmanteau``: autocorrelation of the residuals of
    all equations up to ``lags`` (Hosking), ``ljung_box``: of one equation. ``normality``: Jarque-Bera, of one
    equation and, summed over Cholesky-orthogonal residuals, of the system. Also ``aic``, ``bic`` and ``hqic`` of the system.
    """

    def finish(m: Moments) -> list[tuple]:
        k, size, n = m.k, m.sums.shape[0], m.n
        z, y = np.vstack([np.eye(1, size), *[m.lag(i) for i in range(1, p + 1)]]), m.lag(0)
        b = m.regression(z, y)
        a = b[1:].reshape(p, k, k).transpose(0, 2, 1)
        # residuals of earlier points are the same combination, moved back
        error = [m.lag(j) - b.T @ np.vstack([np.eye(1, size), *[m.lag(i + j) for i in range(1, p + 1)]]) for j in range(lags + 1)]
        c = [m.between(error[0], e) / n for e in error]
        inverse = np.linalg.inv(c[0])
        root = float(np.abs(np.linalg.eigvals(companion(a))).max())
        rows = [("stability", "", root, None, None, root < 1)]
        q = sum(n * n / (n - j) * np.trace(c[j].T @ inverse @ c[j] @ inverse) for j in range(1, lags + 1))
        df = k * k * max(1, lags - p)
        rows.append(("portmanteau", "", float(q), df, pv := chi2_tail(q, df), pv >= alpha))
        for i, name in enumerate(m.names):
            q = n * (n + 2) * sum((c[j][i, i] / c[0][i, i]) ** 2 / (n - j) for j in range(1, lags + 1))
            rows.append(("ljung_box", name, float(q), lags, pv := chi2_tail(q, lags), pv >= alpha))
        log_det, free = np.linalg.slogdet(c[0])[1], k * (k * p + 1)
        for name, weight in (("aic", 2), ("bic", math.log(n)), ("hqic", 2 * math.log(math.log(n)))):
            rows.append((name, "", float(log_det + weight * free / n), None, None, None))
        return rows

    schema = "test string, equation string, statistic double, df int, p_value double, passed boolean"
    return by_moments(series, p + lags, finish, schema).unionByName(_normality(series, p, alpha))


def _normality(series: DataFrame, p: int, alpha: float) -> DataFrame:
    spark = series.sparkSession
    schema = "equation string, weights array<double>"

    def finish(m: Moments) -> list[tuple]:
        c, a, s = fit_var(m)
        k = m.k
        turn = np.linalg.inv(np.linalg.cholesky((s + s.T) / 2))
        own = np.hstack([-c[:, None], np.eye(k), *[-x for x in a]])  # of (1, lags 0 to p)
        both = [*zip(m.names, own / np.sqrt(np.diag(s))[:, None], strict=True), *((f"\0{i}", w) for i, w in enumerate(turn @ own))]
        return [(name, [float(x) for x in w]) for name, w in both]

    found = by_moments(series, p, finish, schema).collect()  # a row for each equation, with as many numbers as it has coefficients
    if not found:
        return spark.createDataFrame([], "test string, equation string, statistic double, df int, p_value double, passed boolean")
    names, weights = [r["equation"] for r in found], np.array([r["weights"] for r in found])
    points, _ = points_of(series, p)

    def powers(batches):
        total = np.zeros((len(names), 5))
        for b in batches:
            if len(b):
                e = np.column_stack([np.ones(len(b)), np.stack(b["w"].to_list())]) @ weights.T
                total += np.column_stack([np.full(e.shape[1], len(e)), *[(e**q).sum(0) for q in range(1, 5)]])
        yield pd.DataFrame({"equation": names, **{f"s{q}": total[:, q] for q in range(5)}})

    s = points.select("w").mapInPandas(powers, "equation string, s0 double, s1 double, s2 double, s3 double, s4 double").groupBy("equation").agg(*[F.sum(f"s{q}").alias(f"s{q}") for q in range(5)])

    def tests(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m1, m2, m3, m4 = (pdf["s0"].to_numpy(), *(pdf[f"s{q}"].to_numpy() / pdf["s0"].to_numpy() for q in range(1, 5)))
        v = m2 - m1**2
        skew = (m3 - 3 * m1 * m2 + 2 * m1**3) / v**1.5
        kurt = (m4 - 4 * m1 * m3 + 6 * m1**2 * m2 - 3 * m1**4) / v**2
        pdf["jb"] = n / 6 * (skew**2 + (kurt - 3) ** 2 / 4)
        whole = pdf["equation"].str.startswith("\0")
        rows = [("normality", e, float(q), 2) for e, q in zip(pdf.loc[~whole, "equation"], pdf.loc[~whole, "jb"], strict=True)]
        rows.append(("normality", "", float(pdf.loc[whole, "jb"].sum()), 2 * int(whole.sum())))
        return pd.DataFrame([(*r, chi2_tail(r[2], r[3]), chi2_tail(r[2], r[3]) >= alpha) for r in rows], columns=["test", "equation", "statistic", "df", "p_value", "passed"])

    return s.withColumn("system", F.lit(0)).groupBy("system").applyInPandas(tests, "test string, equation string, statistic double, df int, p_value double, passed boolean")


def _complement(a: np.ndarray) -> np.ndarray:
    """A basis of what is orthogonal to the columns of ``a``."""
    u, s, _ = np.linalg.svd(a, full_matrices=True)
    return u[:, int((s > 1e-12 * max(s.max(initial=0), 1e-300)).sum()) :] if a.shape[1] else np.eye(len(a))


def _weighted(series: DataFrame, weights: DataFrame) -> DataFrame:
    """Sums of values times ``weight``, by index and ``target``, where all variables have a value; ``weights``: series_id, target, weight."""
    rows = valid(series).select(KEY, "idx", "value")
    n = weights.agg(F.countDistinct(KEY)).scalar()
    t = rows.join(weights, KEY).groupBy("idx", "target").agg(F.sum(F.col("value") * F.col("weight")).alias("x"), F.count("*").alias("n"))
    return t.where(F.col("n") == n).drop("n")


def common_trends(series: DataFrame, rank: int | None = None, lags: int = 1) -> DataFrame:
    """Each series' ``permanent`` and ``transitory`` part at each common point, from the error-correction form (Gonzalo and Granger).

    The permanent part follows k - rank common trends, combinations that the corrections don't move;
    the transitory part is what is corrected. With rank 0 all is permanent, with full rank all is transitory.
    """

    def finish(m: Moments) -> list[tuple]:
        c = Correction(m, rank)
        a, b = _complement(c.alpha), _complement(c.beta)
        keep = b @ np.linalg.solve(a.T @ b, a.T) if a.shape[1] else np.zeros((c.k, c.k))
        return [(m.names[j], m.names[i], float(keep[i, j])) for i in range(c.k) for j in range(c.k)]

    weights = by_moments(series, lags + 1, finish, f"{KEY} string, target string, weight double")
    permanent = _weighted(series, weights).select("idx", F.col("target").alias(KEY), F.col("x").alias("permanent"))
    rows = valid(series).select(KEY, "idx", "value").join(permanent, [KEY, "idx"])
    return rows.withColumn("transitory", F.col("value") - F.col("permanent"))


def varimax(loadings: np.ndarray, rounds: int = 500) -> np.ndarray:
    """The orthogonal rotation after which squared loadings vary most within factors."""
    n, k = loadings.shape
    turn, before = np.eye(k), 0.0
    for _ in range(rounds):
        now = loadings @ turn
        u, s, v = np.linalg.svd(loadings.T @ (now**3 - now * (now**2).mean(0)))
        turn = u @ v
        if s.sum() <= before * (1 + 1e-12):
            break
        before = s.sum()
    return loadings @ turn


def fit_factors(r: np.ndarray, factors: int, rounds: int = 5000) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Loadings, unique variances, log likelihood of a point and rounds of the EM algorithm for a correlation matrix."""
    k = len(r)
    values, vectors = np.linalg.eigh(r)
    top = np.argsort(-values)[:factors]
    load = vectors[:, top] * np.sqrt(np.maximum(values[top], 1e-6))
    unique = np.clip(1 - (load**2).sum(1), 0.05, 1)
    before = -math.inf
    for i in range(1, rounds + 1):
        sigma = load @ load.T + np.diag(unique)
        weights = np.linalg.solve(sigma, load).T  # of the expected factors
        rw = r @ weights.T
        load = rw @ np.linalg.inv(np.eye(factors) - weights @ load + weights @ rw)
        unique = np.maximum(np.diag(r - load @ weights @ r), 1e-6)
        sigma = load @ load.T + np.diag(unique)
        value = -0.5 * (k * math.log(2 * math.pi) + np.linalg.slogdet(sigma)[1] + np.trace(np.linalg.solve(sigma, r)))
        if value - before < 1e-12:
            break
        before = value
    return load, unique, value, i


def factor_analysis(series: DataFrame, factors: int = 1, rotate: bool = True) -> DataFrame:
    """``factor``, series, ``loading``, ``score_weight`` (of standardised values), ``communality``, ``uniqueness``, ``explained`` share and the model's ``loglik``.

    Maximum likelihood on the correlations of the common points; varimax rotation. Factors are ordered by
    what they explain, and each factor's largest loading is positive. Fewer factors than variables are possible.
    """

    def finish(m: Moments) -> list[tuple]:
        k, n = m.k, m.n
        if not 0 < factors < k:
            raise ValueError("factors must be fewer than variables")
        mean = m.sums[0, 1 : k + 1] / n
        cov = m.sums[1 : k + 1, 1 : k + 1] / n - np.outer(mean, mean)
        d = np.sqrt(np.maximum(np.diag(cov), 1e-300))
        load, unique, value, _ = fit_factors(cov / np.outer(d, d), factors)
        load = varimax(load) if rotate and factors > 1 else load
        load = load[:, np.argsort(-(load**2).sum(0))]
        load = load * np.where(load[np.abs(load).argmax(0), np.arange(factors)] < 0, -1, 1)
        weights = np.linalg.solve(load @ load.T + np.diag(unique), load)
        shared, share = (load**2).sum(1), (load**2).sum(0) / k
        return [(f + 1, name, *(float(x) for x in (load[i, f], weights[i, f], shared[i], unique[i], share[f], n * value))) for f in range(factors) for i, name in enumerate(m.names)]

    return by_moments(series, 0, finish, f"factor int, {KEY} string, loading double, score_weight double, communality double, uniqueness double, explained double, loglik double")


def factor_scores(series: DataFrame, analysis: DataFrame) -> DataFrame:
    """Expected ``score`` of each factor at each common point."""
    rows = valid(series)
    t = rows.groupBy(KEY).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = rows.join(t, KEY).withColumn("value", (F.col("value") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)))
    w = _weighted(z, analysis.select(KEY, F.col("factor").alias("target"), F.col("score_weight").alias("weight")))
    return w.select("idx", F.col("target").alias("factor"), F.col("x").alias("score"))
