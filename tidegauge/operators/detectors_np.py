"""Density-based detectors and filters that need a whole series at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staged import staged
from . import scan
from .grouped import per_series
from .series import KEY, valid

#: Values of a run of :func:`local_outlier_factor`.
RUN = 1 << 16
_SCORES = "idx long, score double"


def _top(idx: np.ndarray, score: np.ndarray, share: float) -> dict:
    k = math.ceil(len(score) * share)
    at = np.lexsort((idx, -score))[:k]
    at = at[np.isfinite(score[at]) | (score[at] > 0)]
    return {"idx": idx[at], "score": score[at]}


def isolation_forest(series: DataFrame, contamination: float = 0.1, trees: int = 100, seed: int = 42, sample: int = 256) -> DataFrame:
    """Isolation scores of single values by random splits, seeded; the top share is returned."""

    def run(x: np.ndarray, idx: np.ndarray) -> dict:
        rng = np.random.default_rng(seed)
        m = min(sample, len(x))
        deepest = max(1, math.ceil(math.log2(m)))
        average = lambda n: 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)
        depth = np.zeros(len(x))
        for _ in range(trees):
            def descend(part: np.ndarray, rows: np.ndarray, level: int) -> None:
                if level == deepest or len(part) < 2 or part.min() == part.max() or not len(rows):
                    depth[rows] += level + average(len(part))
                    return
                cut = rng.uniform(part.min(), part.max())
                descend(part[part < cut], rows[x[rows] < cut], level + 1)
                descend(part[part >= cut], rows[x[rows] >= cut], level + 1)

            descend(rng.choice(x, m, replace=False), np.arange(len(x)), 0)
        return _top(idx, 2 ** (-depth / trees / max(average(m), 1e-9)), contamination)

    return per_series(series, run, _SCORES, 10)


def _neighbours(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest other values of each of ordered values, by two pointers; of equal distances the lower value first."""
    n = len(s)
    near, dist = np.zeros((n, k), int), np.zeros((n, k))
    lo, hi = np.arange(n) - 1, np.arange(n) + 1
    for j in range(k):
        below, above = s - s[np.maximum(lo, 0)], s[np.minimum(hi, n - 1)] - s
        down = (hi >= n) | ((lo >= 0) & (below <= above))
        near[:, j], dist[:, j] = np.where(down, lo, hi), np.where(down, below, above)
        lo, hi = lo - down, hi + ~down
    return near, dist


def _placed(rows: DataFrame, *by: Column) -> tuple[DataFrame, DataFrame]:
    """``place`` of each row of a series by ``by``, from 0, counted in blocks; and ``n`` for each series, named ``of``."""
    blocks = scan.dealt(rows.withColumn("ts", F.struct(*by)))
    counted = scan.running(blocks, place=("sum", F.lit(1).cast("long")))
    return counted.withColumn("place", F.col("place") - 1).drop("ts", "block"), blocks.groupBy(F.col(KEY).alias("of")).agg(F.count("*").alias("n"))


def local_outlier_factor(series: DataFrame, k: int = 10, contamination: float = 0.1) -> DataFrame:
    """LOF of single values; densities are infinite among equal values, whose factor is 1.

    A factor depends on its neighbours, theirs and those of these, so on ``3 * k`` values to each side in order of size:
    runs of ``RUN`` values get as many from their neighbours, and no task holds a series.
    """
    placed, n = _placed(valid(series).select(KEY, "idx", "value"), F.col("value"), F.col("idx"))
    placed = placed.join(n.where("n >= 3"), F.col(KEY).eqNullSafe(F.col("of"))).drop("of")
    beside = 3 * k
    size = max(RUN, beside)
    run, within = F.floor(F.col("place") / size), F.col("place") % size
    runs = F.array_compact(F.array(run, F.when((within < beside) & (run > 0), run - 1), F.when(within >= size - beside, run + 1)))

    def factors(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        own = (pdf["place"] // size == pdf["run"]).to_numpy()
        if not own.any():
            return pdf[:0].rename(columns={"value": "score"})[[KEY, "idx", "score"]]
        near, dist = _neighbours(pdf["value"].to_numpy(float), min(k, int(pdf["n"].iloc[0]) - 1, len(pdf) - 1))
        reach = np.maximum(dist[:, -1][near], dist).mean(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            lrd = 1 / reach
            lof = lrd[near].mean(1) / lrd
        return pd.DataFrame({KEY: pdf[KEY], "idx": pdf["idx"], "score": np.nan_to_num(lof, nan=1.0, posinf=np.finfo(float).max)})[own]

    scored = placed.withColumn("run", F.explode(runs)).groupBy(KEY, "run").applyInPandas(factors, f"{KEY} string, {_SCORES}")
    ordered, n = _placed(staged(scored), -F.col("score"), F.col("idx"))  # staged, as dealing by ranges reads its rows twice
    first = ordered.join(n, F.col(KEY).eqNullSafe(F.col("of")))
    return first.where(F.col("place") < F.ceil(F.col("n") * F.lit(float(contamination)))).select(KEY, "idx", "score")


def dbscan(series: DataFrame, eps: float, least: int) -> DataFrame:
    """Points in no dense run of values: fewer than ``least`` others within eps, and no such point within eps. The score is the distance to the nearest cluster."""

    def run(x: np.ndarray, idx: np.ndarray) -> dict:
        s = np.sort(x)
        core = np.searchsorted(s, x + eps, "right") - np.searchsorted(s, x - eps, "left") - 1 >= least
        c = np.sort(x[core])
        if not len(c):
            return {"idx": idx, "score": np.full(len(x), np.nan)}
        at = np.searchsorted(c, x)
        gap = np.minimum(np.abs(x - c[np.minimum(at, len(c) - 1)]), np.abs(x - c[np.maximum(at - 1, 0)]))
        noise = gap > eps
        return {"idx": idx[noise], "score": gap[noise]}

    return per_series(series, run, _SCORES, 1)


def hodrick_prescott(series: DataFrame, smoothness: float = 1600.0) -> DataFrame:
    """The exact trend (I + lambda D'D)^-1 x by a banded elimination, and what is left."""

    def run(x: np.ndarray, idx: np.ndarray) -> dict:
        n = len(x)
        a = np.zeros((n, 3))
        for i in range(n - 2):
            for p, cp in enumerate((1.0, -2.0, 1.0)):
                for q, cq in enumerate((1.0, -2.0, 1.0)):
                    if q >= p:
                        a[i + p, q - p] += smoothness * cp * cq
        a[:, 0] += 1
        d, low1, low2, y = np.zeros(n), np.zeros(n), np.zeros(n), x.copy()
        for i in range(n):
            d[i] = a[i, 0] - (low1[i - 1] ** 2 * d[i - 1] if i > 0 else 0) - (low2[i - 2] ** 2 * d[i - 2] if i > 1 else 0)
            low1[i] = (a[i, 1] - (low1[i - 1] * low2[i - 1] * d[i - 1] if i > 0 else 0)) / d[i]
            low2[i] = a[i, 2] / d[i]
            y[i] -= (low1[i - 1] * y[i - 1] if i > 0 else 0) + (low2[i - 2] * y[i - 2] if i > 1 else 0)
        y /= d
        for i in range(n - 2, -1, -1):
            y[i] -= low1[i] * y[i + 1] + (low2[i] * y[i + 2] if i + 2 < n else 0)
        return {"idx": idx, "value": x, "trend": y, "cycle": x - y}

    return per_series(series, run, "idx long, value double, trend double, cycle double", 3)


def mann_kendall(series: DataFrame) -> DataFrame:
    """S by merge counting, n log n; for series too long for the join of all pairs."""

    def run(x: np.ndarray, _: np.ndarray) -> dict:
        rank = np.unique(x, return_inverse=True)[1] + 1
        tree, s, seen = np.zeros(rank.max() + 2, np.int64), 0, 0

        def total(i: int) -> int:
            out = 0
            while i:
                out += int(tree[i])
                i &= i - 1
            return out

        for r in rank.tolist():
            s += total(r - 1) - (seen - total(r))
            seen += 1
            while r < len(tree):
                tree[r] += 1
                r += r & -r
        n = len(x)
        z = (s - (s > 0) + (s < 0)) / math.sqrt(n * (n - 1) * (2 * n + 5) / 18)
        return {"n": n, "s": float(s), "z": z, "p_value": math.erfc(abs(z) / math.sqrt(2)), "tau": 2 * s / (n * (n - 1))}

    return per_series(series, run, "n long, s double, z double, p_value double, tau double", 3)


def complexity(series: DataFrame, m: int = 2, r: float = 0.2) -> DataFrame:
    """Lempel-Ziv complexity of the values above their median, and approximate entropy with tolerance r * mean |x|."""

    def lempel_ziv(bits: str) -> int:
        words, word = set(), ""
        for b in bits:
            word += b
            if word not in words:
                words.add(word)
                word = ""
        return len(words) + bool(word)

    def phi(x: np.ndarray, m: int, tol: float) -> float:
        w = np.lib.stride_tricks.sliding_window_view(x, m)
        share = [float((np.abs(w - v).max(1) <= tol).mean()) for v in w]
        return float(np.log(share).mean())

    def run(x: np.ndarray, _: np.ndarray) -> dict:
        tol = r * float(np.abs(x).mean())
        bits = "".join("1" if v else "0" for v in x > np.median(x))
        return {"lempel_ziv": lempel_ziv(bits), "approximate_entropy": phi(x, m, tol) - phi(x, m + 1, tol)}

    return per_series(series, run, "lempel_ziv long, approximate_entropy double", 4)


def rising_pairs(z: np.ndarray) -> int:
    """How many pairs i < j have z_i < z_j, counted block by block of doubling width."""
    n, place, count, width = len(z), np.arange(len(z)), 0, 1
    rank = np.unique(z, return_inverse=True)[1].astype(np.int64)
    while width < n:
        block, left = place // (2 * width), place // width % 2 == 0
        order = np.argsort((block * n + rank) * 2 + left)
        before = np.cumsum(left[order]) - block[order] * width
        count += int(before[~left[order]].sum())
        width *= 2
    return count


def _slope_of_rank(y: np.ndarray, t: np.ndarray, k: int) -> float:
    """The k-th smallest slope of all pairs: the least m with k pairs that rise no faster, found by halving."""
    steps, total = np.diff(y) / np.diff(t), len(y) * (len(y) - 1) // 2
    low, high = float(steps.min()), float(steps.max())
    if total - rising_pairs(y - low * t) >= k:
        return low
    for _ in range(200):
        m = low / 2 + high / 2
        if not low < m < high:
            break
        if total - rising_pairs(y - m * t) >= k:
            high = m
        else:
            low = m
    return high


def median_slope(series: DataFrame) -> DataFrame:
    """Median of the slopes of all pairs of a series' values, without making the pairs: n log^2 n steps for each halving."""

    def run(x: np.ndarray, idx: np.ndarray) -> dict:
        y, t, total = x - np.median(x), idx - float(idx[len(idx) // 2]), len(x) * (len(x) - 1) // 2
        ranks = sorted({(total + 1) // 2, total // 2 + 1})
        return {"slope": float(np.mean([_slope_of_rank(y, t, k) for k in ranks]))}

    return per_series(series, run, "slope double", 2)
