"""Drift detectors on a sequence of values or errors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from ..operators.grouped import per_series
from .online import AdaptiveWindow, KsWindow


class Adwin:
    """Compares the means of the two halves of a window, which loses its older half at a drift."""

    def __init__(self, delta: float = 0.5):
        self.delta, self.variance = delta, 0.0
        self._keep([])

    def _keep(self, window: list[float]) -> None:
        """Sums up to each value, less a base near them, so a push needn't read the window."""
        x = np.array(window, float)
        self.window, self.base = window, float(x.mean()) if window else None
        d = x - self.base if window else x
        self.sums, self.squares = [0.0, *np.cumsum(d).tolist()], float((d * d).sum())

    def push(self, v: float) -> bool:
        if self.base is None:
            self.base = v
        d = v - self.base
        self.window.append(v)
        self.sums.append(self.sums[-1] + d)
        self.squares += d * d
        n = len(self.window)
        half = n // 2
        drift = n > 2 and abs(self.sums[half] / half - (self.sums[-1] - self.sums[half]) / (n - half)) > self.delta * math.sqrt(1 + self.variance)
        if drift:
            self._keep(self.window[half:])
            n -= half
        self.variance = max(0.0, self.squares / n - (self.sums[-1] / n) ** 2)
        return bool(drift)


class Ddm:
    """Watches the error rate (values above 0.5 are errors): a warning, then a drift, as rate plus two deviations passes two levels."""

    def __init__(self, warning: float = 0.3, control: float = 0.5):
        self.warning, self.control = warning, control
        self.reset()

    def reset(self) -> None:
        self.n = self.errors = 0
        self.warned = False

    def push(self, v: float) -> bool:
        self.n += 1
        self.errors += v > 0.5
        if self.n < 30:
            return False
        rate = self.errors / self.n
        level = rate + 2 * math.sqrt(rate * (1 - rate) / self.n)
        if not self.warned:
            self.warned = level >= self.warning
            return False
        if level >= self.control:
            self.reset()
            return True
        self.warned = level >= self.warning
        return False


class Eddm:
    """Watches the distance between errors against its best so far."""

    def __init__(self, alpha: float = 0.95, beta: float = 0.9):
        self.alpha, self.beta = alpha, beta
        self.reset()

    def reset(self) -> None:
        self.at = self.last = self.errors = 0
        self.total = self.squares = self.best_mean = self.best_std = 0.0
        self.warned = False

    def push(self, v: float) -> bool:
        self.at += 1
        if v > 0.5:
            if self.errors:
                d = self.at - self.last
                self.total += d
                self.squares += d * d
            self.errors += 1
            self.last = self.at
        if self.errors < 30:
            return False
        mean = self.total / (self.errors - 1)
        std = math.sqrt(max(0.0, self.squares / (self.errors - 1) - mean * mean))
        level = mean + 2 * std
        if level > self.best_mean + 2 * self.best_std:
            self.best_mean, self.best_std = mean, std
        under = lambda share: level < share * self.best_mean + 2 * self.best_std
        if not self.warned:
            self.warned = under(self.alpha)
            return False
        if under(self.beta):
            self.reset()
            return True
        self.warned = under(self.alpha)
        return False


class PageHinkley:
    """Sum of departures from the running mean, against its minimum."""

    def __init__(self, delta: float = 0.005, limit: float = 50.0):
        self.delta, self.limit = delta, limit
        self.reset()

    def reset(self) -> None:
        self.n, self.mean, self.sum, self.least = 0, 0.0, 0.0, 0.0

    def push(self, v: float) -> bool:
        self.n += 1
        self.mean += (v - self.mean) / self.n
        self.sum += v - self.mean - self.delta
        self.least = min(self.least, self.sum)
        if self.sum - self.least > self.limit:
            self.reset()
            return True
        return False


DETECTORS = {"adwin": AdaptiveWindow, "adwin_halves": Adwin, "ddm": Ddm, "eddm": Eddm, "kswin": KsWindow, "page_hinkley": PageHinkley}


def misses(series: DataFrame, alpha: float = 0.2, factor: float = 3.0) -> DataFrame:
    """A series of ones where exponential smoothing misses by more than ``factor`` times its mean error so far, else zeros: what detectors of error rates read."""

    def run(x: np.ndarray, idx: np.ndarray) -> dict:
        level, usual, out = x[0], 0.0, np.zeros(len(x))
        for i, v in enumerate(x.tolist()):
            error = abs(v - level)
            out[i] = float(i > 1 and error > factor * usual)
            usual += (error - usual) / max(i, 1) if i else 0.0
            level += alpha * (v - level)
        return {"idx": idx, "value": out}

    return per_series(series, run, "idx long, value double")


def detect_drift(series: DataFrame, method: str = "adwin", **options) -> DataFrame:
    """Indices at which a series drifts."""

    def run(x: np.ndarray, idx: np.ndarray) -> dict:
        detector = DETECTORS[method](**options)
        return {"idx": np.array([i for i, v in zip(idx, x, strict=True) if detector.push(float(v))], np.int64)}

    return per_series(series, run, "idx long")


def window_state(series: DataFrame, **options) -> DataFrame:
    """What the adaptive window of each series holds at the end: ``width`` (points), their ``mean``, and the ``drifts`` until then."""

    def run(x: np.ndarray, idx: np.ndarray) -> dict:
        w = AdaptiveWindow(**options)
        drifts = sum(w.push(v) for v in x.tolist())
        return {"width": int(sum(b[0] for b in w.buckets)), "mean": w.mean(), "drifts": drifts}

    return per_series(series, run, "width long, mean double, drifts long")


def performance_trend(errors: DataFrame, key: str = "series_id") -> DataFrame:
    """Improving or degrading: the later half's mean error against the earlier half's, by 5 %."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    half = F.ntile(2).over(Window.partitionBy(key).orderBy("idx"))
    t = errors.withColumn("half", half).groupBy(key).agg(F.avg(F.when(F.col("half") == 1, F.col("value"))).alias("older"), F.avg(F.when(F.col("half") == 2, F.col("value"))).alias("recent"))
    trend = F.when(F.col("recent") < 0.95 * F.col("older"), "improving").when(F.col("recent") > 1.05 * F.col("older"), "degrading").otherwise("stable")
    return t.withColumns({"trend": trend, "magnitude": F.abs(F.col("recent") - F.col("older"))})
