"""A forecaster that learns from each point as it comes, and watches its own errors for drift.

The model is an autoregression, fitted by recursive least squares that forget slowly. Each point is forecast, compared,
and learned. The absolute errors go to an adaptive window over an exponential histogram; when
it finds that they have changed, the model doubts its coefficients and so learns
faster for a while. One class serves tables (:func:`forecast_table`) and streams (:func:`forecast_stream`),
whose state is kept by Spark: the model as a value, the histogram's buckets as a list, and a timer
for each series that drops them when no point has come for ``idle`` seconds of event time.

Defined results: null, NaN and infinite values are passed over and give no row; a series' first ``lags`` points have no forecast.
Points of a micro-batch are taken in time order; a point that comes in a later batch is learned when it comes.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "series_id string, ts timestamp, value double, forecast double, error double, drift boolean, phase string, mae double, rmse double"
MODEL = "weights array<double>, spread array<double>, recent array<double>, counts array<double>"
BUCKETS = "size double, total double, squares double, low double, high double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AdaptiveWindow:
    """A window that loses its older part when the means of two parts differ by more than chance allows.

    Values are held in buckets of doubling size, at most ``per_size`` of each, so n values take
    about ``per_size`` * log2(n) buckets. Every ``clock`` values each border between buckets is tried as a cut. Two
    parts differ when their means do by sqrt(2 v ln(2/d) / m) + 2 r ln(2/d) / (3 m), with v the variance and r the range of the values,
    m half the harmonic mean of the sizes, and d = ``delta`` / ln(n).
    """

    def __init__(self, delta: float = 0.002, per_size: int = 5, clock: int = 32, buckets: list[tuple[float, ...]] | None = None, seen: int = 0):
        self.delta, self.per_size, self.clock, self.seen = delta, per_size, clock, seen
        #: The oldest first: size, mean times size, squared deviations, least, greatest.
        self.buckets: list[tuple[float, ...]] = list(buckets or [])

    def push(self, v: float) -> bool:
        self.buckets.append((1.0, v, 0.0, v, v))
        self.seen += 1
        self._merge()
        return self.seen % self.clock == 0 and self._cut()

    def _merge(self) -> None:
        """Two of the oldest buckets of a size become one of twice the size where there are too many."""
        b, end = self.buckets, len(self.buckets)
        while end:
            size, start = b[end - 1][0], end
            while start and b[start - 1][0] == size:
                start -= 1
            if end - start <= self.per_size:
                return
            x, y = b[start], b[start + 1]
            n = x[0] + y[0]
            between = (x[1] / x[0] - y[1] / y[0]) ** 2 * x[0] * y[0] / n
            b[start : start + 2] = [(n, x[1] + y[1], x[2] + y[2] + between, min(x[3], y[3]), max(x[4], y[4]))]
            end = start + 1

    def _cut(self) -> bool:
        found = False
        while len(self.buckets) > 1:
            t = np.array(self.buckets)
            size, total = t[:, 0].cumsum(), t[:, 1].cumsum()
            n, mean = size[-1], total[-1] / size[-1]
            variance = (t[:, 2].sum() + (t[:, 0] * (t[:, 1] / t[:, 0] - mean) ** 2).sum()) / n
            n0, n1 = size[:-1], n - size[:-1]
            apart = np.abs(total[:-1] / n0 - (total[-1] - total[:-1]) / n1)
            m = 1 / (1 / n0 + 1 / n1)
            d = math.log(2 * math.log(max(n, 3)) / self.delta)
            limit = np.sqrt(2 / m * variance * d) + 2 / (3 * m) * d * (t[:, 4].max() - t[:, 3].min())
            if not ((n0 >= 5) & (n1 >= 5) & (apart > limit)).any():
                break
            del self.buckets[0]
            found = True
        return found

    def mean(self) -> float:
        t = np.array(self.buckets)
        return float(t[:, 1].sum() / t[:, 0].sum())


class KsWindow:
    """Compares the distribution of the last ``recent`` of ``size`` values with that of those before them (two-sample Kolmogorov-Smirnov)."""

    def __init__(self, size: int = 100, recent: int = 30, alpha: float = 1e-4):
        self.size, self.recent = size, recent
        n, m = recent, size - recent
        self.limit = math.sqrt(-0.5 * math.log(alpha / 2) * (n + m) / (n * m))
        self.window: deque[float] = deque(maxlen=size)

    def push(self, v: float) -> bool:
        self.window.append(v)
        if len(self.window) < self.size:
            return False
        x = np.array(self.window)
        old, new = np.sort(x[: -self.recent]), np.sort(x[-self.recent :])
        at = np.concatenate([old, new])
        far = np.abs(np.searchsorted(old, at, "right") / len(old) - np.searchsorted(new, at, "right") / len(new)).max()
        if far > self.limit:
            self.window = deque(x[-self.recent :].tolist(), maxlen=self.size)
            return True
        return False


@dataclass
class OnlineForecaster:
    """``forget``: weight of a point against the next. ``doubt``: what a drift adds to the coefficients' spread. ``adapting``: points until it counts as settled again."""

    lags: int = 3
    forget: float = 0.999
    doubt: float = 10.0
    adapting: int = 50
    delta: float = 0.002
    memory: float = 0.98
    weights: np.ndarray = field(default=None)  # type: ignore[assignment]
    spread: np.ndarray = field(default=None)  # type: ignore[assignment]
    recent: list[float] = field(default_factory=list)
    #: Points seen, points until settled, decaying weight, and sums of absolute and squared errors.
    counts: list[float] = field(default_factory=lambda: [0.0] * 5)
    window: AdaptiveWindow = field(default=None)  # type: ignore[assignment]

    def __post_init__(self) -> None:
        k = self.lags + 1
        self.weights = np.zeros(k) if self.weights is None else self.weights
        self.spread = np.eye(k) * 1e4 if self.spread is None else self.spread
        self.window = AdaptiveWindow(self.delta) if self.window is None else self.window

    def push(self, v: float) -> tuple[float, float, bool, str, float, float] | None:
        """Forecast, error, drift, phase and both running errors of a point that has a forecast."""
        out = None
        if len(self.recent) == self.lags:
            x = np.array([1.0, *self.recent])
            forecast = float(self.weights @ x)
            error = v - forecast
            drift = self.window.push(abs(error))
            if drift:
                self.spread = self.spread + np.eye(len(x)) * self.doubt
                self.counts[1] = float(self.adapting)
            elif self.counts[1]:
                self.counts[1] -= 1
            _, _, w, a, s = self.counts
            self.counts[2:] = [self.memory * w + 1, self.memory * a + abs(error), self.memory * s + error * error]
            phase = "drift" if drift else "adapting" if self.counts[1] else "stable"
            out = forecast, error, drift, phase, self.counts[3] / self.counts[2], math.sqrt(self.counts[4] / self.counts[2])
            gain = self.spread @ x
            gain /= self.forget + x @ gain
            self.weights = self.weights + gain * error
            self.spread = (self.spread - np.outer(gain, x @ self.spread)) / self.forget
            self.spread = (self.spread + self.spread.T) / 2
            top = np.trace(self.spread)
            if top > 1e8:  # nothing new for long: forgetting must not let it grow without end
                self.spread *= 1e8 / top
        self.counts[0] += 1
        self.recent = [*self.recent, v][-self.lags :] if self.lags else []
        return out

    def run(self, key: str, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for ts, v in zip(pdf["ts"], pdf["value"].astype(float), strict=True):
            if math.isfinite(v) and (found := self.push(v)) is not None:
                rows.append((key, ts, v, *found))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def forecast_table(series: DataFrame, **options) -> DataFrame:
    """The rows of :data:`SCHEMA` from a table, a series at a time; its points come in time order in batches, so that no task holds a series."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, model = None, None
        for pdf in frames:
            keys = pdf["series_id"].to_numpy(object)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in pairwise(cuts):
                if lo < hi and (model is None or keys[lo] != key):
                    key, model = keys[lo], OnlineForecaster(**options)
                out = model.run(key, pdf[lo:hi]) if lo < hi else ()
                if len(out):
                    yield out

    rows = series.select("series_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return rows.repartition("series_id").sortWithinPartitions("series_id", "ts").mapInPandas(run, SCHEMA)


class _Processor(StatefulProcessor):
    def __init__(self, options: dict, idle_ms: int | None):
        self.options, self.idle_ms = options, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.model = handle.getValueState("model", MODEL)
        self.buckets = handle.getListState("buckets", BUCKETS)

    def _loaded(self) -> OnlineForecaster:
        if not self.model.exists():
            return OnlineForecaster(**self.options)
        weights, spread, recent, counts = self.model.get()
        out = OnlineForecaster(**self.options)
        k = len(weights)
        out.weights, out.spread, out.recent, out.counts = np.array(weights, float), np.array(spread, float).reshape(k, k), list(recent), list(counts)
        forecasts = int(max(0, out.counts[0] - out.lags))
        out.window = AdaptiveWindow(out.delta, buckets=[tuple(b) for b in self.buckets.get()], seen=forecasts)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        model = self._loaded()
        pdf = pd.concat(list(rows)).sort_values("ts", kind="stable")
        out = model.run(key[0], pdf)
        self.model.update((model.weights.tolist(), model.spread.ravel().tolist(), *([float(x) for x in xs] for xs in (model.recent, model.counts))))
        self.buckets.put([tuple(map(float, b)) for b in model.window.buckets])
        if self.idle_ms is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            newest = int(pdf["ts"].max().timestamp() * 1000)
            self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.model.clear()
        self.buckets.clear()
        yield pd.DataFrame(columns=[c.split()[0] for c in SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def forecast_stream(events: DataFrame, late: str = "1 hour", idle: float | None = None, **options) -> DataFrame:
    """The same rows from a stream of ``series_id, ts, value``; ``idle``: seconds of event time after which a series is forgotten.

    The state store must be RocksDB; the session is set so unless it names a store itself.
    """
    spark = events.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(name, ""):
        spark.conf.set(name, ROCKS)
    rows = events.withWatermark("ts", late)
    processor = _Processor(options, None if idle is None else int(idle * 1000))
    return rows.groupBy("series_id").transformWithStateInPandas(processor, SCHEMA, "append", "none" if idle is None else "eventTime")
