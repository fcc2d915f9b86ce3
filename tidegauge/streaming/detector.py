"""A detector that sees one point at a time, with its state kept by key.

The window holds the last ``size`` values, the current one included. A point is an
anomaly when its score exceeds the threshold; with ``adaptive`` the threshold rises
after anomalies and falls a little after near misses, within bounds. The same object
serves a stream (state in Spark's store) and the replay of a table.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "series_id string, ts timestamp, value double, score double, severity string, expected double, threshold double"


def _between(low, high, part):  # noqa: ANN001, ANN202
    """``low * (1 - part) + high * part`` of numbers or columns, and what rounding lost of the first product (where ``part`` is in quarters) and of the sum.

    Without it the last place is off now and then, which decides for points that lie on a threshold.
    """
    a, b = low * (1 - part), high * part
    total = a + b
    of_b = total - a
    return total, (a - (total - of_b)) + (b - of_b) + ((low - a) - low * part)


def _quantile_of(ordered: np.ndarray, q: float) -> float:
    at = (len(ordered) - 1) * q
    low, part = ordered[math.floor(at)], at - math.floor(at)
    if part == 0:
        return float(low)
    with np.errstate(invalid="ignore"):
        total, lost = _between(low, ordered[math.ceil(at)], part)
    return float(total + lost if np.isfinite(lost) else total)


@dataclass
class Detector:
    method: str = "zscore"
    threshold: float = 3.0
    size: int = 100
    factor: float = 1.5
    short: int = 10
    adaptive: bool = False
    rate: float = 0.1
    sensitivity: float = 1.0
    least_samples: int = 30
    lowest: float = 1.0
    highest: float = 10.0
    seen: int = 0
    window: list[float] = field(default_factory=list)

    def _score(self, v: float) -> float:
        x = np.array(self.window)
        if len(x) < 2:
            return 0.0
        if self.method in ("zscore", "adaptive"):
            s = x.std()
            return abs(v - x.mean()) / s if s > 0 else 0.0
        if self.method == "modified_zscore":
            med = float(np.median(x))
            mad = float(np.median(np.abs(x - med)))
            return 0.6745 * abs(v - med) / mad if med != 0 and mad > 0 else 0.0
        if self.method == "iqr":
            q1, q3 = _quantile_of(np.sort(x), 0.25), _quantile_of(np.sort(x), 0.75)
            wide = q3 - q1
            return float(max(0.0, q1 - self.factor * wide - v, v - q3 - self.factor * wide) / wide) if wide > 0 else 0.0
        if self.method == "volatility":
            near, all_ = np.diff(x[-self.short :]), np.diff(x)
            if len(x) < self.short or len(near) < 2 or all_.std() == 0:
                return 0.0
            return float(near.std() / all_.std())
        raise ValueError(self.method)

    def push(self, v: float) -> tuple[float, str, float, float] | None:
        """Score, severity, expected value and threshold of an anomaly, else None."""
        if v is None or np.isnan(v):
            return None
        self.window = [*self.window, float(v)][-self.size :]
        self.seen += 1
        score, limit = self._score(float(v)), self.threshold
        hit = score > limit
        if self.adaptive and self.seen >= self.least_samples:
            step = self.rate * self.sensitivity
            if hit:
                self.threshold *= 1 + step
            elif score > 0.8 * limit:
                self.threshold *= 1 - step / 2
            self.threshold = min(self.highest, max(self.lowest, self.threshold))
        if not hit:
            return None
        ratio = score / limit
        grade = "critical" if ratio >= 2.5 else "high" if ratio >= 2 else "medium" if ratio >= 1.5 else "low"
        return score, grade, float(np.mean(self.window)), limit

    def run(self, key: str, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for ts, v in zip(pdf["ts"], pdf["value"], strict=True):
            if (found := self.push(v)) is not None:
                rows.append((key, ts, v, *found))
        return pd.DataFrame(rows, columns=["series_id", "ts", "value", "score", "severity", "expected", "threshold"])


def detect_stream(events: DataFrame, idle_ms: int | None = None, **options) -> DataFrame:
    """Anomalies of a stream of ``series_id, ts, value``; points of a micro-batch are taken in time order. A series without points for ``idle_ms`` of processing time is forgotten."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        detector = Detector(**(json.loads(state.get[0]) if state.exists else options))
        pdf = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = detector.run(key[0], pdf)
        state.update((json.dumps(asdict(detector)),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out

    kind = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("series_id").applyInPandasWithState(step, SCHEMA, "detector string", "append", kind)


def _quantile(ordered: Column, q: float) -> Column:
    """Linear between the two nearest of an ordered array."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low = F.element_at(ordered, (F.floor(at) + 1).cast("int"))
    high = F.element_at(ordered, (F.ceil(at) + 1).cast("int"))
    part = at - F.floor(at)
    total, lost = _between(low, high, part)
    return F.when(part == 0, low).otherwise(total + F.nanvl(lost, F.lit(0.0)))


def _score(method: str, size: int, factor: float, short: int) -> tuple[Column, dict[str, Column]]:
    """The score of a point within the frame of the last ``size`` rows, and the columns it needs."""
    by = Window.partitionBy("series_id").orderBy("ts")
    last = by.rowsBetween(1 - size, 0)
    v, held = F.col("value"), F.array_sort(F.collect_list("value").over(last))
    if method == "zscore":
        needs = {"mean": F.avg("value").over(last), "spread": F.stddev_pop("value").over(last)}
        return F.when(F.col("spread") > 0, F.abs(v - F.col("mean")) / F.col("spread")), needs
    if method == "modified_zscore":
        median = _quantile(F.col("held"), 0.5)
        needs = {"held": held, "median": median, "mad": _quantile(F.array_sort(F.transform("held", lambda x: F.abs(x - F.col("median")))), 0.5)}
        return F.when((F.col("median") != 0) & (F.col("mad") > 0), 0.6745 * F.abs(v - F.col("median")) / F.col("mad")), needs
    if method == "iqr":
        needs = {"held": held, "q1": _quantile(F.col("held"), 0.25), "q3": _quantile(F.col("held"), 0.75)}
        wide = F.col("q3") - F.col("q1")
        return F.when(wide > 0, F.greatest(F.lit(0.0), F.col("q1") - factor * wide - v, v - F.col("q3") - factor * wide) / wide), needs
    if method == "volatility":
        needs = {
            "d": v - F.lag("value").over(by), "n": F.count("value").over(last),
            "near": F.stddev_pop("d").over(by.rowsBetween(2 - short, 0)), "all_of_it": F.stddev_pop("d").over(by.rowsBetween(2 - size, 0)),
        }
        return F.when((F.col("n") >= short) & (F.lit(short) > 2) & (F.col("all_of_it") > 0), F.col("near") / F.col("all_of_it")), needs
    raise ValueError(method)


def _framed(series: DataFrame, method: str = "zscore", threshold: float = 3.0, size: int = 100, factor: float = 1.5, short: int = 10) -> DataFrame:
    """What :class:`Detector` finds with a fixed threshold, as window frames of the last ``size`` values."""
    rows = series.select("series_id", F.col("ts").cast("timestamp").alias("ts"), "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    score, needs = _score(method, size, factor, short)
    for name, c in needs.items():
        rows = rows.withColumn(name, c)
    last = Window.partitionBy("series_id").orderBy("ts").rowsBetween(1 - size, 0)
    ratio = F.col("score") / threshold
    grade = F.when(ratio >= 2.5, "critical").when(ratio >= 2, "high").when(ratio >= 1.5, "medium").otherwise("low")
    found = rows.withColumn("expected", F.avg("value").over(last)).withColumn("score", score).where(F.col("score") > threshold)
    return found.select("series_id", "ts", "value", "score", grade.alias("severity"), "expected", F.lit(float(threshold)).alias("threshold"))


def replay(series: DataFrame, **options) -> DataFrame:
    """The same anomalies from a table: window frames, or with ``adaptive`` a series at a time, since its threshold moves with what it finds."""
    if not options.get("adaptive") and options.get("method", "zscore") != "adaptive":
        return _framed(series, **{k: v for k, v in options.items() if k in ("method", "threshold", "size", "factor", "short")})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return Detector(**options).run(key[0], pdf.sort_values("ts", kind="stable"))

    return series.select("series_id", F.col("ts").cast("timestamp").alias("ts"), "value").groupBy("series_id").applyInPandas(run, SCHEMA)
