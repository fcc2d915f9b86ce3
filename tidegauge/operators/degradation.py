"""Decline of quality over time: falls, slopes, runs of bad windows, and distance from a baseline that learns.

A history is ``series_id, ts, score`` (0 to 100), one row for each measurement. Slopes and falls are window frames over time,
runs are islands: the rows of a run share the difference of two row numbers. The baseline folds each
history in time order; on streams the same class keeps its state in Spark's store.

Defined results: rows with a null score or time are left out; of equal times the order is by score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .series import KEY

DAY = 86_400


def _history(history: DataFrame) -> DataFrame:
    rows = history.select(KEY, F.col("ts").cast("timestamp").alias("ts"), F.col("score").cast("double").alias("score"))
    return rows.where(F.col("ts").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score")).withColumn("s", F.unix_seconds("ts"))


def sudden_drops(history: DataFrame, drop: float = 20.0, within: float = 7 * DAY) -> DataFrame:
    """Measurements that lie more than ``drop`` below the one before, which is at most ``within`` seconds older."""
    w = Window.partitionBy(KEY).orderBy("ts", "score")
    t = _history(history).withColumns({"before": F.lag("score").over(w), "gap": F.col("s") - F.lag("s").over(w)})
    return t.where((F.col("before") - F.col("score") > drop) & (F.col("gap") <= within)).select(KEY, "ts", "before", "score", (F.col("before") - F.col("score")).alias("drop"))


def gradual_decline(history: DataFrame, window: float = 30 * DAY, rate: float = -1.0, least: int = 3) -> DataFrame:
    """The regression slope (points a day) over the last ``window`` seconds at each measurement with ``least`` of them, and whether it is below ``rate``."""
    w = Window.partitionBy(KEY).orderBy("s").rangeBetween(-int(window), 0)
    days = F.col("s") / float(DAY)
    # times less the window's mean, so that large sums don't cancel
    t = _history(history).withColumn("d", days - F.floor(F.min("s").over(Window.partitionBy(KEY)) / float(DAY)))
    slope = F.covar_pop("d", "score").over(w) / F.nullif(F.var_pop("d").over(w), F.lit(0.0))
    t = t.withColumns({"slope": slope, "points": F.count("*").over(w)}).where((F.col("points") >= least) & F.col("slope").isNotNull())
    return t.select(KEY, "ts", "score", "slope", "points", (F.col("slope") < rate).alias("is_declining"))


def bad_runs(history: DataFrame, level: float = 75.0, least: int = 2) -> DataFrame:
    """Runs of ``least`` or more measurements in a row below ``level``: first and last time, how many, the worst and the mean score, and whether the history ends in it."""
    w = Window.partitionBy(KEY).orderBy("ts", "score")
    n = F.row_number().over(w)
    t = _history(history).withColumn("n", n).withColumn("all_of_them", F.max("n").over(Window.partitionBy(KEY))).where(F.col("score") < level)
    t = t.withColumn("run", F.col("n") - F.row_number().over(w))
    runs = t.groupBy(KEY, "run").agg(
        F.min("ts").alias("begin"), F.max("ts").alias("end"), F.count("*").alias("length"), F.min("score").alias("worst"), F.avg("score").alias("mean"), (F.max("n") == F.max("all_of_them")).alias("is_open")
    )
    return runs.where(F.col("length") >= least).drop("run")


SCHEMA = "series_id string, ts timestamp, score double, baseline double, deviation double, run long, phase string"
STATE = "n double, mean double, squares double, run long"


@dataclass
class Baseline:
    """Mean and deviation of the good measurements so far. One that lies ``limit`` deviations (of ``floor`` points at least) below is bad and isn't learned; ``patience`` of them in a row are a decline."""

    limit: float = 3.0
    floor: float = 2.0
    patience: int = 3
    learn: int = 5
    n: float = 0.0
    mean: float = 0.0
    squares: float = 0.0
    run: int = 0

    def push(self, score: float) -> tuple[float | None, float | None, int, str]:
        known = self.n >= self.learn
        spread = max(self.floor, math.sqrt(self.squares / self.n)) if self.n else self.floor
        away = (score - self.mean) / spread if known else None
        out = self.mean if known else None
        if known and away < -self.limit:
            self.run += 1
        else:
            self.run = 0
            self.n += 1
            d = score - self.mean
            self.mean += d / self.n
            self.squares += d * (score - self.mean)
        phase = "learning" if not known else "declined" if self.run >= self.patience else "suspect" if self.run else "good"
        return out, away, self.run, phase

    def rows(self, key: str, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["ts", "score"]).sort_values(["ts", "score"], kind="stable")
        found = [(key, ts, score, *self.push(float(score))) for ts, score in zip(pdf["ts"], pdf["score"], strict=True)]
        return pd.DataFrame(found, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def against_baseline(history: DataFrame, **options) -> DataFrame:
    """Each measurement with the baseline before it, its distance in deviations, the length of the bad run and the phase."""
    return _history(history).select(KEY, "ts", "score").groupBy(KEY).applyInPandas(lambda key, pdf: Baseline(**options).rows(key[0], pdf), SCHEMA)


class _Processor(StatefulProcessor):
    def __init__(self, options: dict):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("baseline", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        b = Baseline(**self.options)
        if self.state.exists():
            b.n, b.mean, b.squares, b.run = self.state.get()
        out = b.rows(key[0], pd.concat(list(rows)))
        self.state.update((float(b.n), float(b.mean), float(b.squares), int(b.run)))
        yield out

    def close(self) -> None:
        pass


def against_baseline_stream(history: DataFrame, **options) -> DataFrame:
    """The same rows from a stream; those of a micro-batch are taken in time order. Needs the RocksDB state store."""
    rows = history.select(KEY, "ts", F.col("score").cast("double").alias("score"))
    return rows.groupBy(KEY).transformWithStateInPandas(_Processor(options), SCHEMA, "append", "none")
