"""Lags, rolling statistics, fills, smoothing, resampling and gaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.expr import safe_div
from .series import by_index, KEY, valid


def all_before() -> WindowSpec:
    return by_index().rowsBetween(Window.unboundedPreceding, 0)


def all_after() -> WindowSpec:
    """All rows from this one on, the last one first: a frame that grows, where one to UNBOUNDED FOLLOWING is read again for each row."""
    return Window.partitionBy(KEY).orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)


def trailing(k: int):
    return by_index().rowsBetween(-(k - 1), 0)


def centred(half: int):
    return by_index().rowsBetween(-half, half)


def lags(series: DataFrame, steps: list[int]) -> DataFrame:
    return series.withColumns({f"lag_{k}": F.lag("value", k).over(by_index()) for k in steps})


def rolling(series: DataFrame, k: int, stats: list[str], quantiles: list[float] = ()) -> DataFrame:
    """``rolling_{k}_{stat}``: mean, median, std (population), min, max, skewness, kurtosis, and nearest-rank quantiles; null before the window is full."""
    v, w = F.col("value"), trailing(k)
    of = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "skewness": F.skewness, "kurtosis": F.kurtosis, "median": lambda c: F.percentile(c, 0.5)}
    full = F.count(F.lit(1)).over(w) == k
    out = {f"rolling_{k}_{s}": F.when(full, of[s](v).over(w)) for s in stats}
    for q in quantiles:
        ordered = F.array_sort(F.collect_list(v).over(w))
        out[f"rolling_{k}_{q:g}q"] = F.when(full, F.element_at(ordered, round(q * (k - 1)) + 1))
    return series.withColumns(out)


def expanding_head(series: DataFrame, k: int) -> DataFrame:
    """Trailing mean, deviation and median over up to ``k`` rows; the first rows use what there is."""
    w, v = trailing(k), F.col("value")
    return series.withColumns({"ma": F.avg(v).over(w), "mstd": F.stddev_pop(v).over(w), "mmedian": F.percentile(v, 0.5).over(w)})


def trend_features(series: DataFrame) -> DataFrame:
    v, one = F.col("value"), F.lag("value", 1).over(by_index())
    return series.withColumns({"trend": F.col("idx"), "trend_squared": F.col("idx") * F.col("idx"), "first_diff": v - one, "second_diff": v - 2 * one + F.lag("value", 2).over(by_index())})


def rate_of_change(series: DataFrame, k: int, scale: float = 1.0) -> DataFrame:
    """Change per step over ``k`` steps, and its own change."""
    rate = (F.col("value") - F.lag("value", k).over(by_index())) / k * scale
    out = series.withColumn("rate", rate)
    return out.withColumn("acceleration", F.col("rate") - F.lag("rate").over(by_index()))


def _known(v: Column) -> Column:
    return F.when(F.abs(v) != F.lit(float("inf")), v)


def forward_fill(series: DataFrame) -> DataFrame:
    """Infinite values count as missing; a missing head stays."""
    return series.withColumn("filled", F.last(_known(F.col("value")), True).over(all_before()))


def backward_fill(series: DataFrame) -> DataFrame:
    return series.withColumn("filled", F.last(_known(F.col("value")), True).over(all_after()))


def linear_fill(series: DataFrame, by: str = "idx") -> DataFrame:
    """Interior gaps on the line between their neighbours, by index or by time (``by="ts"``)."""
    v = _known(F.col("value"))
    at = F.col("idx").cast("double") if by == "idx" else F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    here = F.when(v.isNotNull(), at)
    v0, v1 = F.last(v, True).over(all_before()), F.last(v, True).over(all_after())
    t0, t1 = F.last(here, True).over(all_before()), F.last(here, True).over(all_after())
    return series.withColumn("filled", F.coalesce(v, v0 + (v1 - v0) * safe_div(at - t0, t1 - t0)))


def statistic_fill(series: DataFrame, statistic: str = "mean") -> DataFrame:
    """The series' mean or median, for all missing values."""
    agg = F.avg("value") if statistic == "mean" else F.percentile("value", 0.5)
    total = series.groupBy(KEY).agg(agg.alias("total"))
    return series.join(total, KEY).withColumn("filled", F.coalesce("value", "total")).drop("total")


def constant_fill(series: DataFrame, value: float) -> DataFrame:
    return series.withColumn("filled", F.coalesce("value", F.lit(float(value))))


def window_fill(series: DataFrame, size: int = 5, statistic: str = "mean") -> DataFrame:
    """Mean or median of the values within half a window; fills don't feed each other."""
    w, v = centred(size // 2), _known(F.col("value"))
    agg = F.avg(v) if statistic == "mean" else F.percentile(v, 0.5)
    return series.withColumn("filled", F.coalesce(v, agg.over(w)))


def _levels(series: DataFrame, alpha: float) -> DataFrame:
    """``level``: the exponentially weighted mean of the values so far, null before the first; a series at a time, linear in its length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        return pdf[[KEY, "idx"]].assign(level=pdf["value"].ewm(alpha=alpha, adjust=False, ignore_na=True).mean())

    return series.select(KEY, "idx", "value").groupBy(KEY).applyInPandas(run, "series_id string, idx long, level double")


def exponential_fill(series: DataFrame, alpha: float) -> DataFrame:
    """Missing values take the exponentially weighted mean of the values before them."""
    return series.join(_levels(series, alpha), [KEY, "idx"]).withColumn("filled", F.coalesce("value", "level")).drop("level")


def ewma(series: DataFrame, alpha: float) -> DataFrame:
    """Exponentially weighted mean of all values so far."""
    return series.join(_levels(series, alpha), [KEY, "idx"]).select(KEY, "idx", "ts", "value", F.col("level").alias("smooth"))


def moving_average(series: DataFrame, size: int) -> DataFrame:
    """Centred, with shorter windows at both ends."""
    return series.withColumn("smooth", F.avg(_known(F.col("value"))).over(centred(size // 2)))


def median_filter(series: DataFrame, size: int) -> DataFrame:
    return series.withColumn("smooth", F.percentile(_known(F.col("value")), 0.5).over(centred(size // 2)))


def weighted_average(series: DataFrame, weights: list[float]) -> DataFrame:
    """Weighted sum of the neighbours; the middle weight is the row's own; null where a neighbour is missing."""
    half = len(weights) // 2
    total = F.lit(0.0)
    for j, w in enumerate(weights):
        total = total + w * (F.lag("value", half - j).over(by_index()) if j != half else F.col("value"))
    return series.withColumn("smooth", total / sum(weights))


def zscore_normalize(series: DataFrame) -> DataFrame:
    """0 where the deviation is 0."""
    t = series.groupBy(KEY).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return series.join(t, KEY).withColumn("normalized", F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).when(F.col("value").isNotNull(), 0.0)).drop("m", "s")


def minmax_normalize(series: DataFrame) -> DataFrame:
    """0.5 where all values are equal."""
    t = series.groupBy(KEY).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return series.join(t, KEY).withColumn("normalized", F.when(F.col("hi") - F.col("lo") > 1e-15, (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).when(F.col("value").isNotNull(), 0.5)).drop("lo", "hi")


_AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "first": lambda c: F.min_by(c, "ts"), "last": lambda c: F.max_by(c, "ts")}


def resample(series: DataFrame, width: str, how: str = "mean") -> DataFrame:
    """A row for each tumbling window that has a value."""
    return series.groupBy(KEY, F.window("ts", width).alias("w")).agg(_AGGREGATES[how](F.col("value")).alias("value")).select(KEY, F.col("w.start").alias("ts"), "value")


def regular_spine(series: DataFrame, width: str) -> DataFrame:
    """Every window start between a series' first and last, with a null value where it has none."""
    ends = series.groupBy(KEY).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    spine = ends.select(KEY, F.explode(F.sequence("a", "b", F.expr(f"interval {width}"))).alias("ts"))
    return spine.join(series.select(KEY, "ts", "value"), [KEY, "ts"], "left")


def upsample(series: DataFrame, width: str, how: str = "linear") -> DataFrame:
    """A regular spine, filled forward, backward or on the line between neighbours."""
    from .series import with_index

    spine = with_index(regular_spine(series, width))
    return {"linear": linear_fill, "forward": forward_fill, "backward": backward_fill}[how](spine)


def _gap_seconds() -> Column:
    return (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by_index()).cast("timestamp"))) / 1e6


def gaps(series: DataFrame, factor: float = 1.5, first: int | None = 10) -> DataFrame:
    """Intervals longer than ``factor`` times the median of the first ``first`` intervals (of all: None)."""
    spaced = series.withColumns({"gap_start": F.lag("ts").over(by_index()), "gap_s": _gap_seconds()}).where("gap_s is not null")
    base = spaced if first is None else spaced.where(F.col("idx") <= first)
    usual = base.groupBy(KEY).agg(F.percentile("gap_s", 0.5).alias("usual_s"))
    found = spaced.join(usual, KEY).where(F.col("gap_s") > factor * F.col("usual_s"))
    return found.select(KEY, "gap_start", F.col("ts").alias("gap_end"), "gap_s", (F.floor(safe_div(F.col("gap_s"), F.col("usual_s")) + 0.5) - 1).cast("long").alias("missing_points"))


def temporal_coverage(series: DataFrame) -> DataFrame:
    """Mean, deviation and variation of the intervals; regular below a variation of 0.1."""
    t = series.withColumn("gap_s", _gap_seconds()).groupBy(KEY).agg(F.count("*").alias("n"), F.avg("gap_s").alias("mean_s"), F.stddev_pop("gap_s").alias("std_s"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    cv = safe_div(F.col("std_s"), F.col("mean_s"))
    return t.withColumns({"cv": cv, "is_regular": F.coalesce(cv < 0.1, F.lit(False))})


def average_ranks(df: DataFrame, column: str, by: list[str], name: str = "rank") -> DataFrame:
    """Ranks from 1; ties share their mean rank."""
    w = Window.partitionBy(*by).orderBy(column)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2)


def time_windows(df: DataFrame, ts: str, size: str, slide: str | None = None) -> DataFrame:
    """Adds ``window``: tumbling, or sliding with ``slide``."""
    return df.withColumn("window", F.window(ts, size, slide) if slide else F.window(ts, size))


def session_windows(df: DataFrame, key: str, ts: str, value: str, gap: str) -> DataFrame:
    return df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def around(series: DataFrame, share: int = 10, least: int = 5, most: int = 20, gap: int = 0) -> DataFrame:
    """Mean and population variance of the ``w`` values before each point (``m0``, ``v0``) and of the ``w`` from ``gap`` points on (``m1``, ``v1``), where n - 2 w points have both.

    ``w`` is a ``share``-th of a series' values, rounded down, within ``least`` and ``most``. All widths are read from prefix sums in one pass.
    """
    rows = valid(series).withColumn("i", F.row_number().over(by_index()) - 1)
    t = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    rows = rows.join(t, KEY).withColumn("w", F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.col("n") / share))).cast("int"))
    x, upto = F.col("value") - F.col("m"), by_index().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"p1": F.sum(x).over(upto), "p2": F.sum(x * x).over(upto)})

    def at(name: str, offsets: list[int]) -> Column:
        """The prefix sum as many rows on as the entry for this width says; none lies before the first row."""
        read = [F.coalesce(F.lead(name, k).over(by_index()) if k >= 0 else F.lag(name, -k).over(by_index()), F.lit(0.0)) for k in offsets]
        return F.element_at(F.array(*read), F.col("w") - least + 1)

    widths = range(least, most + 1)
    ends = {"a": [-w - 1 for w in widths], "b": [-1] * len(widths), "c": [gap - 1] * len(widths), "d": [gap + w - 1 for w in widths]}
    rows = rows.withColumns({f"{k}{p}": at(f"p{p}", o) for k, o in ends.items() for p in (1, 2)})
    w = F.col("w")
    before, after = ((F.col("b1") - F.col("a1")) / w, (F.col("b2") - F.col("a2")) / w), ((F.col("d1") - F.col("c1")) / w, (F.col("d2") - F.col("c2")) / w)
    rows = rows.withColumns({"m0": F.col("m") + before[0], "v0": F.greatest(before[1] - before[0] ** 2, F.lit(0.0)), "m1": F.col("m") + after[0], "v1": F.greatest(after[1] - after[0] ** 2, F.lit(0.0))})
    drop = [f"{k}{p}" for k in ends for p in (1, 2)] + ["p1", "p2", "m"]
    return rows.where((F.col("i") >= w) & (F.col("i") < F.col("n") - w)).drop(*drop)
