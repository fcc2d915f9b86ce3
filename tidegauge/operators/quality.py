"""Data quality: profiles, scores, cleaning and monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from . import anomaly, windows
from .series import by_index, KEY, valid, val

DIMENSIONS = ("completeness", "consistency", "validity", "timeliness", "accuracy")
#: Weights of the dimensions and the score to pass, by profile (fixed values).
PROFILES = {
    "default": ((0.25, 0.20, 0.25, 0.15, 0.15), 70.0),
    "exploratory": ((0.30, 0.15, 0.20, 0.10, 0.25), 60.0),
    "production": ((0.25, 0.25, 0.25, 0.15, 0.10), 75.0),
    "regulatory": ((0.30, 0.25, 0.30, 0.10, 0.05), 90.0),
    "real_time": ((0.20, 0.15, 0.20, 0.35, 0.10), 70.0),
}


def profile(series: DataFrame, interval_s: float | None = None) -> DataFrame:
    """One row per series: counts, moments, span, intervals, gaps and completeness.

    ``expected`` points are the span over the interval (the median one if none is
    given), and one more, so a gapless series has a completeness of 1.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = series.withColumn("gap_s", (micros - F.lag(micros).over(by_index())) / 1e6)
    t = rows.groupBy(KEY).agg(
        F.count("*").alias("n"), F.count_if(val().isNull()).alias("n_missing"), F.avg(val()).alias("mean"), F.stddev_pop(val()).alias("std"), F.min(val()).alias("min"), F.max(val()).alias("max"),
        ((F.max(micros) - F.min(micros)) / 1e6).alias("span_s"), F.avg("gap_s").alias("interval_mean"), F.stddev_pop("gap_s").alias("interval_std"), F.percentile("gap_s", 0.5).alias("interval_median"),
    )
    usual = F.lit(interval_s) if interval_s else F.col("interval_median")
    t = t.withColumns({"interval": usual, "interval_cv": F.coalesce(safe_div(F.col("interval_std"), F.col("interval_mean")), F.lit(0.0))})
    gaps = rows.join(t.select(KEY, "interval"), KEY).groupBy(KEY).agg(F.count_if(F.col("gap_s") > 2 * F.col("interval")).alias("n_gaps"), F.max("gap_s").alias("largest_gap_s"))
    expected = F.coalesce(F.floor(safe_div(F.col("span_s"), F.col("interval")) + 0.5) + 1, F.col("n")).cast("long")
    t = t.join(gaps, KEY).withColumns({"expected": expected, "is_regular": F.col("interval_cv") < 0.1})
    return t.withColumn("completeness", F.least(F.lit(1.0), safe_div((F.col("n") - F.col("n_missing")).cast("double"), F.col("expected").cast("double"))))


def completeness_score(ratio: Column) -> Column:
    p = 100 * ratio
    return F.when(p >= 100, 100.0).when(p >= 85, p).when(p >= 70, 70 + 0.8 * (p - 70)).otherwise(0.7 * p)


def accuracy_score(outlier_percent: Column) -> Column:
    p = outlier_percent
    return F.when(p < 1, 100 - p).when(p < 3, 97 - 2 * (p - 1)).when(p < 7, 92 - 1.75 * (p - 3)).when(p < 15, 77 - 0.875 * (p - 7)).otherwise(F.greatest(F.lit(0.0), 70 - 0.5 * (p - 15)))


def scores(series: DataFrame, interval_s: float | None = None, profile_name: str = "default") -> DataFrame:
    """The five dimensions, their weighted mean, its grade and whether it passes; outliers by quartile distance."""
    p = profile(series, interval_s)
    out = anomaly.iqr(series).groupBy(KEY).agg(F.count("*").alias("n_outliers"))
    t = p.join(out, KEY, "left").withColumn("outlier_percent", F.coalesce(safe_div(100.0 * F.coalesce("n_outliers", F.lit(0)), (F.col("n") - F.col("n_missing")).cast("double")), F.lit(0.0)))
    cv = F.least(F.lit(5.0), F.coalesce(safe_div(F.col("std"), F.abs("mean")), F.lit(0.0)))
    reasonable = F.greatest(F.lit(0.0), 100 - 10 * cv)
    regular = F.greatest(F.lit(0.0), 100 - F.least(F.lit(100.0), 100 * F.col("interval_cv")))
    temporal = F.when(F.col("is_regular"), 100.0).otherwise(F.greatest(F.lit(0.0), 100 - 100.0 * F.col("n_gaps") / F.col("n")))
    pattern = 100 * (F.col("completeness") + 1 - F.least(F.lit(1.0), F.col("interval_cv")) + reasonable / 100) / 3
    matches = F.when(F.abs(F.col("interval_mean") - F.col("interval")) <= 0.01 * F.col("interval"), 100.0).when(F.col("interval_mean").isNull(), 50.0).otherwise(70.0)
    dims = {
        "completeness": completeness_score(F.col("completeness")),
        "consistency": 0.5 * temporal + 0.3 * F.greatest(F.lit(0.0), 100 - 2 * F.col("outlier_percent")) + 0.2 * pattern,
        "validity": 0.4 * F.when(F.col("max") > F.col("min"), 100.0).otherwise(50.0) + 30.0 + 0.3 * reasonable,
        "timeliness": F.when(F.col("n") < 2, 100.0).otherwise(0.6 * matches + 0.4 * regular),
        "accuracy": accuracy_score(F.col("outlier_percent")),
    }
    weights, least = PROFILES[profile_name]
    s = t.select(KEY, *[c.alias(k) for k, c in dims.items()])
    overall = sum((w * F.col(d) for w, d in zip(weights, DIMENSIONS, strict=True)), F.lit(0.0)) / sum(weights)
    s = s.withColumn("overall", overall)
    grade = F.when(F.col("overall") >= 90, "excellent").when(F.col("overall") >= 75, "good").when(F.col("overall") >= 60, "fair").otherwise("poor")
    return s.withColumns({"grade": grade, "passes": F.col("overall") >= least})


def recommendations(scored: DataFrame, least: float = 80.0) -> DataFrame:
    """A row for each dimension under ``least``, the worst first."""
    advice = {
        "completeness": "fill gaps and look for lost points", "consistency": "align points to a regular interval", "validity": "check the range and spread of the values",
        "timeliness": "check the arrival interval", "accuracy": "review and correct outliers",
    }
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score"), F.lit(advice[d]).alias("advice")) for d in DIMENSIONS])
    out = scored.select(KEY, F.explode(rows).alias("r")).select(KEY, "r.*").where(F.col("score") < least)
    priority = F.when(F.col("score") < 40, "critical").when(F.col("score") < 60, "high").otherwise("medium")
    return out.withColumn("priority", priority)


def clean(series: DataFrame, fill: str = "linear", outliers: str | None = None, smooth: int | None = None, budget: float = 0.3) -> DataFrame:
    """Optional treatment of outliers, then a fill, then optional smoothing; ``within_budget`` tells whether at most that share of a series changed."""
    out = series
    if outliers:
        out = anomaly.treat_outliers(out, anomaly.iqr(out), outliers).withColumn("original", val()).withColumn("value", F.col("cleaned")).drop("cleaned")
    else:
        out = out.withColumn("original", val())
    fills = {"linear": windows.linear_fill, "forward": windows.forward_fill, "backward": windows.backward_fill, "mean": lambda s: windows.statistic_fill(s, "mean"), "median": lambda s: windows.statistic_fill(s, "median"), "exponential": lambda s: windows.exponential_fill(s, 0.3)}
    out = fills[fill](out).withColumn("value", F.col("filled")).drop("filled")
    if smooth:
        out = windows.moving_average(out, smooth).withColumn("value", F.col("smooth")).drop("smooth")
    changed = F.coalesce(~F.col("original").eqNullSafe(val()), F.lit(False))
    share = out.groupBy(KEY).agg(F.avg(changed.cast("int")).alias("changed_share"))
    return out.withColumn("changed", changed).join(share, KEY).withColumn("within_budget", F.col("changed_share") <= budget)


def monitor(history: DataFrame, warn: float = 75.0, critical: float = 60.0, drop: float = 20.0) -> DataFrame:
    """Alerts on ``series_id, ts, score``: below a threshold, or a fall of over ``drop`` since the last measurement."""
    w = Window.partitionBy(KEY).orderBy("ts")
    h = history.withColumn("fall", F.lag("score").over(w) - F.col("score"))
    alert = F.when(F.col("score") < critical, "critical").when(F.col("fall") > drop, "sudden_drop").when(F.col("score") < warn, "warning")
    return h.withColumn("alert", alert)


def quality_trend(history: DataFrame, decline: float = -5.0) -> DataFrame:
    """Slope per day, the score expected in seven days (0 to 100), whether it declines, and points off by two deviations."""
    days = F.unix_seconds(F.col("ts").cast("timestamp")) / 86400.0
    t = history.withColumn("d", days).groupBy(KEY).agg(F.regr_slope("score", "d").alias("slope"), F.regr_intercept("score", "d").alias("a"), F.max("d").alias("end"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("*").alias("n"))
    ahead = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("a") + F.col("slope") * (F.col("end") + 7)))
    return t.select(KEY, "n", "mean", "std", "slope", ahead.alias("in_seven_days"), (F.col("slope") < decline).alias("is_declining"))


def windowed_scores(series: DataFrame, width: str) -> DataFrame:
    """Share of present values and of inliers in each tumbling window: a history to monitor."""
    marked = series.join(anomaly.iqr(series).select(KEY, "idx", F.lit(1).alias("out")), [KEY, "idx"], "left")
    score = 100 * F.avg((val().isNotNull() & F.col("out").isNull()).cast("double"))
    return marked.groupBy(KEY, F.window("ts", width).alias("w")).agg(score.alias("score"), F.count("*").alias("n")).select(KEY, F.col("w.start").alias("ts"), "score", "n")


def valid_share(series: DataFrame) -> DataFrame:
    n = valid(series).groupBy(KEY).agg(F.count("*").alias("n_valid"))
    return series.groupBy(KEY).agg(F.count("*").alias("n")).join(n, KEY, "left").select(KEY, "n", F.coalesce("n_valid", F.lit(0)).cast("long").alias("n_valid"))
