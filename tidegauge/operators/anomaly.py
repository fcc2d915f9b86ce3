"""Anomaly detectors as window and aggregate expressions.

Each detector returns one row per anomaly: ``series_id, idx, ts, value, score,
severity, expected, method``. Missing and infinite values are left out first, and
``idx`` is the place in the whole series. Scores that would divide by zero are null.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.expr import safe_div, severity, severity_level
from .series import KEY, valid, val

COLUMNS = (KEY, "idx", "ts", "value", "score", "severity", "expected", "method")


def _by_v() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy("vi")


def _dense(series: DataFrame) -> DataFrame:
    """Valid rows, numbered from 0 as ``vi``."""
    return valid(series).withColumn("vi", F.row_number().over(Window.partitionBy(KEY).orderBy("idx")) - 1)


def _with(rows: DataFrame, *totals: Column) -> DataFrame:
    return rows.join(rows.groupBy(KEY).agg(F.count("*").alias("n"), *totals), KEY)


def _found(rows: DataFrame, method: str, hit: Column, score: Column, graded: Column, expected: Column | None = None) -> DataFrame:
    rows = rows.withColumns({"score": score, "severity": graded, "expected": (F.lit(None) if expected is None else expected).cast("double"), "method": F.lit(method)})
    return rows.where(hit).select(*COLUMNS)


def zscore(series: DataFrame, threshold: float = 3.0) -> DataFrame:
    rows = _with(valid(series), F.avg(val()).alias("m"), F.stddev_pop(val()).alias("s"))
    z = safe_div(F.abs(val() - F.col("m")), F.col("s"))
    return _found(rows, "zscore", (F.col("n") >= 3) & (z > threshold), z, severity(z / threshold, 1.2, 1.5, 2.0), F.col("m"))


def modified_zscore(series: DataFrame, threshold: float = 3.5) -> DataFrame:
    rows = _with(valid(series), F.percentile(val(), 0.5).alias("med"))
    rows = rows.withColumn("dev", F.abs(val() - F.col("med")))
    rows = rows.join(rows.groupBy(KEY).agg(F.percentile("dev", 0.5).alias("mad")), KEY)
    z = safe_div(0.6745 * F.col("dev"), F.col("mad"))
    return _found(rows, "modified_zscore", (F.col("n") >= 3) & (z > threshold), z, severity(z / threshold, 1.2, 1.5, 2.0), F.col("med"))


def iqr(series: DataFrame, factor: float = 1.5) -> DataFrame:
    """Beyond the quartiles by ``factor`` times their distance; the score is the excess in such distances."""
    rows = _with(valid(series), F.percentile(val(), [0.25, 0.75]).alias("q"))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    wide = q3 - q1
    low, high = q1 - factor * wide, q3 + factor * wide
    score = safe_div(F.greatest(low - val(), val() - high), wide)
    return _found(rows, "iqr", (F.col("n") >= 4) & ((val() < low) | (val() > high)), score, severity(score / factor, 1.5, 2.0, 3.0), (q1 + q3) / 2)


def grubbs(series: DataFrame, critical_t: float = 1.96) -> DataFrame:
    """One pass of Grubbs' test with the given critical t value."""
    rows = _with(valid(series), F.avg(val()).alias("m"), F.stddev_pop(val()).alias("s"))
    n = F.col("n")
    limit = (n - 1) / F.sqrt(n) * F.sqrt(critical_t**2 / (n - 2 + critical_t**2))
    g = safe_div(F.abs(val() - F.col("m")), F.col("s"))
    return _found(rows.where(n >= 3), "grubbs", g > limit, g, severity(g / limit, 1.2, 1.5, 2.0), F.col("m"))


def seasonal_decomposition(series: DataFrame, period: int) -> DataFrame:
    """Residuals of a centred moving average and centred seasonal means, beyond their mean by two deviations."""
    half = period // 2
    rows = _dense(series).withColumn("trend", F.avg(val()).over(_by_v().rowsBetween(-half, half))).withColumn("phase", F.col("vi") % period)
    seasonal = rows.groupBy(KEY, "phase").agg(F.avg(val()).alias("sm"))
    total = seasonal.groupBy(KEY).agg(F.avg("sm").alias("gm"))
    rows = rows.join(seasonal, [KEY, "phase"]).join(total, KEY).withColumn("expected_v", F.col("trend") + F.col("sm") - F.col("gm"))
    rows = _with(rows.withColumn("r", F.abs(val() - F.col("expected_v"))), F.avg("r").alias("rm"), F.stddev_pop("r").alias("rs"))
    score = safe_div(F.col("r") - F.col("rm"), F.col("rs"))
    return _found(rows, "seasonal", (F.col("n") >= 2 * period) & (score > 2), score, severity(score, 1.5, 2.0, 3.0), F.col("expected_v"))


def trend_deviation(series: DataFrame, window: int = 10) -> DataFrame:
    """Points off the line of the ``window`` points before by two of their deviations, or where the slope changes by as much."""
    before, after = _by_v().rowsBetween(-window, -1), _by_v().rowsBetween(1, window)
    x = F.col("vi").cast("double")
    rows = _dense(series).withColumns({
        "b0": F.regr_slope(val(), x).over(before), "a0": F.regr_intercept(val(), x).over(before), "s0": F.stddev_pop(val()).over(before),
        "b1": F.regr_slope(val(), x).over(after), "n0": F.count(val()).over(before), "n1": F.count(val()).over(after),
    })
    line = F.col("a0") + F.col("b0") * x
    off = safe_div(F.abs(val() - line), F.col("s0"))
    turn = safe_div(F.abs(F.col("b1") - F.col("b0")), F.col("s0"))
    score = F.greatest(off, turn)
    return _found(rows, "trend_deviation", (F.col("n0") == window) & (F.col("n1") == window) & (score > 2), score, severity(score, 1.5, 2.5, 4.0), line)


def level_shift(series: DataFrame, threshold: float = 2.0) -> DataFrame:
    """The means of the w points before and after a point, over their mean deviation (0.001 at least); w is a tenth of the values, within 5 and 20. Ten values at least."""
    from .windows import around

    rows = around(series, gap=1).where("n >= 10")
    score = F.abs(F.col("m1") - F.col("m0")) / F.greatest((F.sqrt("v0") + F.sqrt("v1")) / 2, F.lit(0.001))
    return _found(rows, "level_shift", score > threshold, score, severity(score, 2.0, 3.0, 5.0), F.col("m0"))


def volatility(series: DataFrame, window: int = 10) -> DataFrame:
    """Deviation of the changes around a point against that of all changes up to ``window`` before it: over twice or under half."""
    half = window // 2
    rows = _dense(series).withColumn("d", F.abs(val() - F.lag("value").over(_by_v())))
    rows = rows.withColumns({"near": F.stddev_pop("d").over(_by_v().rowsBetween(-half, half)), "past": F.stddev_pop("d").over(_by_v().rowsBetween(Window.unboundedPreceding, -window))})
    ratio = safe_div(F.col("near"), F.col("past"))
    return _found(rows, "volatility", (F.col("vi") >= 2 * window) & ((ratio > 2) | (ratio < 0.5)), F.greatest(ratio, safe_div(F.lit(1.0), ratio)), severity(F.greatest(ratio, safe_div(F.lit(1.0), ratio)), 1.5, 2.0, 3.0))


def _profile(series: DataFrame, method: str, slot: Column, base: int, threshold: float) -> DataFrame:
    rows = _dense(series).withColumn("slot", slot)
    usual = rows.where(F.col("vi") < base).groupBy(KEY, "slot").agg(F.count("*").alias("k"), F.avg(val()).alias("m"), F.greatest(F.stddev_pop(val()), F.lit(0.1)).alias("s")).where("k >= 2")
    z = F.abs(val() - F.col("m")) / F.col("s")
    return _found(rows.where(F.col("vi") >= base).join(usual, [KEY, "slot"]), method, z > threshold, z, severity(z / threshold, 1.5, 2.0, 2.5), F.col("m"))


def day_of_week(series: DataFrame, base: int) -> DataFrame:
    """Against the profile of weekdays in the first ``base`` points."""
    return _profile(series, "day_of_week", F.weekday("ts"), base, 3.0)


def hourly_pattern(series: DataFrame, base: int) -> DataFrame:
    return _profile(series, "hourly", F.hour("ts"), base, 2.5)


def seasonal_context(series: DataFrame, periods: list[int]) -> DataFrame:
    """Against the profile of each place in a period; of several periods the largest score counts."""
    out = None
    for p in periods:
        rows = _dense(series).withColumn("slot", F.col("vi") % p)
        usual = rows.groupBy(KEY, "slot").agg(F.avg(val()).alias("m"), F.greatest(F.stddev_pop(val()), F.lit(0.1)).alias("s"))
        z = F.abs(val() - F.col("m")) / F.col("s")
        rows = _with(rows).join(usual, [KEY, "slot"])
        one = _found(rows, "seasonal_context", (F.col("n") >= 3 * p) & (F.col("vi") >= p) & (z > 3), z, severity(z / 3, 1.5, 2.0, 2.5), F.col("m"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(KEY, "idx").agg(F.max_by(F.struct(*COLUMNS[2:]), "score").alias("r")).select(KEY, "idx", "r.*").select(*COLUMNS)


def multivariate(a: DataFrame, b: DataFrame, half: int = 10) -> DataFrame:
    """Times at which the local correlation of two series departs from the global one by over 0.5."""
    from .series import align_on_time

    both = align_on_time(a, b).where("x is not null and y is not null").withColumn(KEY, F.lit("pair"))
    w = Window.partitionBy(KEY).orderBy("ts").rowsBetween(-half, half)
    r = lambda over: safe_div(F.covar_pop("x", "y").over(over), F.stddev_pop("x").over(over) * F.stddev_pop("y").over(over))
    every = both.groupBy(KEY).agg(safe_div(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r"))
    out = both.withColumn("local", r(w)).join(every, KEY).withColumn("score", F.abs(F.col("local") - F.col("r")))
    return out.where("score > 0.5").select("ts", "x", "y", "local", "r", "score", severity(F.col("score"), 0.4, 0.6, 0.8).alias("severity"))


def index_iqr(series: DataFrame, factor: float = 1.5) -> DataFrame:
    """Quartiles at the places n/4 and 3n/4 of the ordered values."""
    rows = _with(valid(series)).withColumn("i", F.row_number().over(Window.partitionBy(KEY).orderBy("value")) - 1)
    q = rows.groupBy(KEY).agg(F.max(F.when(F.col("i") == F.floor(F.col("n") / 4), val())).alias("q1"), F.max(F.when(F.col("i") == F.floor(3 * F.col("n") / 4), val())).alias("q3"))
    rows, wide = rows.join(q, KEY), F.col("q3") - F.col("q1")
    low, high = F.col("q1") - factor * wide, F.col("q3") + factor * wide
    score = safe_div(F.greatest(low - val(), val() - high), wide)
    return _found(rows, "index_iqr", (val() < low) | (val() > high), score, severity(score / factor, 1.5, 2.0, 3.0), (F.col("q1") + F.col("q3")) / 2)


def three_sigma(series: DataFrame) -> DataFrame:
    return zscore(series, 3.0).withColumn("method", F.lit("three_sigma"))


def temporal_iqr(series: DataFrame, window: int, factor: float = 1.5) -> DataFrame:
    """Against the quartiles (by place) of the ``window`` points before."""
    before = F.array_sort(F.collect_list("value").over(_by_v().rowsBetween(-window, -1)))
    rows = _dense(series).withColumn("prev", before).where(F.col("vi") >= window)
    q1, q3 = F.try_element_at("prev", F.lit(window // 4 + 1)), F.try_element_at("prev", F.lit(3 * window // 4 + 1))
    off = F.greatest(q1 - factor * (q3 - q1) - val(), val() - q3 - factor * (q3 - q1))
    score = safe_div(off, q3 - q1)
    return _found(rows, "temporal_iqr", off > 0, score, severity(score / factor, 1.5, 2.0, 3.0))


DETECTORS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f for f in (zscore, modified_zscore, iqr, grubbs, seasonal_decomposition, trend_deviation, level_shift, volatility, day_of_week, hourly_pattern, seasonal_context, index_iqr, three_sigma, temporal_iqr)
}


def combine(found: DataFrame, how: str = "maximum") -> DataFrame:
    """One row for each point: the largest score, the mean score, or the mean score with the severity that most methods give (of equals the higher)."""
    if how == "maximum":
        return found.groupBy(KEY, "idx").agg(F.max_by(F.struct(*COLUMNS[2:]), F.struct("score", "method")).alias("r"), F.count("*").alias("n_methods")).select(KEY, "idx", "r.*", "n_methods").select(*COLUMNS, "n_methods")
    first = F.min_by(F.struct("ts", "value", "severity", "expected", "method"), "method").alias("r")
    mean = found.groupBy(KEY, "idx").agg(first, F.avg("score").alias("score"), F.count("*").alias("n_methods"))
    if how == "voting":
        votes = found.groupBy(KEY, "idx", "severity").count().groupBy(KEY, "idx").agg(F.max_by("severity", F.struct("count", severity_level(F.col("severity")))).alias("voted"))
        mean = mean.join(votes, [KEY, "idx"])
    graded = F.col("voted") if how == "voting" else F.col("r.severity")
    return mean.select(KEY, "idx", "r.ts", "r.value", "score", graded.alias("severity"), "r.expected", "r.method", "n_methods")


def top(found: DataFrame, n: int = 10) -> DataFrame:
    """The n largest scores of each series, ties to the earlier point."""
    w = Window.partitionBy(KEY).orderBy(F.desc("score"), "idx")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def reclassify(found: DataFrame, medium: float = 2.0, high: float = 3.0, critical: float = 4.0) -> DataFrame:
    return found.withColumn("severity", severity(F.col("score"), medium, high, critical))


def detect(series: DataFrame, methods: dict[str, dict] | None = None, how: str = "maximum", most: int | None = 10) -> DataFrame:
    """All methods (by default zscore and iqr), combined by point, ranked, cut to the ``most`` best of each series and graded by score."""
    found = None
    for name, options in (methods or {"zscore": {}, "iqr": {}}).items():
        one = DETECTORS[name](series, **options)
        found = one if found is None else found.unionByName(one)
    combined = combine(found, how)
    return reclassify(top(combined, most) if most else combined)


def ensemble_vote(series: DataFrame, methods: dict[str, dict], share: float = 0.5) -> DataFrame:
    """Points that at least ``share`` of the methods find, with their mean score."""
    combined = combine(_union([DETECTORS[n](series, **o) for n, o in methods.items()]), "mean")
    return combined.where(F.col("n_methods") >= share * len(methods))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def statistics(found: DataFrame) -> DataFrame:
    """Counts by severity, and extremes, mean and deviation of the scores."""
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("low", "medium", "high", "critical")]
    return found.groupBy(KEY).agg(F.count("*").alias("n"), *counts, F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))


def temporal_patterns(found: DataFrame) -> DataFrame:
    """Counts by hour, weekday (Monday 0) and month, and the peak of each: of equals the later one."""
    parts = {"hour": F.hour("ts"), "weekday": F.weekday("ts"), "month": F.month("ts")}
    long = _union([found.select(KEY, F.lit(k).alias("part"), c.cast("int").alias("slot")) for k, c in parts.items()])
    counts = long.groupBy(KEY, "part", "slot").count()
    peak = counts.groupBy(KEY, "part").agg(F.max_by("slot", F.struct("count", "slot")).alias("peak"))
    return counts.join(peak, [KEY, "part"]).withColumn("is_peak", F.col("slot") == F.col("peak")).drop("peak")


def temporal_clusters(found: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Runs of at least two anomalies, each within ``gap`` of the one before."""
    w = Window.partitionBy(KEY).orderBy("ts", "idx")
    new = F.coalesce((F.col("ts") > F.lag("ts").over(w) + F.expr(f"interval {gap}")).cast("int"), F.lit(1))
    runs = found.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy(KEY, "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"), F.avg("score").alias("mean_score")).where("n >= 2").drop("run")


def group_by_window(found: DataFrame, minutes: int) -> DataFrame:
    return found.groupBy(KEY, F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (60 * minutes)).alias("window_id")).agg(F.count("*").alias("n"), F.max("score").alias("max_score"))


def merge_nearby(found: DataFrame, max_gap: int) -> DataFrame:
    """In index order, an anomaly within ``max_gap`` of the one held is merged with it, and that with the larger score (the first of equals) is held on."""
    rows = found.select(*COLUMNS)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept = pdf.sort_values("idx"), []
        for k, (idx, score) in enumerate(zip(pdf["idx"].tolist(), pdf["score"].tolist(), strict=True)):
            if kept and idx <= kept[-1][1] + max_gap:
                if score > kept[-1][2]:
                    kept[-1] = k, idx, score
            else:
                kept.append((k, idx, score))
        return pdf.iloc[[k for k, _, _ in kept]]

    return rows.groupBy(KEY).applyInPandas(merged, rows.schema)


def density(found: DataFrame, series: DataFrame) -> DataFrame:
    """Anomalies per hour of a series' span."""
    span = series.groupBy(KEY).agg(((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 3.6e9).alias("hours"))
    return span.join(found.groupBy(KEY).count(), KEY, "left").select(KEY, F.coalesce(safe_div(F.coalesce("count", F.lit(0)).cast("double"), F.col("hours")), F.lit(0.0)).alias("per_hour"))


def thresholds(series: DataFrame, k: float = 3.0, percent: float = 0.95) -> DataFrame:
    """Adaptive (mean and deviation), robust (median and MAD) and percentile thresholds."""
    rows = _with(valid(series), F.avg(val()).alias("m"), F.stddev_pop(val()).alias("s"), F.percentile(val(), [0.5, percent]).alias("q"))
    rows = rows.withColumn("dev", F.abs(val() - F.col("q")[0]))
    return rows.groupBy(KEY, "m", "s", "q").agg(F.percentile("dev", 0.5).alias("mad")).select(KEY, (F.col("m") + k * F.col("s")).alias("adaptive"), (F.col("q")[0] + k * 1.4826 * F.col("mad")).alias("robust"), F.col("q")[1].alias("percentile"))


def treat_outliers(series: DataFrame, found: DataFrame, action: str = "remove", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Outliers become missing (``remove``), percentiles (``cap``), the median (``replace``) or the mean of their neighbours (``smooth``)."""
    t = valid(series).groupBy(KEY).agg(F.percentile("value", [low, 0.5, high]).alias("q"))
    w = Window.partitionBy(KEY).orderBy("idx").rowsBetween(-1, 1)
    marked = series.join(found.select(KEY, "idx").distinct().withColumn("hit", F.lit(True)), [KEY, "idx"], "left").join(t, KEY, "left")
    near = F.avg(F.when(F.col("hit").isNull(), val())).over(w)
    new = {"remove": F.lit(None).cast("double"), "cap": F.greatest(F.col("q")[0], F.least(F.col("q")[2], val())), "replace": F.col("q")[1], "smooth": near}[action]
    return marked.withColumn("cleaned", F.when(F.col("hit"), new).otherwise(val())).drop("q", "hit")
