"""Trend lines, trend tests, detrending and decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div, two_sided_p
from .detectors_np import mann_kendall as counted_kendall, median_slope
from .series import by_index, KEY, valid, place, val
from .windows import average_ranks



def linear_trend(series: DataFrame) -> DataFrame:
    """Least squares of the values on the index."""
    return valid(series).groupBy(KEY).agg(F.count("*").alias("n"), F.regr_slope(val(), place()).alias("slope"), F.regr_intercept(val(), place()).alias("intercept"), F.coalesce(F.regr_r2(val(), place()), F.lit(0.0)).alias("r2"), F.avg(val()).alias("mean"), F.stddev_pop(val()).alias("std"))


def direction(slope: Column, r2: Column, alpha: float = 0.05) -> Column:
    strong = (r2 > 1 - alpha) & (F.abs(slope) > 0.5)
    up = F.when(strong, "strongly_increasing").otherwise("increasing")
    down = F.when(strong, "strongly_decreasing").otherwise("decreasing")
    return F.when(r2 < 0.1, "inconclusive").when(slope > 0, up).when(slope < 0, down).otherwise("stable")


def directional_consistency(series: DataFrame) -> DataFrame:
    """Share of the pairs of changes that have the same sign, from the numbers of rises and falls."""
    d = val() - F.lag("value").over(by_index())
    t = valid(series).withColumn("d", d).groupBy(KEY).agg(F.count_if(F.col("d") > 0).alias("p"), F.count_if(F.col("d") < 0).alias("q"))
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    return t.select(KEY, F.when(p + q < 2, 1.0).otherwise(safe_div(p * (p - 1) + q * (q - 1), (p + q) * (p + q - 1))).alias("consistency"))


def trend_summary(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Line, direction, strength, growth per step, errors of the line and Durbin-Watson statistic."""
    line = linear_trend(series)
    ends = valid(series).groupBy(KEY).agg(F.min_by("value", "idx").alias("first"), F.max_by("value", "idx").alias("last"))
    rows = valid(series).join(line, KEY).withColumn("r", val() - F.col("intercept") - F.col("slope") * place())
    rows = rows.withColumn("dr", F.col("r") - F.lag("r").over(by_index()))
    errors = rows.groupBy(KEY).agg(F.sqrt(F.avg(F.col("r") ** 2)).alias("rmse"), F.avg(F.abs("r")).alias("mae"), safe_div(F.sum(F.col("dr") ** 2), F.sum(F.col("r") ** 2)).alias("durbin_watson"))
    cv = F.coalesce(safe_div(F.col("std"), F.abs("mean")), F.lit(0.0))
    growth = F.when((F.col("first") > 0) & (F.col("last") > 0) & (F.col("n") > 1), F.pow(F.col("last") / F.col("first"), 1 / (F.col("n") - 1.0)) - 1)
    n = F.col("n")
    return (
        line.join(ends, KEY).join(errors, KEY).join(directional_consistency(series), KEY)
        .select(
            KEY, "n", "slope", "intercept", "r2", direction(F.col("slope"), F.col("r2"), alpha).alias("direction"), (F.col("r2") * F.col("consistency") / (1 + 0.5 * cv)).alias("strength"),
            "consistency", growth.alias("growth_rate"), "rmse", "mae", "durbin_watson", (n * F.log(F.nullif(F.col("rmse") ** 2, F.lit(0.0))) + 4).alias("aic"), (n * F.log(F.nullif(F.col("rmse") ** 2, F.lit(0.0))) + 2 * F.log(n)).alias("bic"),
        )
    )


def longest_runs(series: DataFrame) -> DataFrame:
    """Lengths of the longest rise and fall."""
    rows = valid(series).withColumn("s", F.signum(val() - F.lag("value").over(by_index()))).where("s <> 0")
    same = F.coalesce((F.col("s") != F.lag("s").over(by_index())).cast("int"), F.lit(1))
    runs = rows.withColumn("new", same).withColumn("run", F.sum("new").over(by_index())).groupBy(KEY, "run", "s").count()
    pick = lambda sign: F.coalesce(F.max(F.when(F.col("s") == sign, F.col("count"))), F.lit(0)).cast("long")
    return runs.groupBy(KEY).agg(pick(1).alias("longest_rise"), pick(-1).alias("longest_fall"))


def breakpoints(series: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Points between windows whose means differ: a t-like statistic, divided by 3, above the threshold. ``kind``: variance where it grows by half or more, else level.

    A window is a tenth of the values, within 5 and 20.
    """
    from .windows import around

    rows = around(series)
    t = safe_div(F.abs(F.col("m1") - F.col("m0")), F.sqrt((F.col("v0") + F.col("v1")) / F.col("w")))
    kind = F.when(F.col("v1") > 1.5 * F.col("v0"), "variance").otherwise("level")
    return rows.withColumns({"score": t / 3, "kind": kind}).where(F.col("score") > threshold).select(KEY, "idx", "ts", "value", "score", "kind")


def mann_kendall(series: DataFrame) -> DataFrame:
    """S of all pairs, its z with continuity correction (no correction for ties) and p-value.

    S is the sum over pairs i < j of sign(x_j - x_i). It is counted series by series in
    n log n steps, so no pairs are made. Series of fewer than 3 values give none.
    """
    return _kendall_test(counted_kendall(series).select(KEY, F.col("n").cast("long").alias("n"), "s"))


def _kendall_test(t: DataFrame) -> DataFrame:
    n, s = F.col("n"), F.col("s")
    z = F.when(s > 0, s - 1).when(s < 0, s + 1).otherwise(0.0) / F.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    return t.select(KEY, "n", "s", z.alias("z"), two_sided_p(z).alias("p_value"), (2 * s / (n * (n - 1))).alias("tau"))


def sens_slope(series: DataFrame) -> DataFrame:
    """Median of the slopes of all pairs, and the median line's intercept.

    The median is found series by series from counts, so no pairs are made. Series of a single value give none.
    """
    rows = valid(series)
    middle = rows.groupBy(KEY).agg(F.percentile(val(), 0.5).alias("mv"), F.percentile(place(), 0.5).alias("mi"))
    return median_slope(series).join(middle, KEY).select(KEY, "slope", (F.col("mv") - F.col("slope") * F.col("mi")).alias("intercept"))


def pettitt(series: DataFrame) -> DataFrame:
    """Change point by U_t = t(n + 1) - 2 * (sum of the first t ranks); the first of equal maxima."""
    ranked = average_ranks(valid(series), "value", [KEY], "r").join(valid(series).groupBy(KEY).agg(F.count("*").alias("n")), KEY)
    w = Window.partitionBy(KEY).orderBy("idx")
    t = F.row_number().over(w)
    u = ranked.withColumn("u", t * (F.col("n") + 1) - 2 * F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = u.groupBy(KEY, "n").agg(F.max_by(F.struct("idx", "ts", "u"), F.struct(F.abs("u"), -F.col("idx"))).alias("b"))
    k = F.abs("b.u")
    p = F.least(F.lit(1.0), 2 * F.exp(-6 * k * k / (F.pow("n", F.lit(3)) + F.pow("n", F.lit(2)))))
    return best.select(KEY, F.col("b.idx").alias("idx"), F.col("b.ts").alias("ts"), k.alias("k"), p.alias("p_value"))


def detrend_linear(series: DataFrame) -> DataFrame:
    return series.join(linear_trend(series).select(KEY, "slope", "intercept"), KEY).withColumn("trend", F.col("intercept") + F.col("slope") * place()).withColumn("detrended", val() - F.col("trend")).drop("slope", "intercept")


def difference(series: DataFrame, order: int = 1) -> DataFrame:
    out, name = series, "value"
    for k in range(order):
        out = out.withColumn(f"d{k + 1}", F.col(name) - F.lag(name).over(by_index()))
        name = f"d{k + 1}"
    return out.withColumn("detrended", F.col(name)).drop(*[f"d{k + 1}" for k in range(order)])


def detrend_moving_average(series: DataFrame, size: int) -> DataFrame:
    """Against the centred mean; null where the window isn't whole."""
    w = by_index().rowsBetween(-(size // 2), size // 2)
    return series.withColumn("trend", F.when(F.count(val()).over(w) == 2 * (size // 2) + 1, F.avg(val()).over(w))).withColumn("detrended", val() - F.col("trend"))


def _centred_trend(period: int) -> Column:
    """Moving average over a period; twice over for an even one, whose end weights are half."""
    half = period // 2
    if period % 2:
        w = by_index().rowsBetween(-half, half)
        return F.when(F.count(val()).over(w) == period, F.avg(val()).over(w))
    inner, outer = by_index().rowsBetween(-half + 1, half - 1), by_index().rowsBetween(-half, half)
    ends = (F.lag("value", half).over(by_index()) + F.lead("value", half).over(by_index())) / 2
    return F.when(F.count(val()).over(outer) == period + 1, (F.sum(val()).over(inner) + ends) / period if half > 1 else (val() + ends) / period)


def decompose(series: DataFrame, period: int, multiplicative: bool = False) -> DataFrame:
    """Classical decomposition: trend (its ends on the line through the first and the last two known points), centred seasonal means, residual."""
    rows = valid(series).withColumn("t0", _centred_trend(period))
    known = rows.where("t0 is not null").withColumn("up", F.row_number().over(by_index())).withColumn("down", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("idx"))))
    at = lambda c, k: F.max(F.when(F.col(c) == k, F.struct("idx", "t0")))
    ends = known.where("up <= 2 or down <= 2").groupBy(KEY).agg(at("up", 1).alias("a"), at("up", 2).alias("b"), at("down", 2).alias("c"), at("down", 1).alias("d"))
    line = lambda p, q: F.col(f"{p}.t0") + (F.col("idx") - F.col(f"{p}.idx")) * safe_div(F.col(f"{q}.t0") - F.col(f"{p}.t0"), (F.col(f"{q}.idx") - F.col(f"{p}.idx")).cast("double"))
    rows = rows.join(ends, KEY).withColumn("trend", F.coalesce("t0", F.when(F.col("idx") < F.col("a.idx"), line("a", "b")).otherwise(line("c", "d")))).withColumn("phase", F.col("idx") % period)
    off = safe_div(val(), F.col("trend")) if multiplicative else val() - F.col("trend")
    if multiplicative:
        means = rows.groupBy(KEY, "phase").agg(F.avg(F.log(F.when(off > 0, off))).alias("m"))
        seasonal = F.exp(F.col("m") - F.col("gm"))
    else:
        means = rows.groupBy(KEY, "phase").agg(F.avg(off).alias("m"))
        seasonal = F.col("m") - F.col("gm")
    total = means.groupBy(KEY).agg(F.avg("m").alias("gm"))
    out = rows.join(means, [KEY, "phase"]).join(total, KEY).withColumn("seasonal", seasonal)
    rest = safe_div(val(), F.col("trend") * F.col("seasonal")) if multiplicative else val() - F.col("trend") - F.col("seasonal")
    return out.select(KEY, "idx", "ts", "value", "trend", "seasonal", rest.alias("residual"))


def stl(series: DataFrame, period: int, rounds: int = 2) -> DataFrame:
    """Two rounds of smoothing each cycle's places over three cycles, and the rest over a period."""
    span = period | 1
    out = valid(series).withColumns({"trend": F.lit(0.0), "seasonal": F.lit(0.0), "phase": F.col("idx") % period})
    cycle = Window.partitionBy(KEY, "phase").orderBy("idx").rowsBetween(-1, 1)
    wide = by_index().rowsBetween(-(span // 2), span // 2)
    for _ in range(rounds):
        out = out.withColumn("raw", F.avg(val() - F.col("trend")).over(cycle))
        low = F.avg("raw").over(wide)
        out = out.withColumn("seasonal", F.col("raw") - low)
        out = out.withColumn("trend", F.avg(val() - F.col("seasonal")).over(wide))
    return out.select(KEY, "idx", "ts", "value", "trend", "seasonal", (val() - F.col("trend") - F.col("seasonal")).alias("residual"))


def seasonal_strength(parts: DataFrame) -> DataFrame:
    """Share of the detrended variance that is seasonal, and of the deseasonalised that is trend."""
    share = lambda c: F.greatest(F.lit(0.0), 1 - safe_div(F.var_pop("residual"), F.var_pop(F.col(c) + F.col("residual"))))
    return parts.groupBy(KEY).agg(share("seasonal").alias("seasonal_strength"), share("trend").alias("trend_strength"), F.stddev_samp("residual").alias("residual_std"))
