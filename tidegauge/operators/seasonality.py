"""Detection, patterns and adjustment of seasonality."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from .correlation import autocorrelation
from .grouped import per_series
from .series import by_index, KEY, valid, val



def _centred(series: DataFrame) -> DataFrame:
    rows = valid(series).withColumn("i", F.row_number().over(by_index()) - 1)
    return rows.join(rows.groupBy(KEY).agg(F.count("*").alias("n"), F.avg(val()).alias("m"), F.var_pop(val()).alias("v")), KEY).withColumn("x", val() - F.col("m"))


def spectrum(x: np.ndarray) -> np.ndarray:
    """|sum x exp(-2 pi i k t / n)|^2 / n for k = 1 to n / 2, of values less their mean."""
    return np.abs(np.fft.rfft(x - x.mean())[1:]) ** 2 / len(x)


def fourier(series: DataFrame) -> DataFrame:
    """Power at every frequency of a series, k = 1 to n / 2 cycles, by the fast transform; its ``share`` of the sum of squares; dominant above twice the mean power. Two values at least."""

    def run(x: np.ndarray, _: np.ndarray) -> dict:
        power, n = spectrum(x), len(x)
        k, total = np.arange(1, n // 2 + 1), float(((x - x.mean()) ** 2).sum())
        return {"k": k, "period": n / k, "power": power, "share": 2 * power / total if total else np.full(len(k), np.nan), "mean_power": power.mean(), "is_dominant": power > 2 * power.mean()}

    out = per_series(series, run, "k long, period double, power double, share double, mean_power double, is_dominant boolean", 2)
    return out.withColumn("share", F.nanvl("share", F.lit(None)))


def periodogram(series: DataFrame, low: int, high: int) -> DataFrame:
    """Power at whole periods of at most half the series; peaks are local maxima above the mean by two deviations."""

    def run(x: np.ndarray, _: np.ndarray) -> dict:
        n, d = len(x), x - x.mean()
        periods = np.arange(low, min(high, n // 2) + 1)
        power = np.zeros(len(periods))
        for i, p in enumerate(periods.tolist()):  # the sums of each place of a period, then one wave over the places
            wave = np.exp(-2j * np.pi * np.arange(p) / p)
            power[i] = abs(wave @ np.bincount(np.arange(n) % p, d, p)) ** 2 / n
        before, after = np.append(-1.0, power[:-1]), np.append(power[1:], -1.0)
        level = power.mean() + 2 * power.std() if len(power) else 0.0
        return {"period": periods, "power": power, "is_peak": (power > level) & (power > before) & (power > after)}

    return per_series(series, run, "period int, power double, is_peak boolean", 2 * low)


def acf_periods(series: DataFrame, low: int = 2, high: int = 365) -> DataFrame:
    """Lags at local maxima of the autocorrelation beyond 1.96 / sqrt(n), up to a third of the series."""
    r = autocorrelation(series, high)
    w = Window.partitionBy(KEY).orderBy("lag")
    r = r.withColumns({"before": F.lag("acf").over(w), "after": F.lead("acf").over(w)})
    return r.where((F.col("lag") >= low) & (F.col("lag") <= F.floor(F.col("n") / 3)) & (F.col("acf") > 1.96 / F.sqrt("n")) & (F.col("acf") > F.col("before")) & (F.col("acf") > F.col("after"))).select(KEY, F.col("lag").alias("period"), F.col("acf").alias("strength"))


def auto_period(series: DataFrame, default: int = 12) -> DataFrame:
    """The lag of the largest autocorrelation between 2 and min(n / 3, 52)."""
    r = autocorrelation(series, 52).where((F.col("lag") >= 2) & (F.col("lag") <= F.least(F.floor(F.col("n") / 3), F.lit(52))))
    best = r.groupBy(KEY).agg(F.max_by("lag", F.struct("acf", -F.col("lag"))).alias("p"))
    return series.select(KEY).distinct().join(best, KEY, "left").select(KEY, F.coalesce("p", F.lit(default)).alias("period"))


def seasonal_profile(series: DataFrame, period: int) -> DataFrame:
    """Mean, deviation and count at each place of the period, and the mean's distance from the series' mean."""
    rows = _centred(series)
    return rows.groupBy(KEY, (F.col("i") % period).alias("phase")).agg(F.avg(val()).alias("mean"), F.stddev_pop(val()).alias("std"), F.count("*").alias("n"), F.avg("x").alias("effect"))


def seasonal_strength(series: DataFrame, period: int) -> DataFrame:
    """Share of the variance that the places of the period explain."""
    rows = _centred(series)
    p = rows.groupBy(KEY, (F.col("i") % period).alias("phase")).agg(F.avg("x").alias("e"), F.count("*").alias("k"))
    t = rows.groupBy(KEY).agg(F.sum(F.col("x") ** 2).alias("total"))
    return p.groupBy(KEY).agg(F.sum(F.col("k") * F.col("e") ** 2).alias("between")).join(t, KEY).select(KEY, safe_div(F.col("between"), F.col("total")).alias("strength"))


def pattern_consistency(series: DataFrame, period: int) -> DataFrame:
    """Mean correlation of all pairs of whole cycles: with each of the k cycles scaled to unit norm it is (|sum z|^2 - k) / (k (k - 1)). Constant cycles have none."""
    rows = _centred(series).select(KEY, F.floor(F.col("i") / period).alias("c"), (F.col("i") % period).alias("phase"), "value", "n").where(F.col("c") < F.floor(F.col("n") / period))
    cycles = rows.groupBy(KEY, "c").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    z = rows.join(cycles, [KEY, "c"]).where("sd > 0").groupBy(KEY, "phase").agg(F.sum((F.col("value") - F.col("mu")) / (F.col("sd") * math.sqrt(period))).alias("z"))
    k = cycles.groupBy(KEY).agg(F.count("*").alias("cycles"), F.count_if(F.col("sd") > 0).alias("k")).where("cycles > 1")
    pairs = F.col("k") * (F.col("k") - 1)
    return k.join(z.groupBy(KEY).agg(F.sum(F.col("z") ** 2).alias("total")), KEY, "left").select(KEY, safe_div(F.col("total") - F.col("k"), pairs).alias("consistency"), (pairs / 2).cast("long").alias("n_pairs"))


def adjust(series: DataFrame, period: int, multiplicative: bool = False) -> DataFrame:
    """Values without their seasonal factors, which average 0 (or have a geometric mean of 1)."""
    from .trend import decompose

    parts = decompose(series, period, multiplicative)
    return parts.withColumn("adjusted", safe_div(F.col("value"), F.col("seasonal")) if multiplicative else F.col("value") - F.col("seasonal"))


#: Henderson's 13-term weights (fixed values).
HENDERSON_13 = (-0.01935, -0.02786, 0.0, 0.06549, 0.14736, 0.21434, 0.24006, 0.21434, 0.14736, 0.06549, 0.0, -0.02786, -0.01935)


def adjust_x13(series: DataFrame, period: int) -> DataFrame:
    """Multiplicative: Henderson trend, then the mean ratio at each place, scaled to average 1; ``factor_ref`` averages 0 instead."""
    from .windows import weighted_average

    rows = weighted_average(valid(series), list(HENDERSON_13)).withColumnRenamed("smooth", "trend").withColumn("phase", F.col("idx") % period)
    f = rows.where("trend is not null").groupBy(KEY, "phase").agg(F.avg(safe_div(val(), F.col("trend"))).alias("f"))
    f = f.join(f.groupBy(KEY).agg(F.avg("f").alias("g")), KEY).select(KEY, "phase", safe_div(F.col("f"), F.col("g")).alias("factor"), (F.col("f") - F.col("g")).alias("factor_ref"))
    return rows.join(f, [KEY, "phase"]).select(KEY, "idx", "ts", "value", "trend", "factor", "factor_ref", safe_div(val(), F.col("factor")).alias("adjusted"))


def evolving_strength(series: DataFrame, period: int, window: int) -> DataFrame:
    """Seasonal strength in windows that overlap by half, and its slope over the windows."""
    step = window // 2
    rows = valid(series).withColumn("i", F.row_number().over(by_index()) - 1)
    n = rows.groupBy(KEY).agg(F.count("*").alias("n"))
    last = F.floor(F.col("i") / step)
    rows = rows.join(n, KEY).withColumn("w", F.explode(F.array(last, last - 1))).where((F.col("w") >= 0) & (F.col("w") * step + window <= F.col("n")))
    key = F.concat_ws("\x1f", KEY, "w")
    windows = rows.select(key.alias(KEY), "ts", "value", "idx")
    s = seasonal_strength(windows, period)
    parts = F.split(KEY, "\x1f")
    s = s.select(parts[0].alias(KEY), parts[1].cast("long").alias("w"), "strength")
    slope = s.groupBy(KEY).agg(F.regr_slope("strength", F.col("w").cast("double")).alias("slope"))
    return s.join(slope, KEY)


def period_relations(periods: list[float]) -> list[tuple[float, float]]:
    """Pairs of which the longer is near a whole multiple, 2 or more, of the shorter."""
    ordered = sorted(periods)
    return [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if round(b / a) >= 2 and abs(b / a - round(b / a)) < 0.1]


def consolidate(periods: list[tuple[float, float]], tolerance: float = 0.1, least: float = 0.1) -> list[tuple[float, float]]:
    """(period, strength) without those within a tenth of a stronger one and the weak ones, strongest first."""
    out: list[tuple[float, float]] = []
    for p, s in sorted(periods, key=lambda x: (-x[1], x[0])):
        if s > least and all(abs(p - q) / q > tolerance for q, _ in out):
            out.append((p, s))
    return out[:10]
