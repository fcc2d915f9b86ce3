"""How a seasonal pattern changes: breaks, stability, evolution, outliers and its bond with the trend.

Windows of whole cycles make a wave's sines and cosines orthogonal, so harmonic regression
is a set of grouped sums, and the sums of two windows are those of both together: the F test of a break between
neighbours needs no second pass. Moving windows whose width depends on a series' length
are differences of prefix sums, looked up by position. The resetting CUSUM folds the cycles of each (series,
phase) with an aggregate over an array.

Defined results: missing and infinite values are left out, the rest follow one another. Series too short for a
result (stated with each function) have none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from .multivariate import f_tail
from .series import KEY, by_index, valid, val


def _placed(series: DataFrame) -> DataFrame:
    """Adds ``i`` (place among the values) and ``n`` (their number)."""
    rows = valid(series).withColumn("i", F.row_number().over(by_index()) - 1)
    return rows.join(rows.groupBy(KEY).agg(F.count("*").alias("n")), KEY)


def harmonics(period: int, most: int) -> list[int]:
    return list(range(1, min(most, period // 2) + 1))


def window_sums(series: DataFrame, period: int, cycles: int = 4, most: int = 2) -> DataFrame:
    """The sums of harmonic regression in each window ``w`` of ``cycles`` whole cycles: ``points``, ``s``, ``q`` (squares), and ``c1``, ``s1``, ... with cosines and sines. What is left at the end is in no window."""
    width = period * cycles
    rows = _placed(series).withColumn("w", F.floor(F.col("i") / width)).where((F.col("w") + 1) * width <= F.col("n"))
    sums = [F.count("*").alias("points"), F.sum(val()).alias("s"), F.sum(val() ** 2).alias("q")]
    for h in harmonics(period, most):
        angle = 2 * math.pi * h * F.pmod("i", F.lit(period)) / period
        sums += [F.sum(val() * F.cos(angle)).alias(f"c{h}"), F.sum(val() * F.sin(angle)).alias(f"s{h}")]
    return rows.groupBy(KEY, "w").agg(*sums)


def _rest(prefix: str, period: int, waves: list[int]) -> Column:
    """Squares that a mean and the waves leave over."""
    col = lambda name: F.col(f"{prefix}{name}")
    out = col("q") - col("s") ** 2 / col("points")
    for h in waves:
        # at half the period the wave's square averages one instead of a half, and it has no sine
        out = out - (col(f"c{h}") ** 2 / col("points") if 2 * h == period else 2 * (col(f"c{h}") ** 2 + col(f"s{h}") ** 2) / col("points"))
    return F.greatest(out, F.lit(0.0))


BREAKS = "series_id string, w long, at long, f double, p_value double, amplitude_before double, amplitude_after double, phase_shift double, level_shift double, kind string, is_break boolean"


def seasonal_breaks(series: DataFrame, period: int, cycles: int = 4, most: int = 2, alpha: float = 0.01) -> DataFrame:
    """The F test of one pattern against two at each border between windows of ``cycles`` cycles; each window has its own mean.

    ``at``: place of the border. ``kind`` of a break: amplitude (changed by a quarter or more), phase (by an eighth of the wave's turn or more), both, or shape.
    The amplitudes and the phase (in radians, -pi to pi) are those of the first wave. Two windows at least.
    """
    waves, width = harmonics(period, most), period * cycles
    terms = sum(1 if 2 * h == period else 2 for h in waves)
    sums = [c for c in ("points", "s", "q", *(f"{x}{h}" for h in waves for x in "cs"))]
    order = Window.partitionBy(KEY).orderBy("w")
    t = window_sums(series, period, cycles, most).select(KEY, "w", *[F.col(c).alias(f"b_{c}") for c in sums], *[F.lag(c).over(order).alias(f"a_{c}") for c in sums]).where("a_points is not null")
    apart = _rest("a_", period, waves) + _rest("b_", period, waves)
    # together: own means, common waves
    t = t.withColumns({f"t_{c}": F.col(f"a_{c}") + F.col(f"b_{c}") for c in sums})
    between = (F.col("a_s") / F.col("a_points") - F.col("b_s") / F.col("b_points")) ** 2 * F.col("a_points") * F.col("b_points") / F.col("t_points")
    together = F.greatest(_rest("t_", period, waves) - between, F.lit(0.0))
    df = F.col("t_points") - 2 * (terms + 1)
    f = safe_div((together - apart) / terms, apart / df)
    size = lambda p: 2 * F.sqrt(F.col(f"{p}c1") ** 2 + F.col(f"{p}s1") ** 2) / F.col(f"{p}points")
    turn = F.atan2("b_s1", "b_c1") - F.atan2("a_s1", "a_c1")
    turn = turn - 2 * math.pi * F.floor((turn + math.pi) / (2 * math.pi))
    found = t.select(
        KEY, "w", (F.col("w") * width).alias("at"), f.alias("f"), df.alias("df"), size("a_").alias("amplitude_before"), size("b_").alias("amplitude_after"), turn.alias("phase_shift"),
        (F.col("b_s") / F.col("b_points") - F.col("a_s") / F.col("a_points")).alias("level_shift"),
    )

    def tail(batches):
        for b in batches:
            b["p_value"] = [f_tail(x, terms, d) if x == x and d > 0 else None for x, d in zip(b["f"].astype(float), b["df"], strict=True)]
            yield b.drop(columns="df")

    p = found.mapInPandas(tail, "series_id string, w long, at long, f double, amplitude_before double, amplitude_after double, phase_shift double, level_shift double, p_value double")
    grown = F.greatest("amplitude_before", "amplitude_after") >= 1.25 * F.least("amplitude_before", "amplitude_after")
    turned = F.abs("phase_shift") >= math.pi / 4
    kind = F.when(grown & turned, "both").when(grown, "amplitude").when(turned, "phase").otherwise("shape")
    is_break = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    return p.withColumn("is_break", is_break).withColumn("kind", F.when(F.col("is_break"), kind)).select(*[c.split()[0] for c in BREAKS.split(", ")])


def phase_cusum(series: DataFrame, period: int, first: int = 8, slack: float = 0.5, limit: float = 5.0) -> DataFrame:
    """Alarms of a two-sided CUSUM along the cycles of each phase, which begins anew after an alarm.

    Values are standardised by the mean and deviation (n - 1) of the phase's ``first`` cycles. ``cycle`` of the alarm, its ``idx``, the ``sum`` that passed
    ``limit``, with its sign. Series with fewer cycles have none, and phases that don't vary at first neither.
    """
    rows = _placed(series).withColumns({"phase": F.pmod("i", F.lit(period)), "cycle": F.floor(F.col("i") / period)})
    base = rows.where(F.col("cycle") < first).groupBy(KEY, "phase").agg(F.avg(val()).alias("m"), F.stddev_samp(val()).alias("sd"), F.count("*").alias("k")).where((F.col("k") == first) & (F.col("sd") > 0))
    z = rows.join(base, [KEY, "phase"]).select(KEY, "phase", F.struct("cycle", "idx", ((val() - F.col("m")) / F.col("sd")).alias("z")).alias("p"))
    lines = z.groupBy(KEY, "phase").agg(F.array_sort(F.collect_list("p")).alias("points"))
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array().cast("array<struct<cycle:bigint,idx:bigint,sum:double>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        up, down = F.greatest(F.lit(0.0), acc["up"] + x["z"] - slack), F.greatest(F.lit(0.0), acc["down"] - x["z"] - slack)
        hit = (up > limit) | (down > limit)
        one = F.array(F.struct(x["cycle"].cast("long").alias("cycle"), x["idx"].cast("long").alias("idx"), F.when(up >= down, up).otherwise(-down).alias("sum")))
        return F.struct(F.when(hit, 0.0).otherwise(up).alias("up"), F.when(hit, 0.0).otherwise(down).alias("down"), F.when(hit, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return lines.select(KEY, "phase", F.explode(F.aggregate("points", start, step)["found"]).alias("a")).select(KEY, "phase", "a.*")


def outlier_points(series: DataFrame, period: int, factor: float = 2.0) -> DataFrame:
    """Points farther from their phase's mean than ``factor`` deviations of the whole series; ``innovation`` beyond three times that. Periods below half of the values."""
    rows = _placed(series).where(F.col("n") > 2 * period).withColumn("phase", F.pmod("i", F.lit(period)))
    means = rows.groupBy(KEY, "phase").agg(F.avg(val()).alias("expected"))
    spread = rows.groupBy(KEY).agg((factor * F.stddev_pop(val())).alias("limit"))
    far = F.abs(val() - F.col("expected"))
    t = rows.join(means, [KEY, "phase"]).join(spread, KEY).withColumn("deviation", far).where(F.col("deviation") > F.col("limit"))
    return t.select(KEY, "idx", "value", "expected", "deviation", F.when(F.col("deviation") > 3 * F.col("limit"), "innovation").otherwise("additive").alias("kind"))


def _prefixed(series: DataFrame, least: int) -> DataFrame:
    """``i``, ``n``, and sums of all values before i (``p1``, centred) and of their squares (``p2``), for i = 0 to n."""
    rows = _placed(series).where(F.col("n") >= least)
    t = rows.groupBy(KEY).agg(F.avg(val()).alias("m"), F.avg(F.abs(val())).alias("size"))
    x = rows.join(t, KEY).withColumn("x", val() - F.col("m"))
    upto = Window.partitionBy(KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = x.select(KEY, "n", "m", "size", (F.col("i") + 1).alias("i"), F.sum("x").over(upto).alias("p1"), F.sum(F.col("x") ** 2).over(upto).alias("p2"))
    zero = x.where("i = 0").select(KEY, "n", "m", "size", F.lit(0).alias("i"), F.lit(0.0).alias("p1"), F.lit(0.0).alias("p2"))
    return zero.unionByName(sums)


def _over(sums: DataFrame, width: Column) -> DataFrame:
    """Sums over the ``width`` places from i on: ``x1``, ``x2``."""
    a = sums.withColumn("j", (F.col("i") + width).cast("long"))
    b = sums.select(KEY, F.col("i").cast("long").alias("j"), F.col("p1").alias("e1"), F.col("p2").alias("e2"))
    return a.join(b, [KEY, "j"]).select(KEY, "i", "n", "m", "size", width.alias("width"), (F.col("e1") - F.col("p1")).alias("x1"), (F.col("e2") - F.col("p2")).alias("x2"))


def pattern_stability(series: DataFrame) -> DataFrame:
    """1 / (1 + variance of the variances / their mean) over all windows of a fifth of the values but the last; 20 values at least. The mean counts as 0.001 at least."""
    w = F.floor(F.col("n") / 5)
    t = _over(_prefixed(series, 20), w).where(F.col("i") < F.col("n") - F.col("width"))
    v = F.greatest(F.col("x2") / F.col("width") - (F.col("x1") / F.col("width")) ** 2, F.lit(0.0))
    s = t.withColumn("v", v).groupBy(KEY).agg(F.avg("v").alias("mean_variance"), F.var_pop("v").alias("spread"), F.count("*").alias("windows"))
    return s.select(KEY, "windows", "mean_variance", (1 / (1 + F.col("spread") / F.greatest("mean_variance", F.lit(0.001)))).alias("stability"))


def pattern_evolution(series: DataFrame) -> DataFrame:
    """Places where the centred mean of a tenth of the values moves by more than a tenth of the mean absolute value from one place to the next.

    ``changes``, ``change_rate`` (of all values) and ``trend``: stable below 0.01, irregular above 0.05, else shifting. Fifty values at least.
    """
    # a window of n // 10 values: half of it, rounded down, on either side; the sum is over the window's full width
    w = F.floor(F.col("n") / 10)
    half = F.floor(w / 2)
    sums = _prefixed(series, 50)
    t = _over(sums, (2 * half)).withColumn("w", w).withColumn("at", F.col("i") + half)
    t = t.where((F.col("at") >= F.col("w")) & (F.col("at") < F.col("n") - F.col("w"))).withColumn("mean", (F.col("x1") + F.col("width") * F.col("m")) / F.col("w"))
    first = _over(sums, w).where("i = 0").select(KEY, (F.col("x1") / F.col("width") + F.col("m")).alias("head"))
    before = F.coalesce(F.lag("mean").over(Window.partitionBy(KEY).orderBy("at")), F.col("head"))
    c = t.join(first, KEY).withColumn("change", F.abs(F.col("mean") - before))
    s = c.groupBy(KEY, "n").agg(F.count_if(F.col("change") > 0.1 * F.col("size")).alias("changes"), F.max("change").alias("largest"))
    rate = F.col("changes") / F.col("n")
    return s.select(KEY, "changes", rate.alias("change_rate"), "largest", F.when(rate < 0.01, "stable").when(rate > 0.05, "irregular").otherwise("shifting").alias("trend"))


def trend_interaction(series: DataFrame, periods: list[int]) -> DataFrame:
    """Correlation of the moving average (a tenth of the values, shorter at the ends) with each period's wave sin + sin of twice the angle / 2, and with the cycles' amplitudes.

    ``kind``: independent below 0.1 in size, else amplifying or dampening by the sign of ``amplitude_r``. Twenty values, two cycles at least.
    """
    half = F.floor(F.floor(F.col("n") / 10) / 2)
    sums = _prefixed(series, 20)
    low, high = F.greatest(F.lit(0), F.col("i") - half), F.least(F.col("n"), F.col("i") + half + 1)
    at = sums.where("i < n").select(KEY, "i", "n", "m", low.cast("long").alias("low"), high.cast("long").alias("high"))
    end = lambda name, p: sums.select(KEY, F.col("i").cast("long").alias(name), F.col("p1").alias(p))
    t = at.join(end("low", "pl"), [KEY, "low"]).join(end("high", "ph"), [KEY, "high"]).select(KEY, "i", "n", (F.col("m") + (F.col("ph") - F.col("pl")) / (F.col("high") - F.col("low"))).alias("trend"))
    rows = _placed(series).select(KEY, F.col("i").cast("long").alias("i"), "value")
    t = t.withColumn("i", F.col("i").cast("long")).join(rows, [KEY, "i"]).withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods]))).where(F.col("period") * 2 < F.col("n"))
    angle = 2 * math.pi * F.pmod("i", F.col("period")) / F.col("period")
    wave = F.sin(angle) + 0.5 * F.sin(2 * angle)
    r = lambda x, y: safe_div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    waves = t.withColumn("wave", wave).groupBy(KEY, "period").agg(r("trend", "wave").alias("wave_r"))
    cycles = t.withColumn("c", F.floor(F.col("i") / F.col("period"))).where((F.col("c") + 1) * F.col("period") <= F.col("n"))
    sizes = cycles.groupBy(KEY, "period", "c").agg(F.avg("trend").alias("level"), F.stddev_pop(val() - F.col("trend")).alias("amplitude"))
    bond = sizes.groupBy(KEY, "period").agg(r("level", "amplitude").alias("amplitude_r"), F.count("*").alias("cycles")).where("cycles > 1")
    kind = F.when(F.coalesce(F.abs("amplitude_r"), F.lit(0.0)) < 0.1, "independent").when(F.col("amplitude_r") > 0, "amplifying").otherwise("dampening")
    return waves.join(bond, [KEY, "period"]).select(KEY, "period", "wave_r", "amplitude_r", "cycles", kind.alias("kind"))
