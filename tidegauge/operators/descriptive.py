"""Descriptive statistics and distributions of series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import normal_cdf, normal_quantile, safe_div
from .series import KEY, valid

PERCENTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def describe(series: DataFrame) -> DataFrame:
    """Moments, quantiles (linear interpolation), mode of the whole parts, skewness and kurtosis of the finite values.

    Variance is that of the population, skewness is bias-corrected. ``mode`` is null
    where no whole part repeats; of equally frequent ones it is the smallest.
    """
    v, n = F.col("value"), F.col("n")
    rows = valid(series)
    stats = rows.groupBy(KEY).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.var_pop(v).alias("variance"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile(v, [p / 100 for p in PERCENTS]).alias("q"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"),
    )
    counts = rows.groupBy(KEY, v.cast("long").alias("whole")).count()
    mode = counts.groupBy(KEY).agg(F.max_by("whole", F.struct("count", -F.col("whole"))).alias("mode"), F.max("count").alias("times"))
    q = {f"p{p:02d}": F.col("q")[i] for i, p in enumerate(PERCENTS)}
    return (
        stats.join(mode, KEY)
        .select(
            KEY, "n", "mean", "std", "variance", "min", "max", (F.col("max") - F.col("min")).alias("range"), *[c.alias(k) for k, c in q.items()], (q["p75"] - q["p25"]).alias("iqr"),
            F.when(F.col("times") > 1, F.col("mode")).alias("mode"), F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
            F.when(n > 3, ((n + 1) * F.col("g2") - 3 * (n - 1)) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"),
            F.when(F.col("mean") == 0, F.lit(math.inf)).otherwise(F.col("std") / F.nullif(F.abs("mean"), F.lit(0.0))).alias("cv"),
        )
    )


def standardized_moments(series: DataFrame) -> DataFrame:
    """Skewness and excess kurtosis by the formulas for samples, but of values standardised by the population's deviation.

    0 for constant series, and for fewer than three (skewness) or four (kurtosis) values.
    """
    n = F.col("n")
    t = valid(series).groupBy(KEY).agg(F.count("*").cast("double").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"))
    varied = F.col("g1").isNotNull() & ~F.isnan("g1")
    skew = n * n * F.col("g1") / ((n - 1) * (n - 2))
    kurt = n * n * (n + 1) * (F.col("g2") + 3) / ((n - 1) * (n - 2) * (n - 3)) - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))
    return t.select(KEY, F.when(varied & (n > 2), skew).otherwise(0.0).alias("skewness"), F.when(varied & (n > 3), kurt).otherwise(0.0).alias("kurtosis"))


def mad(series: DataFrame) -> DataFrame:
    """Median, and median absolute deviation from it."""
    med = valid(series).groupBy(KEY).agg(F.percentile("value", 0.5).alias("median"))
    return valid(series).join(med, KEY).groupBy(KEY, "median").agg(F.percentile(F.abs(F.col("value") - F.col("median")), 0.5).alias("mad"))


def histogram(series: DataFrame, bins: int | None = None) -> DataFrame:
    """Equal bins, the last one closed: by default the lesser of Sturges' and Scott's numbers, between 5 and 50; a constant series has one."""
    rows, v, n = valid(series), F.col("value"), F.col("n")
    t = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_pop(v).alias("s"))
    spread = F.col("hi") - F.col("lo")
    sturges, scott = F.ceil(F.log2(n) + 1), F.ceil(safe_div(spread, 3.5 * F.col("s") / F.pow(n, F.lit(1 / 3))))
    k = F.lit(bins) if bins else F.greatest(F.lit(5), F.least(sturges, scott, F.lit(50)))
    t = t.withColumn("k", F.when(spread == 0, 1).otherwise(k).cast("long")).withColumn("width", F.when(spread == 0, 1.0).otherwise(spread / F.col("k")))
    at = F.least(F.floor((v - F.col("lo")) / F.col("width")), F.col("k") - 1)
    filled = rows.join(t, KEY).groupBy(KEY, at.alias("bin")).count()
    every = t.select(KEY, "n", "lo", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("bin"))
    c = F.coalesce("count", F.lit(0)).cast("long")
    return every.join(filled, [KEY, "bin"], "left").select(KEY, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"), c.alias("count"), (c / (n * F.col("width"))).alias("density"))


def ordered(series: DataFrame) -> DataFrame:
    """Finite values with their place ``i`` from 1 in size order, and n."""
    rows = valid(series)
    w = Window.partitionBy(KEY).orderBy("value", "idx")
    return rows.withColumn("i", F.row_number().over(w)).join(rows.groupBy(KEY).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("s")), KEY)


def qq_points(series: DataFrame) -> DataFrame:
    """Standard normal quantiles at (i - .5) / n, and those of the fitted normal."""
    z = normal_quantile((F.col("i") - 0.5) / F.col("n"))
    return ordered(series).select(KEY, "i", z.alias("theoretical"), F.col("value").alias("sample"), (F.col("mean") + F.col("s") * z).alias("line"))


def shapiro_wilk(series: DataFrame) -> DataFrame:
    """W of the approximate normal scores, normalised, and its tabulated p-value; 8 values at least."""
    m = normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25))
    t = ordered(series).where(F.col("n") >= 8).withColumn("m", m)
    out = t.groupBy(KEY).agg(F.sum(F.col("m") * F.col("value")).alias("b"), F.sum(F.col("m") * F.col("m")).alias("mm"), (F.var_pop("value") * F.count("*")).alias("ss"))
    raw = safe_div(F.col("b") ** 2, F.col("ss"))
    w = safe_div(raw, F.col("mm"))
    table = lambda c: F.when(c > 0.95, 0.5 + 2 * (c - 0.95)).when(c > 0.9, 0.1 + 8 * (c - 0.9)).otherwise(0.01 + 0.09 * c)
    return out.select(KEY, w.alias("w"), table(w).alias("p_value"), raw.alias("w_ref"), table(raw).alias("p_value_ref"))


def kolmogorov_smirnov(series: DataFrame) -> DataFrame:
    """Largest distance between the empirical and the fitted normal distribution, its critical value at 5 % and p-value."""
    n, i = F.col("n"), F.col("i")
    cdf = normal_cdf(safe_div(F.col("value") - F.col("mean"), F.col("s")))
    d = ordered(series).withColumn("d", F.greatest(F.abs(i / n - cdf), F.abs((i - 1) / n - cdf))).groupBy(KEY, "n").agg(F.max("d").alias("d"))
    lam = F.sqrt(n) * F.col("d")
    p = F.lit(0.0)
    for k in range(1, 11):
        p = p + (1 if k % 2 else -1) * F.exp(-2 * lam * lam * k * k)
    return d.select(KEY, F.col("d").alias("statistic"), (1.36 / F.sqrt(n)).alias("critical"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * p)).alias("p_value"))


def normality(series: DataFrame, alpha: float = 0.05, most: int = 5000) -> DataFrame:
    """The test that suits a series' length: Shapiro-Wilk for 8 to ``most`` values, Kolmogorov-Smirnov beyond; named in ``test``."""
    n = valid(series).groupBy(KEY).agg(F.count("*").alias("n")).where("n >= 8")
    a = shapiro_wilk(series).select(KEY, F.lit("shapiro_wilk").alias("test"), F.col("w").alias("statistic"), "p_value").join(n, KEY).where(F.col("n") <= most)
    b = kolmogorov_smirnov(series).select(KEY, F.lit("kolmogorov_smirnov").alias("test"), "statistic", "p_value").join(n, KEY).where(F.col("n") > most)
    return a.unionByName(b).withColumn("is_normal", F.col("p_value") > alpha)


def normal_fit(series: DataFrame) -> DataFrame:
    """Mean, deviation, log-likelihood and AIC of a normal distribution."""
    t = valid(series).groupBy(KEY).agg(F.count("*").alias("n"), F.avg("value").alias("mu"), F.stddev_samp("value").alias("sigma"), F.var_pop("value").alias("v"))
    ll = -F.col("n") / 2 * F.log(2 * math.pi * F.col("sigma") ** 2) - F.col("n") * F.col("v") / (2 * F.col("sigma") ** 2)
    return t.select(KEY, "mu", "sigma", ll.alias("log_likelihood"), (4 - 2 * ll).alias("aic"))


def entropy(series: DataFrame, bins: int = 10) -> DataFrame:
    """Shannon entropy in bits over equal bins."""
    p = F.col("count") / F.col("n")
    h = histogram(series, bins)
    return h.join(h.groupBy(KEY).agg(F.sum("count").alias("n")), KEY).where("count > 0").groupBy(KEY).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def kernel_density(series: DataFrame, points: int = 100) -> DataFrame:
    """Gaussian density on a grid over the range and a tenth beyond; bandwidth s n^(-1/5); constant series give none."""
    rows = valid(series)
    t = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.stddev_samp("value").alias("s")).where("s > 0")
    r = F.col("hi") - F.col("lo")
    grid = t.select(KEY, "n", (F.col("s") * F.pow("n", F.lit(-0.2))).alias("h"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(i.alias("i"), (F.col("lo") - 0.1 * r + 1.2 * r * i / (points - 1)).alias("x")))).alias("g"))
    u = (F.col("g.x") - F.col("value")) / F.col("h")
    return rows.select(KEY, "value").join(grid, KEY).groupBy(KEY, "g", "h").agg(F.avg(F.exp(-u * u / 2)).alias("k")).select(KEY, F.col("g.i").alias("i"), F.col("g.x").alias("x"), (F.col("k") / (F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def data_quality_report(series: DataFrame) -> DataFrame:
    """Missing, infinite and outlying values (quartiles at places n/4 and 3n/4) and the share of clean ones."""
    v = F.col("value")
    w = Window.partitionBy(KEY).orderBy("value")
    ranked = valid(series).withColumn("i", F.row_number().over(w) - 1).join(valid(series).groupBy(KEY).agg(F.count("*").alias("n")), KEY)
    q = ranked.groupBy(KEY).agg(F.max(F.when(F.col("i") == F.floor(F.col("n") / 4), v)).alias("q1"), F.max(F.when(F.col("i") == F.floor(3 * F.col("n") / 4), v)).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    out = F.count_if((v < F.col("q1") - 1.5 * iqr) | (v > F.col("q3") + 1.5 * iqr))
    t = series.join(q, KEY, "left").groupBy(KEY).agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("n_missing"), F.count_if(F.abs(v) == F.lit(math.inf)).alias("n_infinite"), out.alias("n_outliers"))
    return t.withColumn("score", 1 - (F.col("n_missing") + F.col("n_infinite") + F.col("n_outliers")) / F.col("n"))
