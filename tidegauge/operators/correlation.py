"""Auto-, cross- and pairwise correlation as joins on shifted indices and conditional sums.

Correlations are ``covar_pop / (stddev_pop * stddev_pop)``, null without variance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div, two_sided_p
from .grouped import per_series
from .series import by_index, KEY, valid, val
from .windows import average_ranks



#: Up to so many lags are columns of one window pass; more come from the power spectrum, a series at a time.
WINDOW_LAGS = 60


def pearson(x: str, y: str) -> Column:
    return safe_div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def autocorrelation(series: DataFrame, max_lag: int) -> DataFrame:
    """r of each lag, its 95 % bound after Bartlett and the cumulative Ljung-Box statistic. Constant series give none."""
    rows = valid(series).withColumn("i", F.row_number().over(by_index()) - 1)
    t = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.avg(val()).alias("m"), F.var_pop(val()).alias("v")).where("v > 0")
    if max_lag <= WINDOW_LAGS:
        c = rows.join(t, KEY).select(KEY, "i", "n", "v", (val() - F.col("m")).alias("x"))
        order = Window.partitionBy(KEY).orderBy("i")
        lagged = c.select(KEY, "n", "v", *[(F.col("x") * F.lag("x", k).over(order)).alias(f"x{k}") for k in range(max_lag + 1)])
        sums = lagged.groupBy(KEY, "n", "v").agg(F.array(*[F.sum(f"x{k}") for k in range(max_lag + 1)]).alias("s"))
        r = sums.select(KEY, "n", "v", F.posexplode("s").alias("lag", "s")).where(F.col("lag") < F.col("n")).withColumn("acf", F.col("s") / F.col("n") / F.col("v"))
    else:
        # the power spectrum of the values, padded so that nothing wraps around, is the transform of their autocovariances
        def run(x, _):  # noqa: ANN001, ANN202
            n, most = len(x), min(max_lag, len(x) - 1)
            d = np.fft.rfft(x - x.mean(), 1 << (2 * n - 1).bit_length())
            s = np.fft.irfft(np.abs(d) ** 2)[: most + 1]
            return {"lag": np.arange(most + 1), "s": s}

        r = per_series(series, run, "lag int, s double").join(t.select(KEY, "n", "v"), KEY).withColumn("acf", F.col("s") / F.col("n") / F.col("v"))
    past = Window.partitionBy(KEY).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(KEY).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    sq = F.when(F.col("lag") > 0, F.col("acf") ** 2).otherwise(0.0)
    bound = 1.96 * F.sqrt((1 + 2 * F.coalesce(F.sum(sq).over(past), F.lit(0.0))) / F.col("n"))
    q = F.col("n") * (F.col("n") + 2) * F.sum(F.when(F.col("lag") > 0, F.col("acf") ** 2 / F.nullif(F.col("n") - F.col("lag"), F.lit(0))).otherwise(0.0)).over(upto)
    return r.select(KEY, "lag", "n", "acf", F.when(F.col("lag") > 0, bound).otherwise(0.0).alias("bound"), q.alias("ljung_box"))


def significant_lags(acf: DataFrame) -> DataFrame:
    return acf.where("lag > 0 and abs(acf) > bound")


def seasonal_patterns(acf: DataFrame, periods: tuple[int, ...] = (7, 12, 24, 48, 52), least: float = 0.1) -> DataFrame:
    """Which of the usual periods have a significant autocorrelation above ``least``; confidence 0.8 above 0.3, else 0.5."""
    strength = F.abs("acf")
    found = significant_lags(acf).where(F.col("lag").isin(*periods) & (strength > least))
    return found.select(KEY, F.col("lag").alias("period"), strength.alias("strength"), F.when(strength > 0.3, 0.8).otherwise(0.5).alias("confidence"))


def cross_correlation(pairs: DataFrame, max_lag: int) -> DataFrame:
    """Of ``idx, x, y``: correlation of x with y ``lag`` steps later, over the overlap; the global means and deviations are used."""
    t = pairs.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    left = pairs.select("idx", "x", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")).withColumn("at", F.col("idx") + F.col("lag"))
    both = left.join(pairs.select(F.col("idx").alias("at"), "y"), "at").groupBy("lag").agg(F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum("x").alias("s1"), F.sum("y").alias("s2"), F.count("*").alias("k"))
    one = both.join(F.broadcast(t))  # one row of totals
    cov = (F.col("sxy") - F.col("mx") * F.col("s2") - F.col("my") * F.col("s1") + F.col("k") * F.col("mx") * F.col("my")) / F.col("k")
    return one.select("lag", "k", safe_div(cov, F.col("sx") * F.col("sy")).alias("ccf"))


def lead_lag(ccf: DataFrame) -> DataFrame:
    """The lag of the strongest correlation (of equals the shortest) and who leads."""
    best = ccf.agg(F.max_by(F.struct("lag", "ccf"), F.struct(F.abs("ccf"), -F.abs("lag"), "lag")).alias("b"))
    return best.select("b.lag", "b.ccf", F.when(F.col("b.lag") > 0, "first_leads").when(F.col("b.lag") < 0, "second_leads").otherwise("simultaneous").alias("relation"))


def pair_up(series: DataFrame) -> DataFrame:
    """``var1 < var2`` with the finite values that two series have at the same index."""
    rows = valid(series).select(KEY, "idx", "value")
    return rows.toDF("var1", "idx", "x").join(rows.toDF("var2", "idx", "y"), "idx").where("var1 < var2")


def correlation_matrix(series: DataFrame, method: str = "pearson") -> DataFrame:
    """r of each pair of series with at least 3 common points, its t statistic, p-value (normal) and Fisher interval."""
    pairs = pair_up(series)
    if method == "spearman":
        pairs = average_ranks(average_ranks(pairs, "x", ["var1", "var2"], "rx"), "y", ["var1", "var2"], "ry").select("var1", "var2", F.col("rx").alias("x"), F.col("ry").alias("y"))
    out = pairs.groupBy("var1", "var2").agg(F.count("*").alias("n"), pearson("x", "y").alias("r")).where("n >= 3")
    r, n = F.col("r"), F.col("n")
    t = safe_div(r * F.sqrt(n - 2.0), F.sqrt(F.greatest(F.lit(0.0), 1 - r * r)))
    z, half = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r))), 1.96 / F.sqrt(F.greatest(n - 3.0, F.lit(1.0)))
    return out.select("var1", "var2", "n", "r", t.alias("t"), two_sided_p(F.coalesce(t, F.lit(0.0))).alias("p_value"), F.tanh(z - half).alias("ci_low"), F.tanh(z + half).alias("ci_high"))


def kendall_tau(series: DataFrame) -> DataFrame:
    """tau-a of each pair of series: rising less falling pairs of points over all, counted in n log^2 n steps. Two common points at least."""
    from .detectors_np import rising_pairs

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, y = np.asarray(table["x"]), np.asarray(table["y"])
        n = len(x)
        # within equal x the order is such that none of their pairs rises
        up, down = (rising_pairs(v[np.lexsort((-v, x))]) for v in (y, -y))
        tau = [(up - down) / (n * (n - 1) / 2)] if n > 1 else []
        return pa.table({"var1": pa.array([key[0].as_py()] * len(tau), pa.string()), "var2": pa.array([key[1].as_py()] * len(tau), pa.string()), "tau": pa.array(tau, pa.float64())})

    return pair_up(series).select("var1", "var2", "x", "y").groupBy("var1", "var2").applyInArrow(run, "var1 string, var2 string, tau double")


def strong_pairs(matrix: DataFrame, least: float = 0.7) -> DataFrame:
    return matrix.where(F.abs("r") >= least).orderBy(F.desc(F.abs("r")), "var1", "var2")


def rolling_correlation(pairs: DataFrame, window: int, method: str = "pearson") -> DataFrame:
    """Of ``key, idx, x, y``: correlation over each full window, at its last point. Spearman ranks by value, ties by place."""
    w = Window.partitionBy("key").orderBy("idx").rowsBetween(-(window - 1), 0)
    full = F.count("*").over(w) == window
    if method == "pearson":
        r = safe_div(F.covar_pop("x", "y").over(w), F.stddev_pop("x").over(w) * F.stddev_pop("y").over(w))
        return pairs.withColumn("r", F.when(full, r)).where("r is not null")
    both = pairs.withColumn("xs", F.when(full, F.collect_list(F.struct("x", "y")).over(w))).where("xs is not null")
    xs = F.col("xs")
    if method == "kendall":
        def score(a: Column) -> Column:
            return F.aggregate(xs, F.lit(0.0), lambda s, b: s + F.signum(a["x"] - b["x"]) * F.signum(a["y"] - b["y"]))

        return both.withColumn("r", F.aggregate(F.transform(xs, score), F.lit(0.0), lambda s, v: s + v) / (window * (window - 1))).drop("xs")
    place = lambda f: F.transform(F.array_sort(F.transform(xs, lambda v, i: F.struct(v[f].alias("v"), i.alias("i")))), lambda e, k: F.struct(e["i"].alias("i"), k.alias("k")))
    d = F.zip_with(F.array_sort(place("x")), F.array_sort(place("y")), lambda a, b: F.pow((a["k"] - b["k"]).cast("double"), F.lit(2)))
    return both.withColumn("r", 1 - 6 * F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / (window * (window * window - 1))).drop("xs")


def rolling_summary(rolled: DataFrame) -> DataFrame:
    """Moments and stability of rolling correlations."""
    t = rolled.groupBy("key").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.min("r").alias("min"), F.max("r").alias("max"), F.percentile("r", 0.5).alias("median"))
    return t.withColumn("stability", 1 - F.coalesce(safe_div(F.col("std"), F.abs("mean")), F.lit(0.0)))


def correlation_changes(rolled: DataFrame, least: float) -> DataFrame:
    w = Window.partitionBy("key").orderBy("idx")
    return rolled.withColumn("change", F.col("r") - F.lag("r").over(w)).where(F.abs("change") >= least)
