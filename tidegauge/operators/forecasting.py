"""Forecasts, their intervals, ensembles and evaluation.

A forecast frame has ``series_id, step, ts, forecast, method``. Methods that are sums or
lines are aggregates; recurrences run on whole series.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from .arima import Order, models, steps
from .grouped import per_series
from .series import by_index, KEY, valid, val

_STEPS = "step int, forecast double"


def _dated(series: DataFrame, steps: DataFrame, method: str, interval: str = "last") -> DataFrame:
    """Adds the future times: the last time plus whole intervals (the series' last, or its first)."""
    ts = F.col("ts").cast("timestamp")
    gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(by_index()))
    rows = valid(series).withColumn("gap", gap)
    pick = F.max_by("gap", "idx") if interval == "last" else F.min_by(F.col("gap"), F.when(F.col("gap").isNotNull(), F.col("idx")))
    ends = rows.groupBy(KEY).agg(F.max(F.unix_micros(ts)).alias("end"), F.coalesce(pick, F.lit(86_400_000_000)).alias("gap"))
    return steps.join(ends, KEY).select(KEY, "step", F.timestamp_micros(F.col("end") + F.col("step") * F.col("gap")).alias("ts"), "forecast", F.lit(method).alias("method"))


def _ahead(t: DataFrame, horizon: int, forecast: Column) -> DataFrame:
    return t.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(KEY, "step", forecast.cast("double").alias("forecast"))


def _numbered(series: DataFrame) -> DataFrame:
    rows = valid(series)
    return rows.withColumn("i", F.row_number().over(by_index()) - 1).join(rows.groupBy(KEY).agg(F.count("*").alias("n")), KEY)


def moving_average(series: DataFrame, horizon: int = 10, window: int = 5) -> DataFrame:
    t = _numbered(series).where(F.col("i") >= F.col("n") - window).groupBy(KEY).agg(F.avg(val()).alias("m"))
    return _dated(series, _ahead(t, horizon, F.col("m")), "moving_average")


def weighted_moving_average(series: DataFrame, horizon: int = 10, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """The last weight belongs to the last value."""
    k = len(weights)
    w = F.element_at(F.array(*[F.lit(x / sum(weights)) for x in weights]), (F.col("i") - F.col("n") + k + 1).cast("int"))
    t = _numbered(series).where(F.col("i") >= F.col("n") - k).groupBy(KEY).agg(F.sum(val() * w).alias("m"))
    return _dated(series, _ahead(t, horizon, F.col("m")), "weighted_moving_average")


def linear(series: DataFrame, horizon: int = 10) -> DataFrame:
    x = F.col("i").cast("double")
    t = _numbered(series).groupBy(KEY).agg(F.regr_slope(val(), x).alias("b"), F.regr_intercept(val(), x).alias("a"), F.count("*").alias("n"))
    return _dated(series, _ahead(t, horizon, F.col("a") + F.col("b") * (F.col("n") - 1 + F.col("step"))), "linear")


def seasonal_naive(series: DataFrame, horizon: int = 10, period: int = 7) -> DataFrame:
    last = _numbered(series).where((F.col("i") >= F.col("n") - period) & (F.col("n") >= period)).select(KEY, (F.col("i") - F.col("n") + period).alias("phase"), val().alias("forecast"))
    steps = last.select(KEY).distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("phase", F.pmod(F.col("step") - 1, F.lit(period)))
    return _dated(series, steps.join(last, [KEY, "phase"]).select(KEY, "step", "forecast"), "seasonal_naive")


def prophet_like(series: DataFrame, horizon: int = 10, capacity: float | None = None, multiplicative: bool = False, yearly: bool = False, weekly: bool = True, daily: bool = False) -> DataFrame:
    """The line through both ends, or a logistic curve, with sine terms of fixed size."""
    t = _numbered(series).groupBy(KEY, "n").agg(F.min_by("value", "i").alias("first"), F.max_by("value", "i").alias("last"))
    at = F.col("n") + F.col("step") - 1
    slope = F.coalesce(safe_div(F.col("last") - F.col("first"), F.col("n") - 1.0), F.lit(0.0))
    trend = F.col("last") + F.col("step") * slope if capacity is None else capacity / (1 + F.exp(-0.1 * (at - F.col("n") / 2)))
    wave = F.lit(0.0)
    for on, size, p in ((yearly, 0.1, 365), (weekly, 0.05, 7), (daily, 0.02, 24)):
        if on:
            wave = wave + size * F.sin(2 * math.pi * F.pmod(at, F.lit(p)) / p)
    return _dated(series, _ahead(t, horizon, trend * (1 + wave) if multiplicative else trend + wave), "prophet", "first")


def _recurrent(name: str, step: Callable[..., np.ndarray], interval: str = "last", least: int = 2) -> Callable[..., DataFrame]:
    def forecast(series: DataFrame, horizon: int = 10, **options) -> DataFrame:
        run = lambda x, _: {"step": np.arange(1, horizon + 1), "forecast": step(x, horizon, **options)}
        return _dated(series, per_series(series, run, _STEPS, max(least, 2 * options.get("period", 1))), name, interval)

    forecast.__name__, forecast.__doc__ = name, step.__doc__
    return forecast


def ses(x: np.ndarray, h: int, alpha: float = 0.3) -> np.ndarray:
    """Simple exponential smoothing from the first value: a flat forecast."""
    level = x[0]
    for v in x[1:]:
        level = alpha * v + (1 - alpha) * level
    return np.full(h, level)


def holt_winters(x: np.ndarray, h: int, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1, period: int = 7, multiplicative: bool = False) -> np.ndarray:
    """Level, trend and seasonal indices; begun with the first two cycles, updated from the second value on."""
    level = x[:period].mean()
    trend = (x[period : 2 * period].mean() - level) / period
    if multiplicative:
        season = x[:period] / level if level else np.ones(period)
    else:
        season = x[:period] - level
    season = season.copy()
    for i in range(1, len(x)):
        k, before = i % period, level
        bare = x[i] / season[k] if multiplicative and season[k] else x[i] - season[k] * (not multiplicative)
        level = alpha * bare + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        fresh = (x[i] / level if level else 1.0) if multiplicative else x[i] - level
        season[k] = gamma * fresh + (1 - gamma) * season[k]
    s = np.arange(1, h + 1)
    index = season[(len(x) - 1 + s) % period]
    return (level + s * trend) * index if multiplicative else level + s * trend + index


def ets(x: np.ndarray, h: int, trend: str = "additive", season: str = "none", period: int = 1, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1, damping: float = 0.98) -> np.ndarray:
    """Error correction with an optional (damped) trend and additive or multiplicative seasonal terms."""
    level, slope = x[0], (x[1] - x[0] if trend != "none" else 0.0)
    first = x[:period].mean()
    index = np.ones(period) if season == "multiplicative" else np.zeros(period)
    if season == "additive":
        index = x[:period] - first
        level = first
    elif season == "multiplicative" and first:
        index = x[:period] / first
        level = first
    index = index.copy()
    phi = damping if trend == "damped" else 1.0
    for t, v in enumerate(x):
        k, base = t % period, level + phi * slope
        fit = base * index[k] if season == "multiplicative" else base + index[k]
        error = v - fit
        scale = index[k] if season == "multiplicative" and index[k] else 1.0
        level = base + alpha * error / scale
        if trend != "none":
            slope = phi * slope + alpha * beta * error / scale
        if season == "additive":
            index[k] += gamma * error
        elif season == "multiplicative" and base:
            index[k] += gamma * error / base
    steps = np.arange(1, h + 1)
    ahead = slope * (np.cumsum(phi**steps) if phi != 1 else steps)
    s = index[(len(x) + steps - 1) % period]
    return (level + ahead) * s if season == "multiplicative" else level + ahead + s


def theta(x: np.ndarray, h: int, theta: float = 2.0) -> np.ndarray:
    """Exponential smoothing of the theta line, with the drift of the ends.

    The trend curve sums a line fitted to the changes; the smoothing weight is 2 / (n + 1).
    """
    n, d = len(x), np.diff(x)
    i = np.arange(n)
    slope, start = np.polyfit(np.arange(1, n), d, 1) if n > 2 else (0.0, d.mean())
    curve = x[0] + start * i + slope * i * (i + 1) / 2
    line, a = theta * x + (1 - theta) * curve, 2 / (n + 1)
    level = line[0]
    for v in line:
        level = a * v + (1 - a) * level
    return level + np.arange(1, h + 1) * (x[-1] - x[0]) / (n - 1)


def _of_order(order: Order | None, name: str, series: DataFrame, horizon: int, **options) -> DataFrame:
    fitted = models(series, order, horizon, **options)
    return _dated(series, steps(fitted).select(KEY, "step", "forecast"), name)


def arima(series: DataFrame, horizon: int = 10, p: int = 1, d: int = 1, q: int = 1) -> DataFrame:
    """Maximum likelihood ARIMA; see :mod:`.arima` for its coefficients, criteria, intervals and residuals."""
    return _of_order(Order(p, d, q), "arima", series, horizon)


def sarima(series: DataFrame, horizon: int = 10, p: int = 1, d: int = 0, q: int = 1, sp: int = 0, sd: int = 1, sq: int = 1, period: int = 7) -> DataFrame:
    """Maximum likelihood seasonal ARIMA."""
    return _of_order(Order(p, d, q, sp, sd, sq, period), "sarima", series, horizon)


def auto_arima(series: DataFrame, horizon: int = 10, period: int = 1, most: tuple[int, int, int, int] = (3, 3, 1, 1)) -> DataFrame:
    """The (seasonal) ARIMA of least AICc; ``most``: of p, q and their seasonal kin."""
    return _of_order(None, "auto_arima", series, horizon, period=period, most=most)


FORECASTERS: dict[str, Callable[..., DataFrame]] = {
    **{f.__name__: f for f in (moving_average, weighted_moving_average, linear, seasonal_naive, prophet_like, arima, sarima, auto_arima)},
    **{name: _recurrent(name, f, interval, least) for name, f, interval, least in (("ses", ses, "last", 1), ("holt_winters", holt_winters, "last", 2), ("ets", ets, "first", 2), ("theta", theta, "first", 3))},
}


def forecast(series: DataFrame, method: str = "moving_average", horizon: int = 10, **options) -> DataFrame:
    return FORECASTERS[method](series, horizon, **options)


def with_intervals(forecasts: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Bounds from the spread of the forecasts (at least a tenth of their mean), widening by sqrt(1 + (step - 1) / 10)."""
    z = 2.576 if confidence >= 0.99 else 1.96 if confidence >= 0.95 else 1.645 if confidence >= 0.9 else 1.96
    t = forecasts.groupBy(KEY, "method").agg(F.greatest(F.stddev_pop("forecast"), 0.1 * F.abs(F.avg("forecast"))).alias("sd"))
    half = z * F.col("sd") * F.sqrt(1 + (F.col("step") - 1) * 0.1)
    return forecasts.join(t, [KEY, "method"]).withColumn("lower", F.col("forecast") - half).withColumn("upper", F.col("forecast") + half).drop("sd")


def ensemble(series: DataFrame, members: dict[str, dict], horizon: int = 10, how: str = "average", weights: dict[str, float] | None = None) -> DataFrame:
    """Average, median or weighted mean of members; ``optimal`` weighs by the inverse of the squared error on the last ``horizon`` points, ``best`` takes the least."""
    every = None
    for name, options in members.items():
        one = forecast(series, name, horizon, **options)
        every = one if every is None else every.unionByName(one)
    if how in ("average", "median"):
        agg = F.avg("forecast") if how == "average" else F.percentile("forecast", 0.5)
        return every.groupBy(KEY, "step").agg(F.min("ts").alias("ts"), agg.alias("forecast")).withColumn("method", F.lit(f"ensemble_{how}"))
    if how == "weighted":
        w = F.lit(None).cast("double")
        for name, x in (weights or {}).items():
            w = F.when(F.col("method") == name, float(x)).otherwise(w)
        weighted = every.withColumn("w", w)
    else:
        errors = None
        for name, options in members.items():
            one = holdout(series, name, horizon, **options).groupBy(KEY).agg(F.avg((F.col("actual") - F.col("forecast")) ** 2).alias("mse")).withColumn("method", F.lit("prophet" if name == "prophet_like" else name))
            errors = one if errors is None else errors.unionByName(one)
        if how == "best":
            first = F.row_number().over(Window.partitionBy(KEY).orderBy("mse", "method"))
            weighted = every.join(errors.withColumn("r", first).where("r = 1"), [KEY, "method"]).withColumn("w", F.lit(1.0))
        else:
            weighted = every.join(errors, [KEY, "method"]).withColumn("w", 1 / F.greatest("mse", F.lit(1e-12)))
    return weighted.groupBy(KEY, "step").agg(F.min("ts").alias("ts"), safe_div(F.sum(F.col("forecast") * F.col("w")), F.sum("w")).alias("forecast")).withColumn("method", F.lit(f"ensemble_{how}"))


def holdout(series: DataFrame, method: str, horizon: int, skip: int = 0, **options) -> DataFrame:
    """``step``, ``actual`` and ``forecast`` of the ``horizon`` points before the last ``skip``, from what lies before them."""
    rows = _numbered(series)
    split = F.col("n") - horizon - skip
    train, test = rows.where(F.col("i") < split).drop("i", "n"), rows.where((F.col("i") >= split) & (F.col("i") < split + horizon)).select(KEY, (F.col("i") - split + 1).cast("int").alias("step"), val().alias("actual"))
    return forecast(train, method, horizon, **options).select(KEY, "step", "forecast").join(test, [KEY, "step"])


def walk_forward(series: DataFrame, method: str, horizon: int, folds: int = 5, **options) -> DataFrame:
    """Holdouts of the last ``folds`` blocks of ``horizon`` points, the training part growing."""
    out = None
    for k in range(folds):
        one = holdout(series, method, horizon, (folds - 1 - k) * horizon, **options).withColumn("fold", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def metrics(errors: DataFrame, train: DataFrame | None = None, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """MAE, RMSE, MAPE, SMAPE, R2, and MASE where the training series is given."""
    a, f = F.col("actual"), F.col("forecast")
    e = a - f
    t = errors.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.abs(safe_div(e, a)))).alias("mape"),
        (100 * F.avg(safe_div(2 * F.abs(e), F.abs(a) + F.abs(f)))).alias("smape"), (1 - safe_div(F.sum(e * e), F.var_pop(a) * F.count("*"))).alias("r2"),
    )
    if train is None:
        return t
    d = F.abs(val() - F.lag("value").over(by_index()))
    naive = valid(train).withColumn("d", d).groupBy(KEY).agg(F.avg("d").alias("naive"))
    return t.join(naive, KEY).withColumn("mase", safe_div(F.col("mae"), F.col("naive"))).drop("naive")


def residual_statistics(errors: DataFrame, lags: int = 10) -> DataFrame:
    """Mean, deviation, and the Ljung-Box statistic of residuals in step order."""
    from .correlation import autocorrelation

    r = errors.select(KEY, F.col("step").alias("idx"), F.lit(None).cast("timestamp").alias("ts"), (F.col("actual") - F.col("forecast")).alias("value"))
    q = autocorrelation(r, lags).groupBy(KEY).agg(F.max_by("ljung_box", "lag").alias("ljung_box"))
    return r.groupBy(KEY).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis")).join(q, KEY, "left")


def lag_features(series: DataFrame, steps: list[int], windows: list[int], period: int | None = None) -> DataFrame:
    """One frame with lags, rolling statistics, trend and calendar features; all windows share one sort."""
    from .calendar import calendar_features
    from .windows import lags, rolling, trend_features

    out = lags(series, sorted({*steps, *([period, 2 * period, 3 * period] if period else [])}))
    for w in windows:
        out = rolling(out, w, ["mean", "std", "min", "max"])
    out = calendar_features(trend_features(out))
    if period:
        angle = 2 * math.pi * F.pmod("idx", F.lit(period)) / period
        out = out.withColumns({"season": F.pmod("idx", F.lit(period)), "season_sin": F.sin(angle), "season_cos": F.cos(angle)})
    return out
