"""Composite analyses: several operators over one canonical frame, read once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div, two_sided_p
from ..operators import anomaly, calendar, correlation, descriptive, quality, seasonality, stationarity, trend
from ..operators.series import KEY, valid


def analyze(series: DataFrame, lags: int = 50) -> dict[str, DataFrame]:
    """Description, distribution, autocorrelation, stationarity and change points of each series, as lazy frames."""
    return {
        "describe": descriptive.describe(series), "histogram": descriptive.histogram(series), "kolmogorov_smirnov": descriptive.kolmogorov_smirnov(series),
        "shapiro_wilk": descriptive.shapiro_wilk(series), "normal_fit": descriptive.normal_fit(series), "autocorrelation": correlation.autocorrelation(series, lags),
        "partial_autocorrelation": stationarity.partial_autocorrelation(series, lags), "adf": stationarity.adf(series), "kpss": stationarity.kpss(series), "changepoints": stationarity.cusum_changepoints(series),
    }


def analyze_trend(series: DataFrame, period: int = 12) -> dict[str, DataFrame]:
    return {"summary": trend.trend_summary(series), "runs": trend.longest_runs(series), "breakpoints": trend.breakpoints(series), "pettitt": trend.pettitt(series), "decomposition": trend.decompose(series, period)}


def analyze_seasonality(series: DataFrame, low: int = 2, high: int = 60, period: int | None = None) -> dict[str, DataFrame]:
    """All three detections, and for a given period its profile, strength and adjustment."""
    out = {"fourier": seasonality.fourier(series), "periodogram": seasonality.periodogram(series, low, high), "acf": seasonality.acf_periods(series, low, high), "calendar": calendar.calendar_strength(series)}
    if period:
        out |= {"profile": seasonality.seasonal_profile(series, period), "strength": seasonality.seasonal_strength(series, period), "consistency": seasonality.pattern_consistency(series, period), "adjusted": seasonality.adjust(series, period)}
    return out


def combined_periods(series: DataFrame, low: int = 2, high: int = 60) -> DataFrame:
    """Periods that any of the three methods finds, with how many do."""
    peaks = seasonality.periodogram(series, low, high).where("is_peak").select(KEY, F.col("period").cast("double").alias("period"))
    acf = seasonality.acf_periods(series, low, high).select(KEY, F.col("period").cast("double").alias("period"))
    waves = seasonality.fourier(series).where("is_dominant").select(KEY, F.round("period").alias("period")).distinct()  # frequencies of a long series share periods
    return peaks.unionByName(acf).unionByName(waves).where(F.col("period").between(low, high)).groupBy(KEY, "period").agg(F.count("*").alias("n_methods"))


def insights(series: DataFrame) -> DataFrame:
    """Findings by rule from the description, trend and quality of each series."""
    d = descriptive.describe(series).select(KEY, "n", "cv", "skewness")
    t = trend.trend_summary(series).select(KEY, "direction", "r2")
    q = quality.scores(series).select(KEY, "overall", "grade")
    rules = [
        (F.col("overall") < 60, "low data quality"), (F.col("cv") > 1, "high variability"), (F.col("cv") < 0.1, "stable values"), (F.abs("skewness") > 1, "skewed distribution"),
        (F.col("direction").endswith("increasing"), "rising trend"), (F.col("direction").endswith("decreasing"), "falling trend"), (F.col("n") < 30, "few points"),
    ]
    found = F.array_compact(F.array(*[F.when(c, text) for c, text in rules]))
    return d.join(t, KEY).join(q, KEY).select(KEY, F.explode(found).alias("finding"))


def report(series: DataFrame, kind: str = "markdown") -> str:
    """A page with the summary of each section."""
    from ..sources.writers import render

    parts = {"Description": descriptive.describe(series), "Trend": trend.trend_summary(series), "Quality": quality.scores(series), "Anomalies": anomaly.statistics(anomaly.zscore(series)), "Findings": insights(series)}
    return "\n".join(render(df, kind, title=name) for name, df in parts.items())


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences of the main statistics of two frames' series of the same name."""
    cols = ("n", "mean", "std", "min", "max")
    one = descriptive.describe(a).select(KEY, *[F.col(c).alias(f"{c}_a") for c in cols])
    two = descriptive.describe(b).select(KEY, *[F.col(c).alias(f"{c}_b") for c in cols])
    return one.join(two, KEY).select(KEY, *[(F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"{c}_change") for c in cols])


@dataclass(frozen=True)
class Profile:
    """Defaults for a field of use, and the Spark settings that go with it."""

    name: str = "general"
    missing: str = "linear"
    decomposition: str = "stl"
    period: int = 12
    anomaly: str = "zscore"
    threshold: float = 3.0
    forecaster: str = "arima"
    horizon: int = 10
    confidence: float = 0.95
    quality: str = "default"
    spark: dict[str, str] = field(default_factory=lambda: {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"})

    def validated(self) -> Profile:
        from ..operators.forecasting import FORECASTERS

        problems = [m for bad, m in (
            (self.anomaly not in anomaly.DETECTORS, f"no detector {self.anomaly}"), (self.forecaster not in FORECASTERS, f"no forecaster {self.forecaster}"), (self.quality not in quality.PROFILES, f"no quality profile {self.quality}"),
            (not 0 < self.confidence < 1, "confidence lies between 0 and 1"), (self.horizon < 1, "horizon is 1 or more"), (self.threshold <= 0, "threshold is above 0"), (self.period < 2, "period is 2 or more"),
        ) if bad]
        if problems:
            raise ValueError("; ".join(problems))
        return self


PROFILES = {p.name: p for p in (Profile(), Profile("finance", period=5, anomaly="modified_zscore", threshold=3.5, quality="regulatory"), Profile("iot", missing="forward", period=24, anomaly="iqr", threshold=1.5, quality="real_time"), Profile("weather", period=365, forecaster="holt_winters"))}


STATIONARITY = {"adf": stationarity.adf, "kpss": stationarity.kpss, "pp": stationarity.phillips_perron}


def stationarity_test(series: DataFrame, method: str = "adf") -> DataFrame:
    """``test``, ``statistic``, ``p_value`` and ``is_stationary`` by one of the tests ``adf``, ``kpss`` and ``pp``, or ``all`` of them."""
    out = None
    for name in STATIONARITY if method == "all" else [method]:
        one = STATIONARITY[name](series).select(KEY, F.lit(name).alias("test"), "statistic", "p_value", "is_stationary")
        out = one if out is None else out.unionByName(one)
    return out


def trend_test(series: DataFrame, method: str = "mann_kendall", alpha: float = 0.05) -> DataFrame:
    """``test``, ``statistic`` (z, or the slope's t), ``p_value``, ``direction`` (none where it isn't significant) by ``mann_kendall``, ``linear``, or ``all``."""
    mk = trend.mann_kendall(series).select(KEY, F.lit("mann_kendall").alias("test"), F.col("z").alias("statistic"), "p_value")
    x, v = F.col("idx").cast("double"), F.col("value")
    t = valid(series).groupBy(KEY).agg(F.count("*").alias("n"), F.regr_slope(v, x).alias("b"), F.regr_r2(v, x).alias("r2")).where("n > 2")
    stat = F.signum("b") * F.sqrt(safe_div(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2")))
    line = t.select(KEY, F.lit("linear").alias("test"), stat.alias("statistic"), two_sided_p(stat).alias("p_value"))
    out = {"mann_kendall": mk, "linear": line, "all": mk.unionByName(line)}[method]
    return out.withColumn("direction", F.when(F.col("p_value") >= alpha, "none").when(F.col("statistic") > 0, "increasing").otherwise("decreasing"))


def correlation_analysis(series: DataFrame, strong: float = 0.7, most: int = 5) -> DataFrame:
    """All three coefficients of each pair with Pearson's p-value, whether it is ``strong``, and its rank among the positive and among the negative ones (null beyond ``most``)."""
    p = correlation.correlation_matrix(series, "pearson").select("var1", "var2", "n", F.col("r").alias("pearson"), "p_value")
    s = correlation.correlation_matrix(series, "spearman").select("var1", "var2", F.col("r").alias("spearman"))
    out = p.join(s, ["var1", "var2"]).join(correlation.kendall_tau(series).withColumnRenamed("tau", "kendall"), ["var1", "var2"])
    r = F.col("pearson")
    place = F.row_number().over(Window.partitionBy(r >= 0).orderBy(F.desc(F.abs(r)), "var1", "var2"))
    return out.withColumn("is_strong", F.abs(r) >= strong).withColumn("place", F.when(r.isNotNull(), place)).withColumn("place", F.when(F.col("place") <= most, F.col("place")))
