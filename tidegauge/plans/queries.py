"""Every operator as a query over the shared tables, with its SQL where SQL can express it.

Series come from ``events`` (one for each event type), from ``orders`` (daily totals for
each priority) and from ``lineitem`` (daily quantities for each return flag). Doubles
are rounded on both sides, since sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import anomaly, arima, breaks, calendar, correlation, degradation, descriptive, detectors_np, forecasting, ml, multivariate, quality, scan, seasonality, series, skyline, stationarity, systems, trend, warping, windows
from ..sources import readers, synthetic
from ..streaming import detector, drift, online, windowed
from . import compose

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.indexed(read(spark, sf_dir, "events"), "event_type", "ts", "value")


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderpriority", F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day"), "o_totalprice")
    daily = o.groupBy("o_orderpriority", "day").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return series.indexed(daily, "o_orderpriority", "day", "v")


def flags_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("day")).agg(F.sum("l_quantity").alias("v"))
    return series.indexed(li, "l_returnflag", "day", "v")


EVENTS = """e0 AS (SELECT event_type AS series_id, ts, avg(value) AS value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
e AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx FROM e0)"""
ORDERS = """o0 AS (SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx FROM o0)"""
FLAGS = """f0 AS (SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx FROM f0)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        if sql:
            SQL[name] = sql
        return fn

    return add


def on(source: Query, op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(source(spark, sf_dir))


# --- series, windows, fills ---------------------------------------------------------------

query("series_summary", f"""WITH {EVENTS} SELECT series_id, count(value) AS n, count(*) - count(value) AS n_missing, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
round(min(value), 6) AS min, round(max(value), 6) AS max, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS std FROM e GROUP BY 1""")(on(events, series.summary))

query("describe", f"""WITH {EVENTS}, m AS (SELECT series_id, trunc(value)::BIGINT AS whole, count(*) AS c FROM e GROUP BY 1, 2),
mm AS (SELECT series_id, CASE WHEN max(c) > 1 THEN arg_max(whole, c * 1000000000::BIGINT - whole) END AS mode FROM m GROUP BY 1),
s AS (SELECT series_id, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, var_pop(value) AS variance, min(value) AS mn, max(value) AS mx, quantile_cont(value, [.01, .05, .1, .25, .5, .75, .9, .95, .99]) AS q, skewness(value) AS sk, kurtosis_pop(value) AS g2 FROM e GROUP BY 1)
SELECT series_id, n, round(mean, 6) AS mean, round(std, 6) AS std, round(variance, 6) AS variance, round(mn, 6) AS min, round(mx, 6) AS max, round(mx - mn, 6) AS range,
round(q[1], 6) AS p01, round(q[2], 6) AS p05, round(q[3], 6) AS p10, round(q[4], 6) AS p25, round(q[5], 6) AS p50, round(q[6], 6) AS p75, round(q[7], 6) AS p90, round(q[8], 6) AS p95, round(q[9], 6) AS p99,
round(q[6] - q[4], 6) AS iqr, mode, round(sk, 6) AS skewness, round(((n + 1) * g2 - 3 * (n - 1)) * (n - 1) / ((n - 2.0) * (n - 3)), 6) AS kurtosis, round(std / abs(mean), 6) AS cv FROM s JOIN mm USING (series_id)""")(on(events, descriptive.describe))

query("median_absolute_deviation", f"""WITH {EVENTS}, m AS (SELECT series_id, quantile_cont(value, .5) AS median FROM e GROUP BY 1)
SELECT series_id, round(median, 6) AS median, round(quantile_cont(abs(value - median), .5), 6) AS mad FROM e JOIN m USING (series_id) GROUP BY 1, median""")(on(events, descriptive.mad))

query("time_slice", f"""WITH {EVENTS} SELECT series_id || '_slice' AS series_id, ts, round(value, 6) AS value, idx FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'""")(
    lambda spark, d: series.time_slice(events(spark, d), "2024-01-05", "2024-01-10").drop("vidx"))

query("infer_frequency", f"""WITH {EVENTS}, g AS (SELECT series_id, idx, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series_id ORDER BY idx) AS gap FROM e),
a AS (SELECT series_id, avg(gap) AS g FROM g WHERE idx <= 9 GROUP BY 1)
SELECT series_id, CASE floor(g / 1e6) WHEN 1 THEN 'second' WHEN 60 THEN 'minute' WHEN 3600 THEN 'hour' WHEN 86400 THEN 'day' WHEN 604800 THEN 'week' ELSE 'custom_' || floor(g / 1e6)::BIGINT || 's' END AS frequency, round(g / 1e6, 6) AS mean_interval_s FROM a""")(
    on(events, series.infer_frequency))

_W = "OVER (PARTITION BY series_id ORDER BY idx"
query("lags", f"""WITH {EVENTS} SELECT series_id, ts, round(value, 6) AS value, idx, round(lag(value, 1) {_W}), 6) AS lag_1, round(lag(value, 7) {_W}), 6) AS lag_7 FROM e""")(on(events, lambda s: windows.lags(s, [1, 7]).drop("vidx")))

_R = "OVER (PARTITION BY series_id ORDER BY idx ROWS 9 PRECEDING)"
query("rolling", f"""WITH {EVENTS}, r AS (SELECT series_id, idx, count(*) {_R} AS k, avg(value) {_R} AS a, stddev_pop(value) {_R} AS s, min(value) {_R} AS lo, max(value) {_R} AS hi, quantile_cont(value, .5) {_R} AS md, list_sort(list(value) {_R})[8] AS q FROM e)
SELECT series_id, idx, CASE WHEN k = 10 THEN round(a, 6) END AS rolling_10_mean, CASE WHEN k = 10 THEN round(s, 6) END AS rolling_10_std, CASE WHEN k = 10 THEN round(lo, 6) END AS rolling_10_min, CASE WHEN k = 10 THEN round(hi, 6) END AS rolling_10_max,
CASE WHEN k = 10 THEN round(md, 6) END AS rolling_10_median, CASE WHEN k = 10 THEN round(q, 6) END AS "rolling_10_0.75q" FROM r""")(
    on(events, lambda s: windows.rolling(s, 10, ["mean", "std", "min", "max", "median"], [0.75]).drop("ts", "value", "vidx")))

query("expanding_head", f"""WITH {EVENTS} SELECT series_id, idx, round(avg(value) {_R}, 6) AS ma, round(stddev_pop(value) {_R}, 6) AS mstd, round(quantile_cont(value, .5) {_R}, 6) AS mmedian FROM e""")(
    on(events, lambda s: windows.expanding_head(s, 10).drop("ts", "value", "vidx")))

query("trend_features", f"""WITH {EVENTS} SELECT series_id, idx, idx AS trend, idx * idx AS trend_squared, round(value - lag(value) {_W}), 6) AS first_diff, round(value - 2 * lag(value) {_W}) + lag(value, 2) {_W}), 6) AS second_diff FROM e""")(
    on(events, lambda s: windows.trend_features(s).drop("ts", "value", "vidx")))

query("rate_of_change", f"""WITH {EVENTS}, r AS (SELECT series_id, idx, (value - lag(value, 5) {_W})) / 5 AS rate FROM e) SELECT series_id, idx, round(rate, 6) AS rate, round(rate - lag(rate) {_W}), 6) AS acceleration FROM r""")(
    on(events, lambda s: windows.rate_of_change(s, 5).drop("ts", "value", "vidx")))


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event series with every 7th value, and two in a row, missing."""
    return events(spark, sf_dir).withColumn("value", F.when((F.col("idx") % 7 != 3) & (F.col("idx") % 11 != 4), F.col("value")))


def holed_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in blocks, numbered there too."""
    e = scan.with_index(scan.dealt(series.canonicalize(series.to_series(read(spark, sf_dir, "events"), "event_type", "ts", "value"))))
    return e.withColumn("value", F.when((F.col("idx") % 7 != 3) & (F.col("idx") % 11 != 4), F.col("value")))


HOLED = EVENTS + ", h AS (SELECT series_id, ts, idx, CASE WHEN idx % 7 <> 3 AND idx % 11 <> 4 THEN value END AS value FROM e)"
query("forward_fill", f"""WITH {HOLED} SELECT series_id, idx, round(last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 6) AS filled FROM h""")(on(holed, lambda s: windows.forward_fill(s).select("series_id", "idx", "filled")))
query("backward_fill", f"""WITH {HOLED} SELECT series_id, idx, round(first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS filled FROM h""")(on(holed, lambda s: windows.backward_fill(s).select("series_id", "idx", "filled")))
_LINEAR = """, b AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN value IS NOT NULL THEN {at} END IGNORE NULLS) OVER p AS t0, first_value(value IGNORE NULLS) OVER n AS v1, first_value(CASE WHEN value IS NOT NULL THEN {at} END IGNORE NULLS) OVER n AS t1 FROM h
WINDOW p AS (PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, idx, round(coalesce(value, v0 + (v1 - v0) * ({at} - t0) / nullif(t1 - t0, 0)), 6) AS filled FROM b"""
query("linear_fill", f"WITH {HOLED}" + _LINEAR.format(at="idx"))(on(holed, lambda s: windows.linear_fill(s).select("series_id", "idx", "filled")))
query("linear_fill_by_time", f"WITH {HOLED}" + _LINEAR.format(at="(epoch_us(ts) / 1e6)"), 4)(on(holed, lambda s: windows.linear_fill(s, "ts").select("series_id", "idx", "filled")))
SQL["linear_fill_by_time"] = SQL["linear_fill_by_time"].replace(", 6) AS filled", ", 4) AS filled")
for _stat, _agg in (("mean", "avg(value)"), ("median", "quantile_cont(value, .5)")):
    query(f"fill_{_stat}", f"WITH {HOLED}, t AS (SELECT series_id, {_agg} AS t FROM h GROUP BY 1) SELECT series_id, idx, round(coalesce(value, t), 6) AS filled FROM h JOIN t USING (series_id)")(on(holed, lambda s, k=_stat: windows.statistic_fill(s, k).select("series_id", "idx", "filled")))
    query(f"window_fill_{_stat}", f"WITH {HOLED} SELECT series_id, idx, round(coalesce(value, {_agg} OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), 6) AS filled FROM h")(on(holed, lambda s, k=_stat: windows.window_fill(s, 5, k).select("series_id", "idx", "filled")))
query("constant_fill", f"WITH {HOLED} SELECT series_id, idx, round(coalesce(value, 0), 6) AS filled FROM h")(on(holed, lambda s: windows.constant_fill(s, 0).select("series_id", "idx", "filled")))
for _name in ("forward_fill", "backward_fill", "linear_fill"):
    query(f"{_name}_by_blocks", SQL[_name])(on(holed_by_blocks, lambda s, f=_name: getattr(scan, f)(s).select("series_id", "idx", "filled")))
query("index_by_blocks", f"WITH {HOLED} SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx, CASE WHEN value IS NOT NULL THEN count(value) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 END AS vidx FROM h")(on(holed, lambda s: scan.with_index(scan.dealt(s.select("series_id", "ts", "value"))).select("series_id", "ts", "idx", "vidx")))
query("ewma")(on(holed, lambda s: windows.ewma(s, 0.3).drop("ts")))
query("exponential_fill")(on(holed, lambda s: windows.exponential_fill(s, 0.3).select("series_id", "idx", "filled")))
_C = "OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
query("centred_moving_average", f"WITH {HOLED} SELECT series_id, idx, round(avg(value) {_C}, 6) AS smooth FROM h")(on(holed, lambda s: windows.moving_average(s, 5).select("series_id", "idx", "smooth")))
query("median_filter", f"WITH {HOLED} SELECT series_id, idx, round(quantile_cont(value, .5) {_C}, 6) AS smooth FROM h")(on(holed, lambda s: windows.median_filter(s, 5).select("series_id", "idx", "smooth")))
query("zscore_normalize", f"WITH {EVENTS}, t AS (SELECT series_id, avg(value) AS m, stddev_pop(value) AS s FROM e GROUP BY 1) SELECT series_id, idx, round((value - m) / s, 6) AS normalized FROM e JOIN t USING (series_id)")(on(events, lambda s: windows.zscore_normalize(s).select("series_id", "idx", "normalized")))
query("minmax_normalize", f"WITH {EVENTS}, t AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM e GROUP BY 1) SELECT series_id, idx, round((value - lo) / (hi - lo), 6) AS normalized FROM e JOIN t USING (series_id)")(on(events, lambda s: windows.minmax_normalize(s).select("series_id", "idx", "normalized")))
for _how, _agg in (("mean", "avg(value)"), ("sum", "sum(value)"), ("min", "min(value)"), ("max", "max(value)"), ("first", "arg_min(value, ts)"), ("last", "arg_max(value, ts)")):
    query(f"resample_{_how}", f"WITH {EVENTS} SELECT series_id, time_bucket(INTERVAL '6 hours', ts) AS ts, round({_agg}, 6) AS value FROM e GROUP BY 1, 2")(on(events, lambda s, k=_how: windows.resample(s, "6 hours", k)))
query("resample_count", f"WITH {EVENTS} SELECT series_id, time_bucket(INTERVAL '6 hours', ts) AS ts, count(value) AS value FROM e GROUP BY 1, 2")(on(events, lambda s: windows.resample(s, "6 hours", "count")))
query("regular_spine", f"""WITH {ORDERS}, r AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM o GROUP BY 1)
SELECT r.series_id, r.ts, round(o.value, 6) AS value FROM r LEFT JOIN o ON o.series_id = r.series_id AND o.ts = r.ts""")(on(orders_daily, lambda s: windows.regular_spine(s, "1 day")))
_GAPS = ", g AS (SELECT *, lag(ts) OVER w AS gap_start, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap_s FROM e WINDOW w AS (PARTITION BY series_id ORDER BY idx))"
query("gaps", f"""WITH {EVENTS}{_GAPS}, u AS (SELECT series_id, quantile_cont(gap_s, .5) AS usual_s FROM g GROUP BY 1)
SELECT series_id, gap_start, ts AS gap_end, round(gap_s, 6) AS gap_s, (floor(gap_s / usual_s + .5) - 1)::BIGINT AS missing_points FROM g JOIN u USING (series_id) WHERE gap_s > 5 * usual_s""")(on(events, lambda s: windows.gaps(s, 5.0, None)))
query("temporal_coverage", f"""WITH {EVENTS}{_GAPS} SELECT series_id, count(*) AS n, round(avg(gap_s), 6) AS mean_s, round(stddev_pop(gap_s), 6) AS std_s, min(ts) AS start, max(ts) AS "end", round(stddev_pop(gap_s) / avg(gap_s), 6) AS cv, stddev_pop(gap_s) / avg(gap_s) < .1 AS is_regular FROM g GROUP BY 1""")(on(events, windows.temporal_coverage))
query("average_ranks", f"WITH {EVENTS} SELECT series_id, idx, rank() OVER (PARTITION BY series_id ORDER BY value) + (count(*) OVER (PARTITION BY series_id, value) - 1) / 2 AS rank FROM e")(on(events, lambda s: windows.average_ranks(s, "value", ["series_id"]).select("series_id", "idx", "rank")))
query("session_windows", None)(lambda spark, d: windows.session_windows(read(spark, d, "events"), "user_id", "ts", "value", "30 minutes"))
query("sliding_windows", """SELECT event_type AS series_id, s AS start, s + INTERVAL '2 hours' AS "end", count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM (SELECT *, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS s FROM events) GROUP BY 1, 2""")(
    lambda spark, d: windowed.tumbling(windowed.as_events(read(spark, d, "events"), "event_type", "ts", "value"), "2 hours", slide="1 hour"))

# --- distributions ------------------------------------------------------------------------

query("histogram", f"""WITH {EVENTS}, t AS (SELECT series_id, min(value) AS lo, max(value) AS hi, count(*) AS n FROM e GROUP BY 1), b AS (SELECT series_id, lo, n, (hi - lo) / 20 AS w, unnest(range(20)) AS bin FROM t),
c AS (SELECT e.series_id, least(floor((value - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS k FROM e JOIN t USING (series_id) GROUP BY 1, 2)
SELECT b.series_id, b.bin, round(lo + b.bin * w, 6) AS left_edge, coalesce(k, 0) AS count, round(coalesce(k, 0) / (n * w), 6) AS density FROM b LEFT JOIN c ON b.series_id = c.series_id AND b.bin = c.bin""")(on(events, lambda s: descriptive.histogram(s, 20)))
query("standardized_moments")(on(events, descriptive.standardized_moments))
query("histogram_auto")(on(events, descriptive.histogram))
query("qq_points")(on(events, descriptive.qq_points))
query("shapiro_wilk")(on(events, descriptive.shapiro_wilk))
query("normality", None, 4)(on(events, lambda s: descriptive.normality(s, most=2000)))
query("kolmogorov_smirnov")(on(events, descriptive.kolmogorov_smirnov))
query("normal_fit", f"""WITH {EVENTS}, t AS (SELECT series_id, count(*) AS n, avg(value) AS mu, stddev_samp(value) AS sigma, var_pop(value) AS v FROM e GROUP BY 1),
l AS (SELECT *, -n / 2 * ln(2 * pi() * sigma ** 2) - n * v / (2 * sigma ** 2) AS ll FROM t) SELECT series_id, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(ll, 4) AS log_likelihood, round(4 - 2 * ll, 4) AS aic FROM l""")(
    on(events, lambda s: descriptive.normal_fit(s).withColumns({c: F.round(c, 4) for c in ("log_likelihood", "aic")})))
query("entropy", f"""WITH {EVENTS}, t AS (SELECT series_id, min(value) AS lo, max(value) AS hi, count(*) AS n FROM e GROUP BY 1), c AS (SELECT series_id, n, count(*) / n AS p FROM e JOIN t USING (series_id) GROUP BY series_id, n, least(floor((value - lo) / ((hi - lo) / 10)), 9))
SELECT series_id, round(-sum(p * log2(p)), 6) AS entropy FROM c GROUP BY 1""")(on(events, descriptive.entropy))
query("kernel_density")(on(events, lambda s: descriptive.kernel_density(s, 50)))
query("data_quality_report", f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM e),
q AS (SELECT series_id, max(value) FILTER (i = n // 4) AS q1, max(value) FILTER (i = 3 * n // 4) AS q3 FROM r GROUP BY 1)
SELECT series_id, count(*) AS n, 0 AS n_missing, 0 AS n_infinite, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers,
round(1 - count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(*), 6) AS score FROM e JOIN q USING (series_id) GROUP BY 1""")(on(events, descriptive.data_quality_report))

# --- anomalies ----------------------------------------------------------------------------

_SEV = "CASE WHEN {r} >= {c} THEN 'critical' WHEN {r} >= {h} THEN 'high' WHEN {r} >= {m} THEN 'medium' ELSE 'low' END"
_Z = f"""z AS (SELECT e.*, abs(value - m) / s AS score, m FROM e JOIN (SELECT series_id, avg(value) AS m, stddev_pop(value) AS s FROM e GROUP BY 1) USING (series_id) WHERE abs(value - m) / nullif(s, 0) > {{t}})"""
query("anomaly_zscore", f"WITH {EVENTS}, {_Z.format(t=2.5)} SELECT series_id, idx, ts, round(value, 6) AS value, round(score, 6) AS score, {_SEV.format(r='score / 2.5', m=1.2, h=1.5, c=2.0)} AS severity, round(m, 6) AS expected, 'zscore' AS method FROM z")(on(events, lambda s: anomaly.zscore(s, 2.5)))
query("anomaly_modified_zscore", f"""WITH {EVENTS}, m AS (SELECT series_id, quantile_cont(value, .5) AS med FROM e GROUP BY 1), d AS (SELECT e.*, med, abs(value - med) AS dev FROM e JOIN m USING (series_id)), a AS (SELECT series_id, quantile_cont(dev, .5) AS mad FROM d GROUP BY 1),
z AS (SELECT *, .6745 * dev / mad AS score FROM d JOIN a USING (series_id)) SELECT series_id, idx, ts, round(value, 6) AS value, round(score, 6) AS score, {_SEV.format(r='score / 3.5', m=1.2, h=1.5, c=2.0)} AS severity, round(med, 6) AS expected, 'modified_zscore' AS method FROM z WHERE score > 3.5""")(on(events, anomaly.modified_zscore))
_IQR = """q AS (SELECT series_id, quantile_cont(value, .25) AS q1, quantile_cont(value, .75) AS q3 FROM e GROUP BY 1),
z AS (SELECT *, greatest(q1 - 1.5 * (q3 - q1) - value, value - q3 - 1.5 * (q3 - q1)) / (q3 - q1) AS score FROM e JOIN q USING (series_id))"""
query("anomaly_iqr", f"WITH {EVENTS}, {_IQR} SELECT series_id, idx, ts, round(value, 6) AS value, round(score, 6) AS score, {_SEV.format(r='score / 1.5', m=1.5, h=2.0, c=3.0)} AS severity, round((q1 + q3) / 2, 6) AS expected, 'iqr' AS method FROM z WHERE score > 0")(on(events, anomaly.iqr))
query("anomaly_grubbs", f"""WITH {EVENTS}, t AS (SELECT series_id, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM e GROUP BY 1), z AS (SELECT *, abs(value - m) / s AS score, (n - 1) / sqrt(n) * sqrt(1.96 ** 2 / (n - 2 + 1.96 ** 2)) AS lim FROM e JOIN t USING (series_id))
SELECT series_id, idx, ts, round(value, 6) AS value, round(score, 6) AS score, {_SEV.format(r='score / lim', m=1.2, h=1.5, c=2.0)} AS severity, round(m, 6) AS expected, 'grubbs' AS method FROM z WHERE score > lim""")(on(events, anomaly.grubbs))
query("anomaly_level_shift", f"""WITH {EVENTS}, k AS (SELECT *, greatest(5, least(20, count(*) OVER (PARTITION BY series_id) // 10)) AS w, count(*) OVER (PARTITION BY series_id) AS n FROM e),
w AS (SELECT k.series_id, k.idx, any_value(k.ts) AS ts, any_value(k.value) AS value, any_value(k.w) AS w, avg(x.value) FILTER (WHERE x.idx < k.idx) AS m0, var_pop(x.value) FILTER (WHERE x.idx < k.idx) AS v0, avg(x.value) FILTER (WHERE x.idx >= k.idx + 1) AS m1, var_pop(x.value) FILTER (WHERE x.idx >= k.idx + 1) AS v1
FROM k JOIN e x ON x.series_id = k.series_id AND x.idx >= k.idx - k.w AND x.idx < k.idx + 1 + k.w WHERE k.idx >= k.w AND k.idx < k.n - k.w GROUP BY 1, 2),
z AS (SELECT *, abs(m1 - m0) / greatest((sqrt(v0) + sqrt(v1)) / 2, .001) AS score FROM w)
SELECT series_id, idx, ts, round(value, 6) AS value, round(score, 6) AS score, {_SEV.format(r='score', m=2.0, h=3.0, c=5.0)} AS severity, round(m0, 6) AS expected, 'level_shift' AS method FROM z WHERE score > .8""")(on(events, lambda s: anomaly.level_shift(s, 0.8)))
query("anomaly_trend_deviation")(on(events, anomaly.trend_deviation))
query("anomaly_volatility")(on(events, anomaly.volatility))
query("anomaly_seasonal")(on(events, lambda s: anomaly.seasonal_decomposition(s, 24)))
_PROFILE = """, u AS (SELECT series_id, {slot} AS slot, count(*) AS k, avg(value) AS m, greatest(stddev_pop(value), .1) AS s FROM e WHERE idx < {base} GROUP BY 1, 2 HAVING count(*) >= 2),
z AS (SELECT e.*, m, abs(value - m) / s AS score FROM e JOIN u ON e.series_id = u.series_id AND {slot} = u.slot WHERE idx >= {base})
SELECT series_id, idx, ts, round(value, 6) AS value, round(score, 6) AS score, {sev} AS severity, round(m, 6) AS expected, '{name}' AS method FROM z WHERE score > {t}"""
query("anomaly_day_of_week", f"WITH {EVENTS}" + _PROFILE.format(slot="(isodow(e.ts) - 1)", base=500, name="day_of_week", t=3, sev=_SEV.format(r="score / 3", m=1.5, h=2.0, c=2.5)))(on(events, lambda s: anomaly.day_of_week(s, 500)))
query("anomaly_hourly", f"WITH {EVENTS}" + _PROFILE.format(slot="hour(e.ts)", base=500, name="hourly", t=2.5, sev=_SEV.format(r="score / 2.5", m=1.5, h=2.0, c=2.5)))(on(events, lambda s: anomaly.hourly_pattern(s, 500)))
query("anomaly_seasonal_context")(on(events, lambda s: anomaly.seasonal_context(s, [7, 24])))
query("anomaly_index_iqr", f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM e), q AS (SELECT series_id, max(value) FILTER (i = n // 4) AS q1, max(value) FILTER (i = 3 * n // 4) AS q3 FROM r GROUP BY 1),
z AS (SELECT *, greatest(q1 - 1.5 * (q3 - q1) - value, value - q3 - 1.5 * (q3 - q1)) / (q3 - q1) AS score FROM e JOIN q USING (series_id))
SELECT series_id, idx, ts, round(value, 6) AS value, round(score, 6) AS score, {_SEV.format(r='score / 1.5', m=1.5, h=2.0, c=3.0)} AS severity, round((q1 + q3) / 2, 6) AS expected, 'index_iqr' AS method FROM z WHERE score > 0""")(on(events, anomaly.index_iqr))
query("anomaly_temporal_iqr")(on(events, lambda s: anomaly.temporal_iqr(s, 20)))
query("anomaly_multivariate")(lambda spark, d: anomaly.multivariate(orders_daily(spark, d).where("series_id = '1-URGENT'"), orders_daily(spark, d).where("series_id = '2-HIGH'")))
query("detect_anomalies", f"""WITH {EVENTS}, {_Z.format(t=3.0)}, zz AS (SELECT series_id, idx, ts, value, score, m AS expected, 'zscore' AS method FROM z), {_IQR.replace('z AS', 'y AS')},
b AS (SELECT * FROM zz UNION ALL SELECT series_id, idx, ts, value, score, (q1 + q3) / 2, 'iqr' FROM y WHERE score > 0),
c AS (SELECT series_id, idx, max({{'s': score, 'm': method, 'ts': ts, 'v': value, 'e': expected}}) AS r, count(*) AS n_methods FROM b GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY r.s DESC, idx) AS place FROM c)
SELECT series_id, idx, r.ts AS ts, round(r.v, 6) AS value, round(r.s, 6) AS score, {_SEV.format(r='r.s', m=2, h=3, c=4)} AS severity, round(r.e, 6) AS expected, r.m AS method, n_methods, place FROM t WHERE place <= 10""")(on(events, anomaly.detect))
query("ensemble_vote")(on(events, lambda s: anomaly.ensemble_vote(s, {"zscore": {}, "iqr": {}, "modified_zscore": {}}, 0.6)))
query("anomaly_statistics", f"""WITH {EVENTS}, {_Z.format(t=2.0)} SELECT series_id, count(*) AS n, count(*) FILTER (score / 2 < 1.2) AS n_low, count(*) FILTER (score / 2 >= 1.2 AND score / 2 < 1.5) AS n_medium, count(*) FILTER (score / 2 >= 1.5 AND score / 2 < 2) AS n_high, count(*) FILTER (score / 2 >= 2) AS n_critical,
round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score FROM z GROUP BY 1""")(on(events, lambda s: anomaly.statistics(anomaly.zscore(s, 2.0))))
query("temporal_patterns", f"""WITH {EVENTS}, {_Z.format(t=2.0)}, p AS (SELECT series_id, 'hour' AS part, hour(ts) AS slot FROM z UNION ALL SELECT series_id, 'weekday', isodow(ts) - 1 FROM z UNION ALL SELECT series_id, 'month', month(ts) FROM z),
c AS (SELECT series_id, part, slot, count(*) AS count FROM p GROUP BY 1, 2, 3), k AS (SELECT series_id, part, arg_max(slot, count * 1000 + slot) AS peak FROM c GROUP BY 1, 2) SELECT series_id, part, slot::INT AS slot, count, slot = peak AS is_peak FROM c JOIN k USING (series_id, part)""")(on(events, lambda s: anomaly.temporal_patterns(anomaly.zscore(s, 2.0))))
query("temporal_clusters", f"""WITH {EVENTS}, {_Z.format(t=1.5)}, n AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL '1 hour' THEN 0 ELSE 1 END AS new FROM z WINDOW w AS (PARTITION BY series_id ORDER BY ts, idx)), r AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY ts, idx) AS run FROM n)
SELECT series_id, min(ts) AS start, max(ts) AS "end", count(*) AS n, round(avg(score), 6) AS mean_score FROM r GROUP BY series_id, run HAVING count(*) >= 2""")(on(events, lambda s: anomaly.temporal_clusters(anomaly.zscore(s, 1.5))))
query("group_by_window", f"WITH {EVENTS}, {_Z.format(t=1.5)} SELECT series_id, floor(floor(epoch_us(ts) / 1e6) / 3600)::BIGINT AS window_id, count(*) AS n, round(max(score), 6) AS max_score FROM z GROUP BY 1, 2")(on(events, lambda s: anomaly.group_by_window(anomaly.zscore(s, 1.5), 60)))
query("merge_nearby")(on(events, lambda s: anomaly.merge_nearby(anomaly.zscore(s, 1.5), 3)))
query("anomaly_density", f"WITH {EVENTS}, {_Z.format(t=2.0)}, h AS (SELECT series_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS hours FROM e GROUP BY 1) SELECT series_id, round(count(z.idx) / hours, 6) AS per_hour FROM h LEFT JOIN z USING (series_id) GROUP BY series_id, hours")(on(events, lambda s: anomaly.density(anomaly.zscore(s, 2.0), s)))
query("thresholds", f"""WITH {EVENTS}, t AS (SELECT series_id, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, .5) AS med, quantile_cont(value, .95) AS p FROM e GROUP BY 1), d AS (SELECT series_id, m, s, p, med, quantile_cont(abs(value - med), .5) AS mad FROM e JOIN t USING (series_id) GROUP BY ALL)
SELECT series_id, round(m + 3 * s, 6) AS adaptive, round(med + 3 * 1.4826 * mad, 6) AS robust, round(p, 6) AS percentile FROM d""")(on(events, anomaly.thresholds))
for _action in ("remove", "cap", "replace", "smooth"):
    query(f"outliers_{_action}")(on(events, lambda s, a=_action: anomaly.treat_outliers(s, anomaly.iqr(s), a).select("series_id", "idx", "cleaned")))
SQL["outliers_remove"] = f"WITH {EVENTS}, {_IQR} SELECT series_id, idx, CASE WHEN score > 0 THEN NULL ELSE round(value, 6) END AS cleaned FROM z"
SQL["outliers_cap"] = f"WITH {EVENTS}, {_IQR}, p AS (SELECT series_id, quantile_cont(value, .05) AS lo, quantile_cont(value, .95) AS hi FROM e GROUP BY 1) SELECT series_id, idx, round(CASE WHEN score > 0 THEN greatest(lo, least(hi, value)) ELSE value END, 6) AS cleaned FROM z JOIN p USING (series_id)"
query("isolation_forest")(on(events, lambda s: detectors_np.isolation_forest(s, 0.02, 50)))
query("local_outlier_factor")(on(events, lambda s: detectors_np.local_outlier_factor(s, 10, 0.02)))
query("dbscan")(on(events, lambda s: detectors_np.dbscan(s, 0.5, 3)))

# --- trend --------------------------------------------------------------------------------

query("linear_trend", f"WITH {EVENTS} SELECT series_id, count(*) AS n, round(regr_slope(value, idx), 6) AS slope, round(regr_intercept(value, idx), 6) AS intercept, round(regr_r2(value, idx), 6) AS r2, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM e GROUP BY 1")(on(events, trend.linear_trend))
query("directional_consistency", f"""WITH {EVENTS}, d AS (SELECT series_id, value - lag(value) {_W}) AS d FROM e), c AS (SELECT series_id, count(*) FILTER (d > 0)::DOUBLE AS p, count(*) FILTER (d < 0)::DOUBLE AS q FROM d GROUP BY 1) SELECT series_id, round((p * (p - 1) + q * (q - 1)) / ((p + q) * (p + q - 1)), 6) AS consistency FROM c""")(on(events, trend.directional_consistency))
query("trend_summary")(on(orders_daily, trend.trend_summary))
query("longest_runs", f"""WITH {EVENTS}, d AS (SELECT series_id, idx, sign(value - lag(value) {_W})) AS s FROM e), n AS (SELECT *, CASE WHEN s = lag(s) {_W}) THEN 0 ELSE 1 END AS new FROM d WHERE s <> 0), r AS (SELECT *, sum(new) {_W}) AS run FROM n), c AS (SELECT series_id, s, run, count(*) AS k FROM r GROUP BY 1, 2, 3)
SELECT series_id, coalesce(max(k) FILTER (s = 1), 0) AS longest_rise, coalesce(max(k) FILTER (s = -1), 0) AS longest_fall FROM c GROUP BY 1""")(on(events, trend.longest_runs))
query("breakpoints")(on(events, trend.breakpoints))
query("mann_kendall")(on(flags_daily, trend.mann_kendall))
query("mann_kendall_counted")(on(events, lambda s: detectors_np.mann_kendall(s).withColumn("p_value", F.round("p_value", 4))))
query("sens_slope")(on(lambda s, d: flags_daily(s, d), trend.sens_slope))
SQL["sens_slope"] = f"""WITH {FLAGS}, s AS (SELECT a.series_id, quantile_cont((b.value - a.value) / (b.idx - a.idx), .5) AS slope FROM f a JOIN f b ON a.series_id = b.series_id AND a.idx < b.idx GROUP BY 1), m AS (SELECT series_id, quantile_cont(value, .5) AS mv, quantile_cont(idx, .5) AS mi FROM f GROUP BY 1)
SELECT series_id, round(slope, 6) AS slope, round(mv - slope * mi, 6) AS intercept FROM s JOIN m USING (series_id)"""
query("pettitt")(on(events, trend.pettitt))
query("detrend_linear", f"WITH {EVENTS}, t AS (SELECT series_id, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a FROM e GROUP BY 1) SELECT series_id, idx, round(a + b * idx, 6) AS trend, round(value - a - b * idx, 6) AS detrended FROM e JOIN t USING (series_id)")(on(events, lambda s: trend.detrend_linear(s).select("series_id", "idx", "trend", "detrended")))
query("difference", f"WITH {EVENTS} SELECT series_id, idx, round(value - 2 * lag(value) {_W}) + lag(value, 2) {_W}), 6) AS detrended FROM e")(on(events, lambda s: trend.difference(s, 2).select("series_id", "idx", "detrended")))
query("detrend_moving_average", f"WITH {EVENTS}, t AS (SELECT *, CASE WHEN count(value) {_C} = 5 THEN avg(value) {_C} END AS trend FROM e) SELECT series_id, idx, round(trend, 6) AS trend, round(value - trend, 6) AS detrended FROM t")(on(events, lambda s: trend.detrend_moving_average(s, 5).select("series_id", "idx", "trend", "detrended")))
query("hodrick_prescott")(on(events, detectors_np.hodrick_prescott))
query("decompose_additive", None, 3)(on(orders_daily, lambda s: trend.decompose(s, 7)))
query("decompose_multiplicative", None, 5)(on(orders_daily, lambda s: trend.decompose(s, 12, True)))
query("stl", None, 3)(on(orders_daily, lambda s: trend.stl(s, 7)))
query("decomposition_strength")(on(orders_daily, lambda s: trend.seasonal_strength(trend.decompose(s, 7))))

# --- correlation --------------------------------------------------------------------------

query("autocorrelation", f"""WITH {EVENTS}, t AS (SELECT series_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM e GROUP BY 1), c AS (SELECT e.series_id, idx, n, v, value - m AS x FROM e JOIN t USING (series_id)), l AS (SELECT unnest(range(11)) AS lag),
r AS (SELECT a.series_id, lag, a.n, sum(a.x * b.x) / a.n / a.v AS acf FROM c a JOIN l ON true JOIN c b ON b.series_id = a.series_id AND b.idx = a.idx + lag GROUP BY a.series_id, lag, a.n, a.v)
SELECT series_id, lag::INT AS lag, n, round(acf, 6) AS acf, round(CASE WHEN lag > 0 THEN 1.96 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf ** 2 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) ELSE 0 END, 6) AS bound,
round(n * (n + 2) * sum(CASE WHEN lag > 0 THEN acf ** 2 / (n - lag) ELSE 0 END) OVER (PARTITION BY series_id ORDER BY lag), 6) AS ljung_box FROM r""")(on(events, lambda s: correlation.autocorrelation(s, 10)))
query("seasonal_patterns")(on(flags_daily, lambda s: correlation.seasonal_patterns(correlation.autocorrelation(s, 52))))
query("optimal_lag")(on(events, lambda s: stationarity.optimal_lag(stationarity.partial_autocorrelation(s, 20))))
query("partial_autocorrelation")(on(events, lambda s: stationarity.partial_autocorrelation(s, 20)))
query("significant_lags")(on(events, lambda s: correlation.significant_lags(correlation.autocorrelation(s, 20))))


def _xy(spark: SparkSession, d: str) -> DataFrame:
    o = orders_daily(spark, d)
    a, b = (o.where(F.col("series_id") == p).select("idx", F.col("value").alias(n)) for p, n in (("1-URGENT", "x"), ("2-HIGH", "y")))
    return a.join(b, "idx")


_XY = f"{ORDERS}, xy AS (SELECT a.idx, a.value AS x, b.value AS y FROM o a JOIN o b ON a.idx = b.idx AND a.series_id = '1-URGENT' AND b.series_id = '2-HIGH')"
query("cross_correlation", f"""WITH {_XY}, t AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM xy), l AS (SELECT unnest(range(-5, 6)) AS lag)
SELECT lag::INT AS lag, count(*) AS k, round(avg((a.x - mx) * (b.y - my)) / (any_value(sx) * any_value(sy)), 6) AS ccf FROM xy a JOIN l ON true JOIN xy b ON b.idx = a.idx + lag JOIN t ON true GROUP BY 1""")(on(_xy, lambda p: correlation.cross_correlation(p, 5)))
query("lead_lag")(on(_xy, lambda p: correlation.lead_lag(correlation.cross_correlation(p, 5))))
query("correlation_pearson", f"""WITH {ORDERS}, p AS (SELECT a.series_id AS var1, b.series_id AS var2, count(*) AS n, corr(a.value, b.value) AS r FROM o a JOIN o b ON a.idx = b.idx AND a.series_id < b.series_id GROUP BY 1, 2)
SELECT var1, var2, n, round(r, 6) AS r FROM p""")(on(orders_daily, lambda s: correlation.correlation_matrix(s).select("var1", "var2", "n", "r")))
query("correlation_spearman", f"""WITH {ORDERS}, p AS (SELECT a.series_id AS var1, b.series_id AS var2, a.value AS x, b.value AS y FROM o a JOIN o b ON a.idx = b.idx AND a.series_id < b.series_id),
r AS (SELECT var1, var2, rank() OVER (PARTITION BY var1, var2 ORDER BY x) + (count(*) OVER (PARTITION BY var1, var2, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY var1, var2 ORDER BY y) + (count(*) OVER (PARTITION BY var1, var2, y) - 1) / 2 AS ry FROM p)
SELECT var1, var2, count(*) AS n, round(corr(rx, ry), 6) AS r FROM r GROUP BY 1, 2""")(on(orders_daily, lambda s: correlation.correlation_matrix(s, "spearman").select("var1", "var2", "n", "r")))
query("correlation_tests")(on(orders_daily, correlation.correlation_matrix))
query("kendall_tau", f"""WITH {FLAGS}, p AS (SELECT a.series_id AS var1, b.series_id AS var2, a.idx, a.value AS x, b.value AS y FROM f a JOIN f b ON a.idx = b.idx AND a.series_id < b.series_id)
SELECT a.var1, a.var2, round(sum(sign(b.x - a.x) * sign(b.y - a.y)) / count(*), 6) AS tau FROM p a JOIN p b ON a.var1 = b.var1 AND a.var2 = b.var2 AND a.idx < b.idx GROUP BY 1, 2""")(on(flags_daily, correlation.kendall_tau))
query("strong_pairs")(on(orders_daily, lambda s: correlation.strong_pairs(correlation.correlation_matrix(s), 0.0)))
_ROLL = "OVER (ORDER BY idx ROWS 29 PRECEDING)"
query("rolling_correlation", f"""WITH {_XY}, r AS (SELECT idx, x, y, count(*) {_ROLL} AS k, covar_pop(x, y) {_ROLL} / nullif(stddev_pop(x) {_ROLL} * stddev_pop(y) {_ROLL}, 0) AS r FROM xy) SELECT idx, round(r, 6) AS r FROM r WHERE k = 30 AND r IS NOT NULL""")(
    on(_xy, lambda p: correlation.rolling_correlation(p.withColumn("key", F.lit("pair")), 30).select("idx", "r")))
query("rolling_spearman")(on(_xy, lambda p: correlation.rolling_correlation(p.withColumn("key", F.lit("pair")), 20, "spearman").select("idx", "r")))
query("rolling_kendall")(on(_xy, lambda p: correlation.rolling_correlation(p.withColumn("key", F.lit("pair")), 20, "kendall").select("idx", "r")))
query("rolling_summary")(on(_xy, lambda p: correlation.rolling_summary(correlation.rolling_correlation(p.withColumn("key", F.lit("pair")), 30))))
query("correlation_changes")(on(_xy, lambda p: correlation.correlation_changes(correlation.rolling_correlation(p.withColumn("key", F.lit("pair")), 30), 0.05).select("idx", "r", "change")))
query("granger")(on(orders_daily, lambda s: multivariate.granger(s, 3)))
query("var_forecast")(on(orders_daily, lambda s: multivariate.var_forecast(s, 2, 5)))
query("impulse_responses")(on(orders_daily, lambda s: multivariate.impulse_responses(s, 2, 5)))
query("engle_granger")(on(orders_daily, multivariate.engle_granger))
query("johansen")(on(orders_daily, multivariate.johansen))
query("vecm", None, 3)(on(orders_daily, lambda s: systems.vecm(s, 1, 1)))
query("var_diagnostics", None, 4)(on(orders_daily, lambda s: systems.var_diagnostics(s, 1, 5)))
query("common_trends", None, 2)(on(orders_daily, lambda s: systems.common_trends(s, 1, 1)))
query("factor_analysis", None, 3)(on(orders_daily, lambda s: systems.factor_analysis(s, 1)))
query("factor_scores", None, 3)(on(orders_daily, lambda s: systems.factor_scores(s, systems.factor_analysis(s, 1))))
query("covariance", f"WITH {ORDERS} SELECT a.series_id AS var1, b.series_id AS var2, round(covar_samp(a.value, b.value) / (stddev_samp(a.value) * stddev_samp(b.value)), 6) AS c FROM o a JOIN o b ON a.idx = b.idx AND a.series_id <= b.series_id GROUP BY 1, 2")(on(orders_daily, multivariate.covariance))
query("principal_components")(on(orders_daily, multivariate.principal_components))
query("component_scores")(on(orders_daily, lambda s: multivariate.component_scores(s, multivariate.principal_components(s))))
for _measure in multivariate.DISTANCES:
    query(f"distance_{_measure}")(on(flags_daily, lambda s, m=_measure: multivariate.pairwise_distances(s, m)))
_FIRST = f"{FLAGS}, g AS (SELECT a.series_id AS var1, b.series_id AS var2, a.value AS x, b.value AS y FROM f a JOIN f b ON a.idx = b.idx AND a.series_id < b.series_id)"
SQL["distance_euclidean"] = f"WITH {_FIRST} SELECT var1, var2, round(sqrt(sum((x - y) ** 2)), 6) AS distance FROM g GROUP BY 1, 2"
SQL["distance_manhattan"] = f"WITH {_FIRST} SELECT var1, var2, round(sum(abs(x - y)), 6) AS distance FROM g GROUP BY 1, 2"
SQL["distance_cosine"] = f"WITH {_FIRST} SELECT var1, var2, round(1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS distance FROM g GROUP BY 1, 2"
query("nearest_by_warping", None, 4)(lambda spark, sf_dir: warping.nearest(series.indexed(read(spark, sf_dir, "events"), "user_id", "ts", "value"), 3, 3))
query("warping_ranking", None, 4)(on(flags_daily, lambda s: warping.ranking(s, "A", 100)))
query("nearest_series")(on(flags_daily, lambda s: multivariate.nearest_series(multivariate.pairwise_distances(s, "euclidean"), 2)))
query("vector_distances", """WITH q AS (SELECT embedding AS a FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, a), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))), 6) AS euclidean, round(list_sum(list_transform(list_zip(embedding, a), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS manhattan FROM embeddings, q""")(
    lambda spark, d: (lambda v: v.join(F.broadcast(v.where("vec_id = 0").select(F.col("e").alias("a")))).select("vec_id", expr.euclidean(F.col("e"), F.col("a")).alias("euclidean"), expr.manhattan(F.col("e"), F.col("a")).alias("manhattan")))(read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))))

# --- seasonality and calendar -------------------------------------------------------------

query("fourier", f"""WITH {ORDERS}, t AS (SELECT series_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM o GROUP BY 1), f AS (SELECT series_id, n, v, unnest(range(1, n // 2 + 1)) AS k FROM t),
s AS (SELECT f.series_id, f.k, any_value(n) AS n, any_value(v) AS v, sum((value - m) * cos(2 * pi() * ((k * idx) % f.n) / f.n)) AS a, sum((value - m) * sin(2 * pi() * ((k * idx) % f.n) / f.n)) AS b FROM f JOIN o USING (series_id) JOIN (SELECT series_id, m FROM t) USING (series_id) GROUP BY 1, 2)
SELECT series_id, k, round(n / k, 6) AS period, round((a * a + b * b) / n / (n * v) * 2, 6) AS share, (a * a + b * b) / n > 2 * avg((a * a + b * b) / n) OVER (PARTITION BY series_id) AS is_dominant FROM s""")(on(orders_daily, lambda s: seasonality.fourier(s).select("series_id", "k", "period", "share", "is_dominant")))
query("periodogram")(on(orders_daily, lambda s: seasonality.periodogram(s, 2, 30)))
query("acf_periods")(on(orders_daily, lambda s: seasonality.acf_periods(s, 2, 60)))
query("auto_period")(on(orders_daily, seasonality.auto_period))
query("seasonal_profile", f"WITH {ORDERS}, g AS (SELECT series_id, avg(value) AS gm FROM o GROUP BY 1) SELECT series_id, (idx % 7)::INT AS phase, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n, round(avg(value - gm), 6) AS effect FROM o JOIN g USING (series_id) GROUP BY 1, 2")(on(orders_daily, lambda s: seasonality.seasonal_profile(s, 7)))
query("seasonal_strength", f"""WITH {ORDERS}, g AS (SELECT series_id, avg(value) AS gm FROM o GROUP BY 1), x AS (SELECT series_id, idx % 7 AS p, value - gm AS x FROM o JOIN g USING (series_id)), b AS (SELECT series_id, p, count(*) * avg(x) ** 2 AS b FROM x GROUP BY 1, 2), t AS (SELECT series_id, sum(x ** 2) AS t FROM x GROUP BY 1)
SELECT series_id, round(sum(b) / any_value(t), 6) AS strength FROM b JOIN t USING (series_id) GROUP BY 1""")(on(orders_daily, lambda s: seasonality.seasonal_strength(s, 7)))
query("pattern_consistency")(on(orders_daily, lambda s: seasonality.pattern_consistency(s, 7)))
query("adjust_additive", None, 3)(on(orders_daily, lambda s: seasonality.adjust(s, 7)))
query("adjust_multiplicative", None, 3)(on(orders_daily, lambda s: seasonality.adjust(s, 7, True)))
query("adjust_x13", None, 4)(on(orders_daily, lambda s: seasonality.adjust_x13(s, 12)))
_NUMBERED = ", p AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM o)"
_SUMMED = "count(*) AS k, sum(value) AS s, sum(value * value) AS q, sum(value * cos(2 * pi() * (idx % 7) / 7)) AS c1, sum(value * sin(2 * pi() * (idx % 7) / 7)) AS s1, sum(value * cos(4 * pi() * (idx % 7) / 7)) AS c2, sum(value * sin(4 * pi() * (idx % 7) / 7)) AS s2"
query("seasonal_breaks", f"""WITH {ORDERS}{_NUMBERED}, w AS (SELECT series_id, idx // 28 AS w, {_SUMMED} FROM p WHERE (idx // 28 + 1) * 28 <= n GROUP BY 1, 2),
r AS (SELECT a.series_id, b.w, (a.q - a.s ** 2 / a.k - 2 * (a.c1 ** 2 + a.s1 ** 2 + a.c2 ** 2 + a.s2 ** 2) / a.k) + (b.q - b.s ** 2 / b.k - 2 * (b.c1 ** 2 + b.s1 ** 2 + b.c2 ** 2 + b.s2 ** 2) / b.k) AS apart, a.q + b.q - a.s ** 2 / a.k - b.s ** 2 / b.k - 2 * ((a.c1 + b.c1) ** 2 + (a.s1 + b.s1) ** 2 + (a.c2 + b.c2) ** 2 + (a.s2 + b.s2) ** 2) / (a.k + b.k) AS together,
2 * sqrt(a.c1 ** 2 + a.s1 ** 2) / a.k AS x, 2 * sqrt(b.c1 ** 2 + b.s1 ** 2) / b.k AS y, b.s / b.k - a.s / a.k AS l FROM w a JOIN w b ON a.series_id = b.series_id AND b.w = a.w + 1)
SELECT series_id, w::BIGINT AS w, round((together - apart) / 4 / (apart / 46), 4) AS f, round(x, 2) AS amplitude_before, round(y, 2) AS amplitude_after, round(l, 2) AS level_shift FROM r""")(
    on(orders_daily, lambda s: breaks.seasonal_breaks(s, 7).select("series_id", "w", F.round("f", 4).alias("f"), *[F.round(c, 2).alias(c) for c in ("amplitude_before", "amplitude_after", "level_shift")])))
query("seasonal_break_kinds", None, 4)(on(orders_daily, lambda s: breaks.seasonal_breaks(s, 7).where("is_break")))
query("seasonal_outliers", f"""WITH {ORDERS}, e AS (SELECT *, avg(value) OVER (PARTITION BY series_id, idx % 7) AS expected, 2 * stddev_pop(value) OVER (PARTITION BY series_id) AS lim FROM o)
SELECT series_id, idx, round(value, 6) AS value, round(expected, 6) AS expected, round(abs(value - expected), 6) AS deviation, CASE WHEN abs(value - expected) > 3 * lim THEN 'innovation' ELSE 'additive' END AS kind FROM e WHERE abs(value - expected) > lim""")(on(orders_daily, lambda s: breaks.outlier_points(s, 7)))
query("pattern_stability", f"""WITH {ORDERS}{_NUMBERED}, b AS (SELECT series_id, idx AS i, n, (n // 5) AS w FROM p), v AS (SELECT b.series_id, b.i, var_pop(p.value) AS v FROM b JOIN p ON p.series_id = b.series_id AND p.idx >= b.i AND p.idx < b.i + b.w WHERE b.i < b.n - b.w GROUP BY 1, 2)
SELECT series_id, count(*) AS windows, round(avg(v), 0) AS mean_variance, round(1 / (1 + var_pop(v) / greatest(avg(v), 0.001)), 12) AS stability FROM v GROUP BY 1""", 14)(on(orders_daily, lambda s: breaks.pattern_stability(s).select("series_id", "windows", F.round("mean_variance", 0).alias("mean_variance"), F.round("stability", 12).alias("stability"))))
query("pattern_evolution", f"""WITH {ORDERS}{_NUMBERED}, a AS (SELECT p.series_id, p.idx AS i, p.n, sum(x.value) / any_value(p.n // 10) AS mean FROM p JOIN p x ON x.series_id = p.series_id AND x.idx >= p.idx - p.n // 20 AND x.idx < p.idx + p.n // 20 WHERE p.idx >= p.n // 10 AND p.idx < p.n - p.n // 10 GROUP BY p.series_id, p.idx, p.n),
h AS (SELECT series_id, avg(value) FILTER (WHERE idx < n // 10) AS head, avg(abs(value)) AS size FROM p GROUP BY 1), c AS (SELECT a.*, size, abs(mean - coalesce(lag(mean) OVER (PARTITION BY a.series_id ORDER BY i), head)) AS ch FROM a JOIN h USING (series_id)),
s AS (SELECT series_id, n, count(*) FILTER (WHERE ch > .1 * size) AS changes, max(ch) AS largest FROM c GROUP BY 1, 2)
SELECT series_id, changes, round(changes / n, 6) AS change_rate, round(largest, 3) AS largest, CASE WHEN changes / n < .01 THEN 'stable' WHEN changes / n > .05 THEN 'irregular' ELSE 'shifting' END AS trend FROM s""")(on(orders_daily, lambda s: breaks.pattern_evolution(s).withColumn("largest", F.round("largest", 3))))
query("trend_interaction", f"""WITH {ORDERS}{_NUMBERED}, m AS (SELECT p.series_id, p.idx AS i, p.n, p.value, avg(x.value) AS trend FROM p JOIN p x ON x.series_id = p.series_id AND x.idx BETWEEN p.idx - p.n // 10 // 2 AND p.idx + p.n // 10 // 2 GROUP BY ALL),
e AS (SELECT *, 2 * pi() * (i % period) / period AS a FROM m, (VALUES (7), (30)) t(period)), v AS (SELECT series_id, period, covar_pop(trend, sin(a) + .5 * sin(2 * a)) / (stddev_pop(trend) * stddev_pop(sin(a) + .5 * sin(2 * a))) AS wave_r FROM e GROUP BY 1, 2),
c AS (SELECT series_id, period, i // period AS c, avg(trend) AS level, stddev_pop(value - trend) AS amp FROM e WHERE (i // period + 1) * period <= n GROUP BY 1, 2, 3), b AS (SELECT series_id, period, covar_pop(level, amp) / (stddev_pop(level) * stddev_pop(amp)) AS r, count(*) AS cycles FROM c GROUP BY 1, 2)
SELECT series_id, period, round(wave_r, 5) AS wave_r, round(r, 5) AS amplitude_r, cycles, CASE WHEN abs(r) < .1 THEN 'independent' WHEN r > 0 THEN 'amplifying' ELSE 'dampening' END AS kind FROM v JOIN b USING (series_id, period)""")(on(orders_daily, lambda s: rounded(breaks.trend_interaction(s, [7, 30]), 5)))
query("phase_cusum", f"""WITH RECURSIVE {ORDERS}, p AS (SELECT series_id, idx, idx % 7 AS phase, idx // 7 AS cycle, value FROM o), b AS (SELECT series_id, phase, avg(value) AS m, stddev_samp(value) AS sd FROM p WHERE cycle < 8 GROUP BY 1, 2 HAVING count(*) = 8),
z AS (SELECT series_id, phase, cycle, idx, (value - m) / sd AS z FROM p JOIN b USING (series_id, phase) WHERE sd > 0),
f(series_id, phase, cycle, idx, up, down, hit) AS (SELECT series_id, phase, 0::BIGINT, idx, greatest(0, z - .5), greatest(0, -z - .5), greatest(abs(z) - .5, 0) > 5 FROM z WHERE cycle = 0
UNION ALL SELECT z.series_id, z.phase, z.cycle, z.idx, greatest(0, CASE WHEN f.hit THEN 0 ELSE f.up END + z.z - .5), greatest(0, CASE WHEN f.hit THEN 0 ELSE f.down END - z.z - .5), greatest(CASE WHEN f.hit THEN 0 ELSE f.up END + z.z - .5, CASE WHEN f.hit THEN 0 ELSE f.down END - z.z - .5) > 5 FROM f JOIN z ON z.series_id = f.series_id AND z.phase = f.phase AND z.cycle = f.cycle + 1)
SELECT series_id, phase::INT AS phase, cycle, idx, round(CASE WHEN up >= down THEN up ELSE -down END, 6) AS sum FROM f WHERE hit""")(on(orders_daily, lambda s: breaks.phase_cusum(s, 7).withColumn("phase", F.col("phase").cast("int"))))
query("evolving_strength")(on(orders_daily, lambda s: seasonality.evolving_strength(s, 7, 112)))
query("calendar_features", """SELECT o_orderkey, (isodow(o_orderdate) - 1)::INT AS dow, month(o_orderdate)::INT AS month, quarter(o_orderdate)::INT AS quarter, year(o_orderdate)::INT AS year, dayofyear(o_orderdate)::INT AS day_of_year, week(o_orderdate)::INT AS iso_week, hour(o_orderdate)::INT AS hour, isodow(o_orderdate) > 5 AS is_weekend,
(month(o_orderdate) = 1 AND day(o_orderdate) = 1) OR (month(o_orderdate) = 12 AND day(o_orderdate) = 25) AS is_holiday, round(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) AS dow_sin, round(cos(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) AS dow_cos FROM orders""")(
    lambda spark, d: calendar.calendar_features(read(spark, d, "orders"), "o_orderdate").select("o_orderkey", "dow", "month", "quarter", "year", "day_of_year", "iso_week", "hour", "is_weekend", "is_holiday", "dow_sin", "dow_cos"))
_EFFECT = """WITH {src}, g AS (SELECT series_id, avg(value) AS gm FROM o GROUP BY 1) SELECT series_id, '{name}' AS effect_of, ({slot})::INT AS slot, count(*) AS n, round(avg(value), 6) AS mean, round(avg(value) - any_value(gm), 6) AS effect,
round((avg(value) - any_value(gm)) / nullif(stddev_samp(value) / sqrt(count(*)), 0), 6) AS t FROM o JOIN g USING (series_id) GROUP BY 1, 3"""
for _name, _op, _slot in (("day_of_week", calendar.day_of_week_effects, "isodow(ts) - 1"), ("month", calendar.month_effects, "month(ts)"), ("working_day", calendar.working_day_effect, "isodow(ts) < 6"), ("leap_year", calendar.leap_year_effect, "year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0)")):
    query(f"effect_{_name}", _EFFECT.format(src=ORDERS, name=_name, slot=_slot))(on(orders_daily, _op))
query("effect_trading_days", None, 4)(on(orders_daily, calendar.trading_day_effect))
query("effect_easter")(on(orders_daily, calendar.easter_effect))
query("calendar_strength")(on(orders_daily, calendar.calendar_strength))
query("effect_holidays", None, 5)(lambda spark, d: calendar.holiday_effects(orders_daily(spark, d), spark.sql("SELECT 'christmas' AS name, make_date(y, 12, 25) AS day FROM (SELECT explode(sequence(1992, 2000)) AS y)")))

# --- stationarity and change points -------------------------------------------------------

query("adf")(on(orders_daily, stationarity.adf))
query("kpss")(on(orders_daily, stationarity.kpss))
query("kpss_trend")(on(orders_daily, lambda s: stationarity.kpss(s, True)))
query("phillips_perron")(on(orders_daily, stationarity.phillips_perron))
query("cusum", f"""WITH {EVENTS}, t AS (SELECT series_id, avg(value) AS m, stddev_pop(value) AS s FROM e GROUP BY 1), p AS (SELECT series_id, idx, ts, value, s, sum(value - m - .5 * s) OVER w AS pu, sum(m - value - .5 * s) OVER w AS pd FROM e JOIN t USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, pu - least(0, min(pu) OVER w) AS up, pd - least(0, min(pd) OVER w) AS down FROM p WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING))
SELECT series_id, idx, ts, round(value, 6) AS value, round(up, 4) AS up, round(down, 4) AS down, greatest(up, down) > 4 * s AS alarm FROM c""")(on(events, lambda s: stationarity.cusum(s).withColumns({"up": F.round("up", 4), "down": F.round("down", 4)})))
query("cusum_by_blocks", SQL["cusum"])(on(events, lambda s: scan.cusum(scan.dealt(s)).withColumns({"up": F.round("up", 4), "down": F.round("down", 4)})))
query("cusum_changepoints")(on(events, stationarity.cusum_changepoints))
query("pelt")(on(orders_daily, stationarity.pelt))
query("binary_segmentation")(on(events, lambda s: stationarity.binary_segmentation(s, critical=2.5)))
query("variance_changes")(on(events, stationarity.variance_changes))
query("complexity")(on(flags_daily, detectors_np.complexity))

# --- forecasting --------------------------------------------------------------------------

_DAILY = ", n AS (SELECT series_id, max(idx) + 1 AS n, max(ts) AS last_ts FROM o GROUP BY 1), st AS (SELECT unnest(range(1, 11))::INT AS step), gap AS (SELECT series_id, arg_max(g, idx) AS g FROM (SELECT series_id, idx, ts - lag(ts) OVER (PARTITION BY series_id ORDER BY idx) AS g FROM o) GROUP BY 1)"


def _plain(method: str, **options) -> Query:
    return on(orders_daily, lambda s: forecasting.forecast(s, method, 10, **options).select("series_id", "step", "forecast"))


query("forecast_moving_average", f"WITH {ORDERS}{_DAILY} SELECT series_id, step, round(f, 6) AS forecast FROM (SELECT series_id, avg(value) AS f FROM o JOIN n USING (series_id) WHERE idx >= n - 5 GROUP BY 1), st")(_plain("moving_average"))
query("forecast_weighted", f"WITH {ORDERS}{_DAILY} SELECT series_id, step, round(f, 6) AS forecast FROM (SELECT series_id, sum(value * (idx - n + 4)) / 6 AS f FROM o JOIN n USING (series_id) WHERE idx >= n - 3 GROUP BY 1), st")(_plain("weighted_moving_average"))
query("forecast_linear", f"WITH {ORDERS}{_DAILY} SELECT series_id, step, round(a + b * (n - 1 + step), 4) AS forecast FROM (SELECT series_id, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a, count(*) AS n FROM o GROUP BY 1), st", 4)(_plain("linear"))
query("forecast_seasonal_naive", f"WITH {ORDERS}{_DAILY} SELECT n.series_id, step, round(value, 6) AS forecast FROM n CROSS JOIN st JOIN o ON o.series_id = n.series_id AND idx = n - 7 + (step - 1) % 7")(_plain("seasonal_naive"))
query("forecast_prophet", f"""WITH {ORDERS}{_DAILY}, b AS (SELECT series_id, arg_min(value, idx) AS f, arg_max(value, idx) AS l, count(*) AS n FROM o GROUP BY 1) SELECT series_id, step, round(l + step * (l - f) / (n - 1) + .05 * sin(2 * pi() * ((n + step - 1) % 7) / 7), 6) AS forecast FROM b, st""")(_plain("prophet_like"))
for _m in ("ses", "holt_winters", "ets", "theta", "arima", "sarima", "auto_arima"):
    query(f"forecast_{_m}", None, 4)(_plain(_m))
_SARIMA = arima.Order(1, 0, 1, 0, 1, 1, 7)
query("arima_criteria", None, 3)(on(orders_daily, lambda s: arima.criteria(arima.models(s, arima.Order(2, 0, 1), 1))))
query("arima_coefficients", None, 3)(on(orders_daily, lambda s: arima.coefficients(arima.models(s, _SARIMA, 1))))
query("arima_intervals", None, 1)(on(orders_daily, lambda s: arima.steps(arima.models(s, _SARIMA, 14))))
query("arima_residuals", None, 1)(on(orders_daily, lambda s: arima.residuals(arima.models(s, arima.Order(1, 1, 1), 1, with_residuals=True))))
query("forecast_dates")(on(orders_daily, lambda s: forecasting.forecast(s, "moving_average", 3).withColumn("ts", F.col("ts").cast("timestamp_ntz"))))
query("forecast_intervals", None, 4)(on(orders_daily, lambda s: forecasting.with_intervals(forecasting.forecast(s, "linear", 10)).drop("ts")))
_MEMBERS = {"moving_average": {}, "linear": {}, "seasonal_naive": {"period": 7}}
for _how in ("average", "median", "best", "optimal"):
    query(f"ensemble_{_how}", None, 4)(on(orders_daily, lambda s, h=_how: forecasting.ensemble(s, _MEMBERS, 10, h).drop("ts")))
query("ensemble_weighted", None, 4)(on(orders_daily, lambda s: forecasting.ensemble(s, _MEMBERS, 10, "weighted", {"moving_average": 0.5, "linear": 0.3, "seasonal_naive": 0.2}).drop("ts")))
query("forecast_metrics", None, 4)(on(orders_daily, lambda s: forecasting.metrics(forecasting.holdout(s, "seasonal_naive", 14, period=7), s)))
query("walk_forward", None, 4)(on(orders_daily, lambda s: forecasting.metrics(forecasting.walk_forward(s, "moving_average", 7, 3), None, ("series_id", "fold"))))
query("residual_statistics", None, 4)(on(orders_daily, lambda s: forecasting.residual_statistics(forecasting.holdout(s, "linear", 60), 5)))
query("forecast_features", None, 3)(on(orders_daily, lambda s: forecasting.lag_features(s, [1, 2], [7], 7).drop("ts")))

# --- quality ------------------------------------------------------------------------------

query("quality_profile")(on(events, quality.profile))
query("quality_scores")(on(events, quality.scores))
query("quality_recommendations")(on(events, lambda s: quality.recommendations(quality.scores(s))))
_SCORES = f"""{HOLED}, q AS (SELECT series_id, date_trunc('day', ts) AS ts, 100 * avg((value IS NOT NULL)::INT) AS score FROM h GROUP BY 1, 2)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of values that are there, by day."""
    h = holed(spark, sf_dir)
    return h.groupBy("series_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg((100 * F.avg(F.col("value").isNotNull().cast("int"))).alias("score"))


def _plain_time(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


query("sudden_drops", f"WITH {_SCORES}, l AS (SELECT *, lag(score) OVER w AS before, epoch(ts) - epoch(lag(ts) OVER w) AS gap FROM q WINDOW w AS (PARTITION BY series_id ORDER BY ts)) SELECT series_id, ts, round(before, 6) AS before, round(score, 6) AS score, round(before - score, 6) AS drop FROM l WHERE before - score > 5 AND gap <= 604800")(
    on(_scores, lambda h: _plain_time(degradation.sudden_drops(h, 5.0))))
query("gradual_decline", f"""WITH {_SCORES}, s AS (SELECT *, regr_slope(score, epoch(ts) / 86400 - 19000) OVER w AS slope, count(*) OVER w AS points FROM q WINDOW w AS (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND CURRENT ROW))
SELECT series_id, ts, round(score, 6) AS score, round(slope, 4) AS slope, points, slope < -1 AS is_declining FROM s WHERE points >= 3 AND slope IS NOT NULL""")(on(_scores, lambda h: _plain_time(degradation.gradual_decline(h, 14 * 86_400)).withColumn("slope", F.round("slope", 4))))
query("bad_runs", f"""WITH {_SCORES}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS n, count(*) OVER (PARTITION BY series_id) AS k FROM q), b AS (SELECT *, n - row_number() OVER (PARTITION BY series_id ORDER BY ts) AS run FROM n WHERE score < 90)
SELECT series_id, min(ts) AS begin, max(ts) AS "end", count(*) AS length, round(min(score), 6) AS worst, round(avg(score), 6) AS mean, max(n) = max(k) AS is_open FROM b GROUP BY series_id, run HAVING count(*) >= 2""")(
    on(_scores, lambda h: degradation.bad_runs(h, 90.0).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("begin", "end")})))
query("quality_baseline", None, 4)(on(_scores, lambda h: _plain_time(degradation.against_baseline(h))))
query("clean_linear")(on(holed, lambda s: quality.clean(s).select("series_id", "idx", "value", "changed")))
SQL["clean_linear"] = f"WITH {HOLED}" + _LINEAR.format(at="idx").replace("SELECT series_id, idx, round(coalesce(value, v0 + (v1 - v0) * (idx - t0) / nullif(t1 - t0, 0)), 6) AS filled FROM b", "SELECT series_id, idx, round(coalesce(value, v0 + (v1 - v0) * (idx - t0) / nullif(t1 - t0, 0)), 6) AS value, value IS NULL AND v0 IS NOT NULL AND v1 IS NOT NULL AS changed FROM b")
query("quality_history")(on(events, lambda s: quality.windowed_scores(s, "1 day")))
query("quality_monitor")(on(events, lambda s: quality.monitor(quality.windowed_scores(s, "1 day"))))
query("quality_trend")(on(events, lambda s: quality.quality_trend(quality.windowed_scores(s, "1 day"))))

# --- streams replayed from tables ---------------------------------------------------------

for _m in ("zscore", "modified_zscore", "iqr", "volatility"):
    query(f"stream_{_m}")(on(events, lambda s, m=_m: detector.replay(s, method=m, threshold={"iqr": 0.5, "volatility": 1.5}.get(m, 2.5), size=50).withColumn("ts", F.col("ts").cast("timestamp_ntz"))))
query("stream_adaptive")(on(events, lambda s: detector.replay(s, method="zscore", threshold=2.5, size=50, adaptive=True)))
for _m in drift.DETECTORS:
    query(f"drift_{_m}")(on(events, lambda s, m=_m: drift.detect_drift(drift.misses(s) if m in ("ddm", "eddm") else s, m)))
query("adwin_state", f"WITH {EVENTS} SELECT series_id, count(*) AS width, round(avg(value), 6) AS mean, 0::BIGINT AS drifts FROM e GROUP BY 1")(on(events, drift.window_state))
query("online_forecast", None, 4)(on(events, lambda s: online.forecast_table(s).withColumn("ts", F.col("ts").cast("timestamp_ntz"))))


# --- models, sources, composites ----------------------------------------------------------

query("persistence", f"WITH {ORDERS}, l AS (SELECT series_id, arg_max(value, idx) AS forecast FROM o GROUP BY 1) SELECT series_id, unnest(range(1, 6))::INT AS step, round(forecast, 6) AS forecast FROM l")(on(orders_daily, lambda s: ml.persistence(s, 5)))
query("sequences", f"""WITH {ORDERS}, w AS (SELECT series_id, idx, list(value) OVER (PARTITION BY series_id ORDER BY idx ROWS 3 PRECEDING) AS x, list(value) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS y FROM o)
SELECT series_id, idx, round(list_sum(x), 2) AS total, round(y[1], 2) AS target FROM w WHERE len(x) = 4 AND len(y) = 1""")(on(orders_daily, lambda s: ml.sequences(s, 4).select("series_id", "idx", F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 2).alias("total"), F.round(F.col("y")[0], 2).alias("target"))))
_FRONTS = """l1 AS (SELECT p_partkey, p_size AS x, p_retailprice AS y FROM part), f1 AS (SELECT * FROM l1 a WHERE NOT EXISTS (SELECT 1 FROM l1 b WHERE b.x >= a.x AND b.y >= a.y AND (b.x > a.x OR b.y > a.y))),
l2 AS (SELECT * FROM l1 ANTI JOIN f1 USING (p_partkey)), f2 AS (SELECT * FROM l2 a WHERE NOT EXISTS (SELECT 1 FROM l2 b WHERE b.x >= a.x AND b.y >= a.y AND (b.x > a.x OR b.y > a.y))),
l3 AS (SELECT * FROM l2 ANTI JOIN f2 USING (p_partkey)), f3 AS (SELECT * FROM l3 a WHERE NOT EXISTS (SELECT 1 FROM l3 b WHERE b.x >= a.x AND b.y >= a.y AND (b.x > a.x OR b.y > a.y))),
f AS (SELECT *, 1 AS front FROM f1 UNION ALL SELECT *, 2 FROM f2 UNION ALL SELECT *, 3 FROM f3)"""


def _fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skyline.fronts(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 3)


query("pareto_fronts", f"WITH {_FRONTS} SELECT p_partkey, front FROM f")(lambda spark, d: _fronts(spark, d).select("p_partkey", "front"))
query("crowding", f"""WITH {_FRONTS}, g AS (SELECT *, count(*) OVER (PARTITION BY front) AS n, lag(x) OVER wx AS x0, lead(x) OVER wx AS x1, lag(y) OVER wy AS y0, lead(y) OVER wy AS y1, max(x) OVER (PARTITION BY front) - min(x) OVER (PARTITION BY front) AS rx, max(y) OVER (PARTITION BY front) - min(y) OVER (PARTITION BY front) AS ry FROM f WINDOW wx AS (PARTITION BY front ORDER BY x, p_partkey), wy AS (PARTITION BY front ORDER BY y, p_partkey))
SELECT p_partkey, front, CASE WHEN n > 2 AND x0 IS NOT NULL AND x1 IS NOT NULL AND y0 IS NOT NULL AND y1 IS NOT NULL THEN round(coalesce((x1 - x0) / nullif(rx, 0), 0) + coalesce((y1 - y0) / nullif(ry, 0), 0), 6) END AS crowding FROM g""")(
    lambda spark, d: skyline.crowding(_fronts(spark, d), "p_partkey", ["p_size", "p_retailprice"]).select("p_partkey", "front", F.when(F.col("crowding") < float("inf"), F.col("crowding")).alias("crowding")))
query("hypervolume", f"""WITH {_FRONTS}, d AS (SELECT DISTINCT front, x, y FROM f), s AS (SELECT *, x * (y - coalesce(lag(y) OVER (PARTITION BY front ORDER BY x DESC), 0)) AS a FROM d) SELECT front, count(*) AS points, round(sum(a), 3) AS hypervolume FROM s GROUP BY 1""", 3)(
    lambda spark, d: skyline.hypervolume(_fronts(spark, d), ["p_size", "p_retailprice"], (0.0, 0.0)))
query("pareto_front", """SELECT p_partkey, p_size, round(p_retailprice, 6) AS p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice))""")(
    lambda spark, d: ml.pareto_front(read(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"]))
query("compact", f"""WITH {EVENTS}, t AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM e GROUP BY 1) SELECT series_id, idx, round(abs(value - (lo + round(65535 * (value - lo) / (hi - lo)) / 65535 * (hi - lo))), 6) <= round((hi - lo) / 65535, 6) AS near FROM e JOIN t USING (series_id)""")(
    on(events, lambda s: ml.restore(ml.compact(s)).withColumnRenamed("value", "restored").join(s.select("series_id", "idx", "value"), ["series_id", "idx"]).select("series_id", "idx", (F.round(F.abs(F.col("value") - F.col("restored")), 6) <= F.round((F.col("hi") - F.col("lo")) / 65535, 6)).alias("near"))))
query("positional_encoding", "SELECT vec_id, round(sin(vec_id), 6) AS e0, round(cos(vec_id), 6) AS e1, round(sin(vec_id / 100), 6) AS e2, round(cos(vec_id / 100), 6) AS e3 FROM embeddings")(
    lambda spark, d: ml.positional_encoding(read(spark, d, "embeddings").select("vec_id"), "vec_id", 4).select("vec_id", *[F.col("encoding")[i].alias(f"e{i}") for i in range(4)]))
query("ensemble_diversity")(on(orders_daily, lambda s: ml.ensemble_diversity(forecasting.forecast(s, "linear").unionByName(forecasting.forecast(s, "seasonal_naive", 10, period=7)).select(F.concat_ws("/", "series_id", "step").alias("row"), F.col("method").alias("model"), F.col("forecast").alias("prediction")))))
query("parse_times", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS ts FROM events")(lambda spark, d: read(spark, d, "events").select("event_id", readers.parse_time(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("ts")))
query("parse_values", "SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END, 6) AS value FROM events")(lambda spark, d: read(spark, d, "events").select("event_id", readers.parse_value(F.when(F.col("event_id") % 3 == 0, " NaN ").otherwise(F.col("value").cast("string"))).alias("value")))
query("read_parquet", "SELECT 'o_totalprice' AS series_id, o_orderdate::TIMESTAMP AS ts, round(o_totalprice, 6) AS value FROM orders")(lambda spark, d: readers.read_parquet(spark, f"{d}/orders.parquet", time="o_orderdate", values=["o_totalprice"]).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
query("synthetic_sine", "SELECT 'sine' AS series_id, make_timestamp((1000000000 + i * 3600) * 1000000) AS ts, round(sin(2 * pi() * i / 24), 6) + 0 AS value FROM range(1000) t(i)")(lambda spark, d: synthetic.sine(spark).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
query("event_filters", "SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE event_type IN ('click', 'view') AND value >= 10 AND event_type NOT LIKE '%x%'")(
    lambda spark, d: series.value_counts_filter(series.value_counts_filter(read(spark, d, "events").select("event_id", "event_type", "value"), "event_type", "in", ["click", "view"]), "value", "ge", 10))
query("stationarity_kpss")(on(orders_daily, lambda s: compose.stationarity_test(s, "kpss")))
query("stationarity_all", None, 4)(on(orders_daily, lambda s: compose.stationarity_test(s, "all")))
query("trend_test", None, 4)(on(flags_daily, lambda s: compose.trend_test(s, "all")))
query("correlation_analysis", None, 4)(on(flags_daily, compose.correlation_analysis))
query("insights")(on(orders_daily, compose.insights))
query("combined_periods")(on(orders_daily, compose.combined_periods))


@query("flagship", f"""WITH {EVENTS}, {_Z.format(t=3.0)}, s AS (SELECT series_id, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, .5) AS median, skewness(value) AS skewness FROM e GROUP BY 1), a AS (SELECT series_id, count(*) AS n_anomalies, max(score) AS worst FROM z GROUP BY 1)
SELECT series_id, n, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, round(skewness, 6) AS skewness, coalesce(n_anomalies, 0) AS n_anomalies, round(worst, 6) AS worst FROM s LEFT JOIN a USING (series_id)""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptive statistics of each event series with its z-score anomalies."""
    s = events(spark, sf_dir)
    found = anomaly.zscore(s).groupBy("series_id").agg(F.count("*").alias("n_anomalies"), F.max("score").alias("worst"))
    stats = descriptive.describe(s).select("series_id", "n", "mean", "std", F.col("p50").alias("median"), "skewness")
    return stats.join(found, "series_id", "left").withColumn("n_anomalies", F.coalesce("n_anomalies", F.lit(0)))
