"""The adaptive window, the Kolmogorov-Smirnov window and the online forecaster, on tables and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.streaming import detector, drift, online
from tidegauge.streaming.online import AdaptiveWindow, KsWindow, OnlineForecaster


def alarms(d, x):
    return [i for i, v in enumerate(x.tolist()) if d.push(v)]


@pytest.mark.parametrize("make", [AdaptiveWindow, KsWindow])
def test_a_drift_is_found_where_it_is_and_nothing_else(make):
    for seed in range(5):
        rng = np.random.default_rng(seed)
        x = np.concatenate([rng.normal(0, 1, 4000), rng.normal(1.5, 1, 4000)]) * 50
        found = alarms(make(), x)
        assert 4000 <= found[0] <= 4160  # 2 % of the points
        assert len([i for i in found if i > 4400]) <= 0.01 * 8000
        assert len(alarms(make(), rng.uniform(0, 1, 8000))) <= 80
        assert not alarms(make(), np.full(2000, 7.0))


def test_window_keeps_the_sums_of_what_it_holds():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 700), rng.normal(9, 2, 900)])
    w = AdaptiveWindow()
    for i, v in enumerate(x.tolist()):
        w.push(v)
        n = int(sum(b[0] for b in w.buckets))
        held = x[i + 1 - n : i + 1]
        assert abs(w.mean() - held.mean()) < 1e-9 and len(w.buckets) <= 6 * 12
        sizes = [b[0] for b in w.buckets]
        assert sizes == sorted(sizes, reverse=True) and max(sizes.count(s) for s in set(sizes)) <= 5
    at = 0
    for size, total, squares, low, high in w.buckets:
        part = held[at : at + int(size)]
        assert abs(total - part.sum()) < 1e-6 and abs(squares - ((part - part.mean()) ** 2).sum()) < 1e-6 and (low, high) == (part.min(), part.max())
        at += int(size)
    assert n <= 930  # nearly all that came before the drift is gone


def test_kswin_statistic():
    x = np.random.default_rng(4).normal(size=100)
    x[70:] += 0.8
    d = KsWindow(alpha=1e-9)
    assert not any(d.push(v) for v in x.tolist())
    cdf = lambda s, at: (s[None, :] <= at[:, None]).mean(1)
    far = np.abs(cdf(x[:70], x) - cdf(x[70:], x)).max()
    assert [KsWindowAt(far, a) for a in (far - 1e-9, far + 1e-9)] == [True, False]


def KsWindowAt(far, limit):  # noqa: N802
    d = KsWindow()
    d.limit = limit
    x = np.random.default_rng(4).normal(size=100)
    x[70:] += 0.8
    return [d.push(v) for v in x.tolist()][-1]


def test_forecaster_learns_and_learns_again():
    rng = np.random.default_rng(1)
    x = np.zeros(6000)
    for t in range(1, 6000):
        x[t] = (0.8 if t < 3000 else -0.6) * x[t - 1] + rng.normal() * (1 if t < 3000 else 4)
    f = OnlineForecaster()
    first = [f.push(v) for v in x[:3000].tolist()]
    assert np.abs(f.weights - [0, 0, 0, 0.8]).max() < 0.1 and not any(r[2] for r in first if r)
    assert first[:3] == [None] * 3 and abs(np.mean([abs(r[1]) for r in first[500:]]) - np.sqrt(2 / np.pi)) < 0.05
    then = [f.push(v) for v in x[3000:].tolist()]
    found = [i for i, r in enumerate(then) if r[2]]
    assert found and found[0] <= 120 and then[found[0] + 1][3] in ("adapting", "drift") and then[-1][3] == "stable"
    assert np.abs(f.weights - [0, 0, 0, -0.6]).max() < 0.15 and abs(then[-1][5] - 4) < 1.5


def test_recursion_is_least_squares():
    """Without forgetting the weights are those of a (barely) ridged regression on all points."""
    x = np.random.default_rng(2).normal(size=300)
    f = OnlineForecaster(lags=2, forget=1.0, delta=1e-12)
    for v in x.tolist():
        f.push(v)
    design = np.column_stack([np.ones(298), x[:-2], x[1:-1]])
    assert np.abs(f.weights - np.linalg.solve(design.T @ design + np.eye(3) / 1e4, design.T @ x[2:])).max() < 1e-8


def events(spark, n=900):
    rng = np.random.default_rng(7)
    rows = []
    for k in ("a", "b"):
        x = np.cumsum(rng.normal(size=n)) * (1 if k == "a" else 0.1)
        x[n // 2 :] += rng.normal(size=n - n // 2) * 20
        rows += [(k, i * 60, None if i in (5, 77) else float("inf") if i == 300 else float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, t long, value double").select("series_id", F.timestamp_seconds("t").alias("ts"), "value")


def collected(rows):
    return sorted((r.series_id, r.ts, round(r.forecast, 6), r.drift, r.phase, round(r.rmse, 6)) for r in rows)


def test_stream_equals_table_across_restarts(spark, tmp_path):
    s = events(spark)
    want = collected(online.forecast_table(s).collect())
    assert any(r[3] for r in want)
    files = s.where("ts < timestamp_seconds(15000)"), s.where("ts >= timestamp_seconds(15000) and ts < timestamp_seconds(36000)"), s.where("ts >= timestamp_seconds(36000)")
    for part in files:  # the query ends and is started again for each
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
        q = online.forecast_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    got = collected(spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want


def test_idle_series_are_forgotten(spark, tmp_path):
    s = events(spark, 60).where("series_id = 'a' or ts < timestamp_seconds(600)")
    late = spark.createDataFrame([("a", 90_000, 1.0), ("a", 200_000, 1.0)], "series_id string, t long, value double").select("series_id", F.timestamp_seconds("t").alias("ts"), "value")
    again = spark.createDataFrame([("b", 200_100 + i, float(i)) for i in range(4)], "series_id string, t long, value double").select("series_id", F.timestamp_seconds("t").alias("ts"), "value")
    q = None
    for part in (s, late, again):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if q is None:
            stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
            q = online.forecast_stream(stream, "1 minute", idle=3600).writeStream.format("memory").queryName("forgotten").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        q.processAllAvailable()
    q.stop()
    rows = spark.table("forgotten").where("series_id = 'b' and ts > timestamp_seconds(100000)").collect()
    assert len(rows) == 1 and abs(rows[0].forecast) < 1e-9  # three points to begin with, and weights of zero: it began anew


@pytest.mark.parametrize("options", [{"method": "zscore", "threshold": 2.0}, {"method": "modified_zscore", "threshold": 2.0}, {"method": "iqr", "threshold": 0.3}, {"method": "volatility", "threshold": 1.2, "short": 6}])
def test_frames_equal_the_point_by_point_detector(spark, options):
    s = events(spark, 300)
    s = s.where("value is null or value < double('infinity')")
    got = sorted((r.series_id, r.ts, round(r.score, 7), r.severity, round(r.expected, 7)) for r in detector.replay(s, size=40, **options).collect())
    want = []
    for k in ("a", "b"):
        pdf = s.where(F.col("series_id") == k).orderBy("ts").toPandas()
        want += [(k, r.ts.to_pydatetime(), round(r.score, 7), r.severity, round(r.expected, 7)) for r in detector.Detector(size=40, **options).run(k, pdf).itertuples()]
    assert got == sorted(want) and got


def test_misses_are_where_the_forecast_fails(spark):
    s = events(spark, 900).where("value < double('infinity')").withColumn("idx", F.unix_seconds("ts") / 60)
    rows = drift.misses(s.withColumn("idx", F.col("idx").cast("long"))).where("series_id = 'b'").collect()
    ones = [r.idx for r in rows if r.value == 1]
    assert len([i for i in ones if 450 <= i < 480]) >= 10 and len([i for i in ones if 100 < i < 450]) <= 5


def test_table_in_batches(spark):
    """A series that comes in many batches, and many series in one, give what each gives as a whole; no group of Spark's holds a series."""
    rng = np.random.default_rng(8)
    named = {"long": rng.normal(size=900).cumsum(), None: rng.normal(size=70), "short": rng.normal(size=3)} | {f"s{i}": rng.normal(size=12) + i for i in range(9)}
    rows = [(key, i, float(v)) for key, x in named.items() for i, v in enumerate(x)]
    s = spark.createDataFrame(rows, "series_id string, t long, value double").select("series_id", F.timestamp_seconds("t").alias("ts"), "value").repartition(7)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "50")
    try:
        found = online.forecast_table(s)
        got = found.collect()
    finally:
        spark.conf.set(name, before)
    for key, x in named.items():
        whole = online.OnlineForecaster().run(key, pd.DataFrame({"ts": range(len(x)), "value": x}))
        mine = sorted((r for r in got if r.series_id == key), key=lambda r: r.ts)
        assert [(r.forecast, r.error, r.drift, r.phase, r.mae) for r in mine] == list(whole[["forecast", "error", "drift", "phase", "mae"]].itertuples(index=False, name=None))
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
