import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators.series import with_index
from tidegauge.plans.oracles import SQL
from tidegauge.plans.queries import QUERIES
from tidegauge.sources import synthetic
from tidegauge.streaming import detector, drift, windowed


def test_stream_equals_replay(spark, tmp_path):
    s = synthetic.with_outliers(spark, 400, 50, 9.0).select("series_id", "ts", "value")
    s.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 100).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    options = {"method": "zscore", "threshold": 3.0, "size": 60, "adaptive": True}
    q = detector.detect_stream(stream, **options).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.ts, round(r.score, 9)) for r in spark.table("found").collect())
    assert got and got == sorted((r.ts, round(r.score, 9)) for r in detector.replay(s, **options).collect())


def test_late_events_are_dropped(spark, tmp_path):
    rows = [("a", 0, 1.0), ("a", 30, 2.0), ("a", 7200, 3.0)]
    schema = "series_id string, ts timestamp, value double"
    frame = lambda r: spark.createDataFrame(r, "series_id string, t long, value double").select("series_id", F.timestamp_seconds("t").alias("ts"), "value")
    src = str(tmp_path / "in")
    frame(rows).coalesce(1).write.parquet(src)
    q = windowed.tumbling(spark.readStream.schema(schema).parquet(src), "1 minute", "10 minutes").writeStream.format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    frame([("a", 10, 99.0), ("a", 20000, 1.0)]).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r["mean"]) for r in spark.table("w").orderBy("start").collect()] == [(2, 1.5), (1, 3.0)]


def test_drift(spark):
    s = with_index(synthetic.change_point(spark, 200, 100, 0.0, 8.0, 0.1))
    assert any(100 <= r.idx <= 160 for r in drift.detect_drift(s, "adwin", delta=1.0).collect())
    assert any(r.idx >= 100 for r in drift.detect_drift(s, "page_hinkley", limit=20.0).collect())
    errors = with_index(synthetic.change_point(spark, 300, 150, 0.0, 1.0, 0.0))
    assert drift.detect_drift(errors, "ddm").count() >= 1 and drift.detect_drift(errors, "eddm").count() == 0


@pytest.fixture(scope="module")
def long_events(spark, tmp_path_factory):
    """3000 points of one event type: noise, an outlier at 2300, another level from 2500 on."""
    d = str(tmp_path_factory.mktemp("long"))
    v = np.random.default_rng(5).normal(size=3000)
    v[2300] += 40
    v[2500:] += 30
    spark.createDataFrame([("click", i, float(x)) for i, x in enumerate(v)], "event_type string, t long, value double").select("event_type", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "value").write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["stream_zscore", "stream_modified_zscore", "stream_iqr", "stream_volatility", "stream_adaptive", *(f"drift_{m}" for m in drift.DETECTORS)])
def test_replays_take_the_whole_series(spark, long_events, monkeypatch, name):
    monkeypatch.setattr(detector, "replay", lambda s, **_: s)
    monkeypatch.setattr(drift, "detect_drift", lambda s, _: s)
    assert QUERIES[name](spark, long_events).count() == 3000


def test_late_anomalies_and_drifts_are_found(spark, long_events):
    for m in ("zscore", "modified_zscore", "iqr", "adaptive"):
        assert 40 < max(r.value for r in QUERIES[f"stream_{m}"](spark, long_events).where("ts < timestamp_seconds(2500)").collect()) < 50
    for m in ("adwin", "page_hinkley"):
        assert any(r.idx >= 2500 for r in QUERIES[f"drift_{m}"](spark, long_events).collect())


def test_adwin_equals_means_of_the_halves():
    x = np.repeat([0.0, 5.0, 1.0], 200) + np.random.default_rng(6).normal(size=600)
    a, window, variance = drift.Adwin(), [], 0.0
    for v in x.tolist():
        window.append(v)
        half = len(window) // 2
        want = len(window) > 2 and abs(np.mean(window[:half]) - np.mean(window[half:])) > 0.5 * (1 + variance) ** 0.5
        window = window[half:] if want else window
        variance = float(np.var(window))
        assert a.push(v) == want and abs(a.variance - variance) < 1e-9


def test_quartiles_on_the_threshold(spark, tmp_path):
    """Windows whose quartiles decide: the sum of two rounded products puts both scores beside their true place."""
    x = [55.63, 63.5, 104.75, 3.62, 98.05, 89.76, 67.5, 53.91, 2.26, 64.41, 42.14, 35.99, 18.79, 126.67, 3.21, 53.99, 2.11, 35.43, 0.09, 62.35, 16.26, 137.43, 35.8, 13.54, 139.74]
    x += [11.09, 0.32, 43.64, 47.42, 251.16, 71.78, 21.0, 42.87, 223.15, 12.88, 34.86, 20.9, 180.82, 3.19, 8.08, 65.29, 55.64, 11.62, 107.83, 7.84, 185.13, 125.68, 14.25, 55.07, 228.36]
    rows = [("error", i, v) for i, v in enumerate(x)]
    # 12 below, the four values around the quartiles, 22 between them, 11 above and the point itself
    rows += [("signup", i, v) for i, v in enumerate([1.0] * 12 + [14.34, 15.71] + [30.0] * 22 + [51.36, 55.79] + [60.0] * 11 + [180.21])]
    df = spark.createDataFrame(rows, "event_type string, t long, value double").select("event_type", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "value")
    df.write.parquet(f"{tmp_path}/events.parquet")
    d = duckdb.connect()
    d.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["stream_iqr"](spark, str(tmp_path))
    want = d.execute(f"select {', '.join(got.columns)} from ({SQL['stream_iqr']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert ("signup", 180.21, 1.638188) in {(r.series_id, r.value, r.score) for r in got.collect()}
    for key in ("error", "signup"):
        pdf = df.where(F.col("event_type") == key).orderBy("ts").toPandas()
        replayed = detector.Detector(method="iqr", threshold=0.5, size=50).run(key, pdf)
        assert [(v, round(s, 6)) for v, s in zip(replayed["value"], replayed["score"], strict=True)] == [(r.value, r.score) for r in got.where(F.col("series_id") == key).orderBy("ts").collect()]


def test_quartiles_with_infinite_values(spark):
    for held in ([1.0, 2.0, float("inf")], [1.0, float("inf"), float("inf")], [-float("inf"), 2.0, 3.0, 4.0, 5.0, float("inf")]):
        c = spark.range(1).select(detector._quantile(F.array(*map(F.lit, held)), 0.75).alias("q")).first().q
        assert c == np.inf if held[-2] == np.inf or len(held) == 3 else c == 4.75
        assert detector._quantile_of(np.array(held), 0.75) == c
