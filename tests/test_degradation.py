"""Declines at planted places, on tables and streams."""

import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators import degradation
from tidegauge.streaming.online import ROCKS


def frame(spark, named, step=86_400):
    rows = [(k, i * step, None if v is None else float(v)) for k, x in named.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, t long, score double").select("series_id", F.timestamp_seconds("t").alias("ts"), "score")


def data():
    rng = np.random.default_rng(1)
    steady = 90 + rng.normal(size=80)
    sudden, gradual = steady.copy(), steady.copy()
    sudden[40:46] -= 35
    gradual[40:] -= np.arange(40) * 1.5
    return {"steady": steady, "sudden": sudden, "gradual": gradual, "holes": [90, None, 91, None], "one": [50]}


def day(r):
    return int(r.timestamp() // 86_400)


def test_falls_slopes_and_runs(spark):
    h = frame(spark, data())
    drops = degradation.sudden_drops(h).collect()
    assert [(r.series_id, day(r.ts)) for r in drops] == [("sudden", 40)] and 30 < drops[0].drop < 40
    assert degradation.sudden_drops(h, within=3600).count() == 0
    d = [(r.series_id, day(r.ts), r.slope) for r in degradation.gradual_decline(h, 20 * 86_400, -1.0).collect() if r.slope < -1 and r.series_id != "sudden"]
    assert d and {k for k, _, _ in d} == {"gradual"} and 45 <= min(t for _, t, _ in d) <= 60
    x, t = data()["gradual"][50:71], np.arange(21)
    got = next(r.slope for r in degradation.gradual_decline(h, 20 * 86_400).collect() if r.series_id == "gradual" and day(r.ts) == 70)
    assert abs(got - np.polyfit(t, x, 1)[0]) < 1e-9
    runs = {(r.series_id, day(r.begin), day(r.end), r.length, r.is_open) for r in degradation.bad_runs(h, 75, 2).collect()}
    first = next(i for i in range(80) if data()["gradual"][i] < 75)
    assert ("sudden", 40, 45, 6, False) in runs and any(k == "gradual" and o for k, _, _, _, o in runs) and first >= 45 and not any(k in ("steady", "one", "holes") for k, *_ in runs)


def test_baseline_on_table_and_stream(spark, tmp_path):
    h = frame(spark, data())
    rows = degradation.against_baseline(h).collect()
    got = {k: [r.phase for r in sorted((r for r in rows if r.series_id == k), key=lambda r: r.ts)] for k in data()}
    assert set(got["steady"]) == {"learning", "good"} and got["holes"] == ["learning"] * 2
    assert got["sudden"][40:46] == ["suspect"] * 2 + ["declined"] * 4 and got["sudden"][46] == "good"
    assert got["gradual"][-1] == "declined" and "declined" not in got["gradual"][:43]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for part in (h.where("ts < timestamp_seconds(3700000)"), h.where("ts >= timestamp_seconds(3700000)")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = degradation.against_baseline_stream(spark.readStream.schema(h.schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    key = lambda r: (r.series_id, r.ts, r.score, r.phase, r.run, None if r.deviation is None or r.deviation != r.deviation else round(r.deviation, 9))
    assert sorted(map(key, spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == sorted(map(key, rows), key=str)
