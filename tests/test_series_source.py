"""The data source on folders of wide files: parts, pushed filters, streams and writes."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import series_source


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    series_source.register(spark)


@pytest.fixture
def folder(tmp_path):
    lines = ["timestamp,temperature,\"a, b\",humidity"] + [f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00,{i / 2},{'' if i % 3 else i},{'x' if i == 7 else -i}" for i in range(600)]
    lines[100] = "no time,1,2,3"
    (tmp_path / "one.csv").write_text("\n".join(lines))  # the last line has no end
    (tmp_path / "two.csv").write_text("ts,pressure\r\n2024-02-01T00:00:00Z,1.5\r\n2024-02-01T01:00:00+01:00,NaN\r\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("ts,lonely\n")
    (tmp_path / ".hidden.csv").write_text("ts,hidden\n2024-01-01,1\n")
    (tmp_path / "other.txt").write_text("ts,other\n2024-01-01,1\n")
    return str(tmp_path)


def rows(df):
    return sorted(((r.series_id, r.ts, r.value) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_parts_of_any_size_give_the_same(spark, folder, size):
    df = spark.read.format("series").option("part_bytes", size).load(folder)
    got = rows(df)
    assert len(got) == 599 * 3 + 2 and {k for k, _, _ in got} == {"temperature", "a, b", "humidity", "pressure"}
    at = {(k, t): v for k, t, v in got}
    t = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    assert at["temperature", t(9, 59)] == 299.5 and at["a, b", t(0, 3)] == 3 and at["a, b", t(0, 4)] is None and at["humidity", t(0, 7)] is None
    assert at["pressure", datetime.datetime(2024, 2, 1)] is None or at["pressure", datetime.datetime(2024, 2, 1)] == 1.5
    assert (df.rdd.getNumPartitions() > 100) == (size == 64)


def test_a_filter_reaches_the_partitions(spark, folder):
    df = spark.read.format("series").load(folder).where(F.col("series_id") == "pressure")
    assert df.rdd.getNumPartitions() == 1 and df.count() == 2
    both = spark.read.format("series").load(folder).where(F.col("series_id").isin("pressure", "humidity") & (F.col("value") < -590))
    assert both.rdd.getNumPartitions() == 2 and both.count() == 9
    reader = series_source._Reader({"path": folder})
    left = list(reader.pushFilters([series_source.EqualTo(("series_id",), "humidity"), series_source.EqualTo(("value",), 1.0)]))
    assert [f.attribute for f in left] == [("value",)] and [p.wanted for p in reader.partitions()] == [[3]]


def test_stream_reads_each_file_once(spark, folder, tmp_path_factory):
    d = tmp_path_factory.mktemp("stream")
    start = lambda: spark.readStream.format("series").load(folder).writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/cp").outputMode("append").start()
    q = start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{d}/out").count() == 1799
    with open(f"{folder}/zz.csv", "w") as f:
        f.write("ts,late\n2024-03-01,1\n2024-03-02,2\n")
    q = start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(f"{d}/out")
    assert got.count() == 1801 and got.where("series_id = 'late'").count() == 2


def test_written_series_come_back(spark, folder, tmp_path):
    s = spark.read.format("series").load(folder).where("value is not null").repartition(3, "ts")
    out = f"{tmp_path}/out"
    s.write.format("series").mode("append").save(out)
    back = spark.read.format("series").load(out)
    assert rows(back.where("value is not null")) == rows(s)
    s.where("series_id = 'humidity'").write.format("series").mode("overwrite").save(out)
    assert {r.series_id for r in spark.read.format("series").load(out).select("series_id").distinct().collect()} == {"humidity"}
    bad = s.withColumn("value", F.when(F.col("series_id") == "humidity", F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("series").mode("append").save(out)
    assert {r.series_id for r in spark.read.format("series").load(out).select("series_id").distinct().collect()} == {"humidity"}
