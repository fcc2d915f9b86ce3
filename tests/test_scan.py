"""Rows of one series in many blocks give what a window over the series gives."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.operators import scan, series, stationarity, windows
from tidegauge.plans import queries


@pytest.fixture(scope="module")
def rows(spark):
    """A long series, some short ones, one of missing values; holes and infinite values in between."""
    n = F.when(F.col("id") < 40_000, "long").when(F.col("id") < 40_040, F.concat(F.lit("s"), F.col("id") % 7)).otherwise("none")
    x = F.sin(F.col("id") / 50) * 10 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 100
    hole = (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0) | F.col("id").between(11_000, 19_000) | (F.col("id") < 300) | (F.col("id") >= 40_040)
    v = F.when(hole, None).when(F.col("id") % 997 == 0, float("inf")).otherwise(x)
    df = spark.range(40_050).select(n.alias("series_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), v.alias("value"))
    return df.unionByName(spark.createDataFrame([("s1", None, 5.0)], "series_id string, ts timestamp, value double")).repartition(6)


@pytest.fixture(scope="module")
def blocks(rows):
    return scan.dealt(rows, 16)


def same(a, b, name, digits=9):
    keys = ["series_id", "ts"]
    both = a.select(*keys, F.col(name).alias("a")).join(b.select(*keys, F.col(name).alias("b")), keys, "full")
    x, y = (F.round(c, digits) if dict(both.dtypes)[c] == "double" else F.col(c) for c in ("a", "b"))
    assert both.where(~x.eqNullSafe(y)).isEmpty() and both.count() == 40_050


def test_no_block_is_large(blocks):
    n = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert len(n) == 16 and max(n) <= 2 * 40_050 / 16


def test_index_fills_and_differences(rows, blocks):
    want = series.with_index(rows.where("ts is not null"))
    got = scan.with_index(blocks)
    same(got, want, "idx")
    same(got, want, "vidx")
    same(scan.forward_fill(got), windows.forward_fill(want), "filled")
    same(scan.backward_fill(got), windows.backward_fill(want), "filled")
    same(scan.linear_fill(got), windows.linear_fill(want), "filled")
    d = want.withColumn("difference", F.col("value") - F.lag("value").over(series.by_index()))
    same(scan.differences(got), d, "difference")


def test_no_frame_is_computed_anew_for_each_row(blocks):
    """A frame that ends with its partition takes the square of a block's rows."""
    for f in (scan.backward_fill, scan.linear_fill):
        plan = f(scan.with_index(blocks))._jdf.queryExecution().analyzed().toString()
        assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_numbered_blocks_are_the_numbered_series(spark):
    a, b = (f(spark, "/root/testdata/sf0.001").select("series_id", "ts", "value", "idx") for f in (queries.holed_by_blocks, queries.holed))
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_running_extremes_and_cusum(spark, rows, blocks):
    w = series.by_index().rowsBetween(Window.unboundedPreceding, 0)
    want = series.with_index(rows.where("ts is not null"))
    got = scan.running(blocks, low=("min", F.col("value")), high=("max", F.col("value")), total=("sum", F.col("value")))
    clean = F.col("value")
    for name, agg in (("low", F.min), ("high", F.max)):
        same(got, want.withColumn(name, agg(clean).over(w)), name)
    a, b = scan.cusum(scan.with_index(blocks)), stationarity.cusum(want)
    both = a.join(b.select("series_id", "idx", F.col("up").alias("u"), F.col("down").alias("d"), F.col("alarm").alias("l")), ["series_id", "idx"], "full")
    assert both.where("abs(up - u) > 1e-6 or abs(down - d) > 1e-6 or alarm <> l or up is null or u is null").isEmpty() and both.count() == b.count()
    assert scan.with_index(scan.dealt(rows.limit(0), 4)).count() == 0
    with pytest.raises(ValueError):
        scan.running(blocks, x=("mode", F.col("value")))
