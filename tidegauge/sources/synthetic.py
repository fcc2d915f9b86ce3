"""Seeded series with known properties, made by ``spark.range``; hourly from a fixed start."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.series import KEY

START = 1_000_000_000


def _frame(spark: SparkSession, name: str, n: int, value: Column, step_s: int = 3600) -> DataFrame:
    return spark.range(0, n, 1, 1).select(F.lit(name).alias(KEY), F.timestamp_seconds(F.lit(START) + F.col("id") * step_s).alias("ts"), value.cast("double").alias("value"))


def white_noise(spark: SparkSession, n: int = 1000, mean: float = 0.0, sd: float = 1.0, seed: int = 42) -> DataFrame:
    return _frame(spark, "white_noise", n, mean + sd * F.randn(seed))


def sine(spark: SparkSession, n: int = 1000, period: float = 24, amplitude: float = 1.0, noise: float = 0.0, seed: int = 42) -> DataFrame:
    return _frame(spark, "sine", n, amplitude * F.sin(2 * math.pi * F.col("id") / period) + noise * F.randn(seed))


def linear(spark: SparkSession, n: int = 1000, slope: float = 0.1, intercept: float = 0.0, noise: float = 0.0, seed: int = 42) -> DataFrame:
    return _frame(spark, "linear", n, intercept + slope * F.col("id") + noise * F.randn(seed))


def seasonal(spark: SparkSession, n: int = 1000, pattern: tuple[float, ...] = (1.0, 2.0, 3.0, 2.0), noise: float = 0.0, seed: int = 42) -> DataFrame:
    at = F.element_at(F.array(*[F.lit(x) for x in pattern]), (F.col("id") % len(pattern) + 1).cast("int"))
    return _frame(spark, "seasonal", n, at + noise * F.randn(seed))


def autoregressive(spark: SparkSession, n: int = 1000, phi: float = 0.7, sd: float = 1.0, seed: int = 42) -> DataFrame:
    """AR(1) by a fold over its noise."""
    e = _frame(spark, "ar1", n, sd * F.randn(seed))
    rows = e.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("r"))
    start = F.struct(F.lit(0.0).alias("x"), F.array().cast("array<double>").alias("out"))
    xs = F.aggregate("r", start, lambda s, v: F.struct((phi * s["x"] + v["value"]).alias("x"), F.array_append(s["out"], phi * s["x"] + v["value"]).alias("out")))["out"]
    return rows.select(KEY, F.explode(F.arrays_zip("r", xs.alias("x"))).alias("z")).select(KEY, "z.r.ts", F.col("z.x").alias("value"))


def random_walk(spark: SparkSession, n: int = 1000, step: float = 1.0, drift: float = 0.0, seed: int = 42) -> DataFrame:
    e = _frame(spark, "random_walk", n, drift + step * F.randn(seed))
    return e.withColumn("value", F.sum("value").over(Window.partitionBy(KEY).orderBy("ts")))


def change_point(spark: SparkSession, n: int = 1000, at: int = 500, before: float = 0.0, after: float = 5.0, noise: float = 1.0, seed: int = 42) -> DataFrame:
    return _frame(spark, "change_point", n, F.when(F.col("id") < at, before).otherwise(after) + noise * F.randn(seed))


def complex_series(spark: SparkSession, n: int = 1000, slope: float = 0.01, period: float = 24, amplitude: float = 2.0, noise: float = 0.5, seed: int = 42) -> DataFrame:
    return _frame(spark, "complex", n, slope * F.col("id") + amplitude * F.sin(2 * math.pi * F.col("id") / period) + noise * F.randn(seed))


def with_outliers(spark: SparkSession, n: int = 1000, every: int = 100, size: float = 10.0, seed: int = 42) -> DataFrame:
    return _frame(spark, "outliers", n, F.randn(seed) + F.when(F.col("id") % every == every - 1, size).otherwise(0.0))


def volatility_clusters(spark: SparkSession, n: int = 1000, calm: float = 0.5, wild: float = 3.0, length: int = 100, seed: int = 42) -> DataFrame:
    return _frame(spark, "volatility", n, F.randn(seed) * F.when(F.floor(F.col("id") / length) % 2 == 0, calm).otherwise(wild))


def correlated_pair(spark: SparkSession, n: int = 1000, r: float = 0.8, seed: int = 42) -> DataFrame:
    rows = spark.range(0, n, 1, 1).select("id", F.randn(seed).alias("x"), F.randn(seed + 1).alias("e"))
    cells = F.array(F.struct(F.lit("x").alias(KEY), F.col("x").alias("value")), F.struct(F.lit("y").alias(KEY), (r * F.col("x") + math.sqrt(1 - r * r) * F.col("e")).alias("value")))
    return rows.select(F.timestamp_seconds(F.lit(START) + F.col("id") * 3600).alias("ts"), F.explode(cells).alias("c")).select(f"c.{KEY}", "ts", "c.value")
