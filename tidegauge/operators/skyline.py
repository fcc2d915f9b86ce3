"""Rows that nothing beats in every respect: fronts, crowding and hypervolume. All objectives are maximised.

Equal rows are one point. Each task first keeps the points of its own that none of them beats. What is
left is dealt to blocks, each pair of blocks meets in a group, and a point that no block
beats is on the front. So no task holds more than two blocks, however large the front is. Later fronts are those of what the earlier ones leave.

Defined results: rows with a null or NaN objective take no part. Repeated rows are on a front together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from ..functions.staged import dropped, staged

#: Points of a block.
BLOCK = 4096


def unbeaten(points: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """Which rows no row of ``against`` (or of themselves) beats: as good in all columns and better in one."""
    if against is None:
        # whoever beats a row has a larger sum, so it comes earlier
        order = np.lexsort((*points.T[::-1], -points.sum(1)))
        held, out = np.zeros((0, points.shape[1])), np.zeros(len(points), bool)
        for lo in range(0, len(order), 256):
            lot = order[lo : lo + 256]
            rest = lot[unbeaten(points[lot], held)] if len(held) else lot
            x = points[rest]
            inside = ((x[None] >= x[:, None]).all(2) & (x[None] > x[:, None]).any(2)).any(1)
            out[rest[~inside]] = True
            held = np.concatenate([held, x[~inside]])
        return out
    out = np.ones(len(points), bool)
    for lo in range(0, len(against), 256):
        y = against[lo : lo + 256]
        x = points[out]
        beaten = ((y[None] >= x[:, None]).all(2) & (y[None] > x[:, None]).any(2)).any(1)
        out[np.flatnonzero(out)[beaten]] = False
    return out


def _matrix(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([np.asarray(table[n], float) for n in names]) if table.num_rows else np.zeros((0, len(names)))


def front_points(rows: DataFrame, objectives: list[str]) -> DataFrame:
    """The distinct points (columns ``o0``, ``o1``, ...) that no row beats."""
    names = [f"o{i}" for i in range(len(objectives))]
    schema = ", ".join(f"{n} double" for n in names)
    points = rows.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(objectives, names, strict=True)])
    for n in names:
        points = points.where(F.col(n).isNotNull() & ~F.isnan(n))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(names)))
        for b in batches:
            both = np.unique(np.concatenate([held, _matrix(b, names)]), axis=0)
            held = both[unbeaten(both)]
        for lo in range(0, len(held), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[lo : lo + BLOCK].T], names)

    local = staged(points.mapInArrow(own, schema).distinct())
    blocks = max(1, -(-local.count() // BLOCK))
    at = F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tested = local.select(*names, F.lit(True).alias("asks"), at.alias("a"), every.alias("b"))
    beating = local.select(*names, F.lit(False).alias("asks"), every.alias("a"), at.alias("b")).select(*names, "asks", "a", "b")

    def across(table: pa.Table) -> pa.Table:
        asks = np.asarray(table["asks"])
        x = _matrix(table, names)
        left = x[asks][unbeaten(x[asks], x[~asks])]
        return pa.table({n: pa.array(c, pa.float64()) for n, c in zip(names, left.T, strict=True)})

    return tested.unionByName(beating).groupBy("a", "b").applyInArrow(across, schema).groupBy(*names).count().where(F.col("count") == blocks).select(*names)


def _on(rows: DataFrame, points: DataFrame, objectives: list[str], how: str) -> DataFrame:
    same = [F.col(f"`{c}`").cast("double") == F.col(f"o{i}") for i, c in enumerate(objectives)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return rows.join(points, condition, how)


def pareto_front(rows: DataFrame, objectives: list[str]) -> DataFrame:
    """The rows of the first front, with all their columns."""
    return _on(rows, front_points(rows, objectives), objectives, "left_semi")


def fronts(rows: DataFrame, objectives: list[str], most: int | None = None) -> DataFrame:
    """Rows with their ``front``, from 1; ``most``: of the first so many fronts only."""
    left = rows
    for c in objectives:
        left = left.where(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double")))
    left, parts = staged(left), []
    while (most is None or len(parts) < most) and not left.isEmpty():
        points = staged(front_points(left, objectives))
        parts.append(staged(_on(left, points, objectives, "left_semi").withColumn("front", F.lit(len(parts) + 1))))
        before, left = left, staged(_on(left, points, objectives, "left_anti"))
        dropped(before)
    if not parts:
        return left.withColumn("front", F.lit(0))
    return rows.sparkSession.read.schema(parts[0].schema).parquet(*[p._staged_at for p in parts])


def crowding(ranked: DataFrame, key: str, objectives: list[str]) -> DataFrame:
    """Adds ``crowding``: the gap between a row's neighbours on its front in each objective, over the objective's range there, summed. Infinite at the ends and on fronts of one or two rows."""
    out, total = ranked, F.lit(0.0)
    n = F.count("*").over(Window.partitionBy("front"))
    for i, c in enumerate(objectives):
        value = F.col(f"`{c}`").cast("double")
        w = Window.partitionBy("front").orderBy(value, key)
        wide = F.max(value).over(Window.partitionBy("front")) - F.min(value).over(Window.partitionBy("front"))
        gap = F.lead(value).over(w) - F.lag(value).over(w)
        end = F.lead(F.lit(1)).over(w).isNull() | F.lag(F.lit(1)).over(w).isNull()
        out = out.withColumn(f"_gap{i}", F.when(end, F.lit(float("inf"))).otherwise(F.coalesce(safe_div(gap, wide), F.lit(0.0))))
        total = total + F.col(f"_gap{i}")
    return out.withColumn("crowding", F.when(n <= 2, F.lit(float("inf"))).otherwise(total)).drop(*[f"_gap{i}" for i in range(len(objectives))])


def hypervolume(ranked: DataFrame, objectives: list[str], reference: tuple[float, float]) -> DataFrame:
    """The area that each front's points cover beyond ``reference``, of two objectives, by a sweep along the first."""
    x, y = objectives
    p = ranked.select("front", F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y")).where((F.col("x") > reference[0]) & (F.col("y") > reference[1])).distinct()
    w = Window.partitionBy("front").orderBy(F.desc("x"))
    strip = (F.col("x") - reference[0]) * (F.col("y") - F.coalesce(F.lag("y").over(w), F.lit(float(reference[1]))))
    return p.withColumn("strip", strip).groupBy("front").agg(F.count("*").alias("points"), F.sum("strip").alias("hypervolume"))
