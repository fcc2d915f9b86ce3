"""Fronts, crowding and hypervolume against brute force, with ties."""

import math

import numpy as np
import pytest

from tidegauge.operators import skyline


def brute(points):
    left, out, k = dict(enumerate(points)), {}, 0
    while left:
        k += 1
        top = [i for i, p in left.items() if not any(all(b >= a for a, b in zip(p, q, strict=True)) and any(b > a for a, b in zip(p, q, strict=True)) for q in left.values())]
        for i in top:
            out[i] = k
            del left[i]
    return out


@pytest.mark.parametrize("dims,block", [(1, 4096), (2, 8), (3, 16), (4, 4096)])
def test_fronts_equal_brute_force(spark, dims, block, monkeypatch):
    monkeypatch.setattr(skyline, "BLOCK", block)
    rng = np.random.default_rng(dims)
    points = [tuple(float(v) for v in p) for p in rng.integers(0, 7, (120, dims))]  # many ties and repeated points
    names = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(900, *([None] * dims)), (901, *([float("nan")] * dims))], "id long, " + ", ".join(f"{n} double" for n in names)).repartition(4)
    want = brute(points)
    assert {r.id for r in skyline.pareto_front(df, names).collect()} == {i for i, k in want.items() if k == 1}
    got = {r.id: r.front for r in skyline.fronts(df, names, 3).collect()}
    assert got == {i: k for i, k in want.items() if k <= 3}
    assert skyline.fronts(df.limit(0), names).count() == 0


def test_all_fronts_and_the_plan(spark):
    rng = np.random.default_rng(9)
    points = [tuple(float(v) for v in p) for p in rng.integers(0, 4, (40, 2))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, a double, b double")
    assert {r.id: r.front for r in skyline.fronts(df, ["a", "b"]).collect()} == brute(points)
    assert "NestedLoop" not in skyline.pareto_front(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()


def test_a_front_of_all_points(spark, monkeypatch):
    monkeypatch.setattr(skyline, "BLOCK", 50)
    df = spark.range(400).selectExpr("id", "cast(id as double) a", "cast(400 - id as double) b").repartition(3)
    assert skyline.pareto_front(df, ["a", "b"]).count() == 400


def test_crowding_and_hypervolume(spark):
    rows = [(0, 1.0, 9.0, 1), (1, 3.0, 7.0, 1), (2, 4.0, 2.0, 1), (3, 9.0, 1.0, 1), (4, 0.0, 0.0, 2), (5, 0.0, 0.0, 2)]
    df = spark.createDataFrame(rows, "id long, a double, b double, front int")
    got = {r.id: r.crowding for r in skyline.crowding(df, "id", ["a", "b"]).collect()}
    assert got[0] == got[3] == got[4] == got[5] == math.inf
    assert abs(got[1] - (3 / 8 + 7 / 8)) < 1e-12 and abs(got[2] - (6 / 8 + 6 / 8)) < 1e-12
    h = {r.front: (r.points, r.hypervolume) for r in skyline.hypervolume(df, ["a", "b"], (0.0, 0.0)).collect()}
    grid = sum(any(x < a and y < b for _, a, b, f in rows if f == 1) for x in range(10) for y in range(10))
    assert h == {1: (4, grid)}
