"""Queries take whole tables and whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import multivariate
from tidegauge.plans.queries import QUERIES


def test_sessions_of_all_users(spark, tmp_path):
    rows = [(u, t, 1.0) for u in (7, 50, 999) for t in (0, 60, 7200)]
    spark.createDataFrame(rows, "user_id long, t long, value double").select("user_id", F.timestamp_seconds("t").alias("ts"), "value").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted((r.user_id, r.n) for r in QUERIES["session_windows"](spark, str(tmp_path)).collect()) == [(u, n) for u in (7, 50, 999) for n in (1, 2)]


@pytest.fixture(scope="module")
def flags(spark, tmp_path_factory):
    """Two flags with 700 days each, which differ from day 250 on."""
    d = str(tmp_path_factory.mktemp("flags"))
    v = np.random.default_rng(8).integers(1, 50, 700).astype(float)
    w = np.where(np.arange(700) < 250, v, 90 - v[::-1])
    rows = [(f, i, float(x)) for f, vs in (("A", v), ("N", w)) for i, x in enumerate(vs)]
    spark.createDataFrame(rows, "l_returnflag string, i int, l_quantity double").select("l_returnflag", F.date_add(F.lit("1995-01-01").cast("date"), F.col("i")).alias("l_shipdate"), "l_quantity").write.parquet(f"{d}/lineitem.parquet")
    return d, v, w


def test_distances_of_whole_series(spark, flags):
    d, v, w = flags
    a, b = v - v.mean(), w - w.mean()
    want = {
        "euclidean": np.sqrt(((v - w) ** 2).sum()), "manhattan": np.abs(v - w).sum(), "cosine": 1 - v @ w / np.sqrt((v @ v) * (w @ w)),
        "dtw": multivariate.warp(v, w)[0], "soft_dtw": multivariate.soft_warp(v, w), "cross_correlation": 1 - np.correlate(a, b, "full").max() / np.sqrt((a @ a) * (b @ b)),
    }
    for m, x in want.items():
        assert abs(QUERIES[f"distance_{m}"](spark, d).first().distance - x) < 1e-5
    assert all(abs(r.distance - want["euclidean"]) < 1e-5 for r in QUERIES["nearest_series"](spark, d).collect())


def test_warping_by_diagonals():
    rng = np.random.default_rng(9)
    for n, m in ((1, 1), (1, 9), (9, 1), (23, 40), (40, 23)):
        x, y = rng.normal(size=n), rng.normal(size=m)
        r = np.full((n + 1, m + 1), np.inf)
        r[0, 0] = 0
        for i in range(n):
            for j in range(m):
                r[i + 1, j + 1] = (x[i] - y[j]) ** 2 - np.log(np.exp(-np.array([r[i, j], r[i, j + 1], r[i + 1, j]])).sum())
        assert abs(multivariate.soft_warp(x, y) - r[n, m]) < 1e-9 and multivariate.warp_distance(x, y) == multivariate.warp(x, y)[0]


def test_consistency_of_all_cycles(spark, tmp_path):
    x = np.sin(np.arange(60 * 7) * 2 * np.pi / 7) * 100 + 500
    x[50 * 7 :] = np.random.default_rng(10).normal(500, 100, 10 * 7)
    x[3 * 7 : 4 * 7] = 500
    x = np.append(x, [1.0, 2.0]).round(2)
    rows = [("1-URGENT", i, float(v)) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "o_orderpriority string, i int, o_totalprice double").select("o_orderpriority", F.date_add(F.lit("1995-01-01").cast("date"), F.col("i")).alias("o_orderdate"), "o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    cycles = np.delete(x[:420].reshape(60, 7), 3, 0)
    r = np.corrcoef(cycles)[np.triu_indices(59, 1)]
    got = QUERIES["pattern_consistency"](spark, str(tmp_path)).first()
    assert got.n_pairs == 59 * 58 // 2 and abs(got.consistency - r.mean()) < 1e-6


def test_complexity_of_whole_series(spark, flags):
    d, *both = flags

    def phi(x, m):
        w = np.lib.stride_tricks.sliding_window_view(x, m)
        return np.log((np.abs(w[:, None] - w[None]).max(2) <= 0.2 * np.abs(x).mean()).mean(1)).mean()

    got = {r.series_id: r.approximate_entropy for r in QUERIES["complexity"](spark, d).collect()}
    assert all(abs(got[f] - (phi(x, 2) - phi(x, 3))) < 1e-5 for f, x in zip("AN", both, strict=True))
