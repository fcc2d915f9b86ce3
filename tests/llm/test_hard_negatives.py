import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row long, score string"


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def brute(rows, anchors=10, positives=5, negatives=5):
    ok = [(i, whole(v), y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, y in ok:
        if i % anchors:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, w, z in ok if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            fit = [x for x in scored if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


def corpus(seed, n=150, dim=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (4, dim))
    rows = []
    for i in range(n):
        y = 0 if i % 3 == 0 else int(rng.integers(0, 4))
        v = centres[y] * 0.4 + np.round(rng.normal(0, 1, dim), 1)  # many ties
        rows.append((i, v.tolist(), y))
    rows[20] = (20, rows[10][1], 1)
    odd = [(None, rows[0][1], 1), (1001, None, 1), (1002, rows[0][1], None), (1003, [*rows[0][1][:-1], None], 1), (1004, [float("nan")] * dim, 1), (1005, [float("inf")] * dim, 1), (1006, rows[0][1][:4], 0), (1010, [], 0), (1007, [*rows[1][1], 5.0, 5.0], 2), (1020, [0.0] * dim, 77)]
    return [*rows, *odd, rows[5], rows[30]]  # repeated rows, one of them an anchor


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in rows], SCHEMA)


@pytest.mark.parametrize("chunk,a,b", [(4, 3, 16), (32, 256, 2048)])
def test_matches_brute_force(spark, chunk, a, b):
    rows = corpus(1)
    df = hard_negatives.mine(frame(spark, rows), F.col("label"), F.col("vec_id") % 10 == 0, chunk=chunk, anchor_rows=a, candidate_rows=b)
    got = sorted(tuple(r) for r in df.collect())
    assert got == brute(rows) and len(got) > 100


def test_without_rows_or_anchors(spark):
    df = frame(spark, corpus(2))
    assert hard_negatives.mine(df.limit(0), F.col("label"), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("label"), F.col("vec_id") < 0).count() == 0
    assert hard_negatives.mine(df.limit(1), F.col("label"), F.lit(True)).count() == 0


def test_large_numbers_stay_exact():
    a = np.array([[1 << 29, 3], [-(1 << 29), 7]], np.int64)
    assert (hard_negatives._matmul(a, a) == np.array([[(1 << 58) + 9, 21 - (1 << 58)], [21 - (1 << 58), (1 << 58) + 49]])).all()
    small = np.random.default_rng(3).integers(-300, 300, (20, 64))
    assert (hard_negatives._matmul(small, small) == small @ small.T).all()
