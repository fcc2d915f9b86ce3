import numpy as np
from pyspark.sql import functions as F

from tidegauge.llm.ann import Quantizer, search


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c") for i, v in vectors], "vec_id long, embedding array<float>, score string")


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    x[100:160] = x[100]
    x = x.astype(np.float32).astype(float)
    rows = search(frame(spark, enumerate(x)), F.col("vec_id") % 20 == 0, k=20, block=1000).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
    hits = []
    for q, mine in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:20]
        mine.sort(key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all(abs(r.score - x[r.vec_id] @ x[q]) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits.append(len({r.vec_id for r in mine} & set(want.tolist())) / 20)
    assert len(got) == 150 and np.mean(hits) >= 0.95


def test_recall_on_the_shared_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids, x = np.array(sorted(data)), np.stack([data[i] for i in sorted(data)])
    got = {}
    for r in search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q, mine in got.items():
        s = np.where(ids == q, -np.inf, x @ data[q])
        hits.append(len(mine & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
    assert len(got) == (ids % 20 == 0).sum() and np.mean(hits) >= 0.9


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1, 2]), (1, [2, 1]), (2, None), (3, [0, 0]), (4, [1, None]), (5, [float("inf"), 1]), (6, [float("nan"), 1]), (7, []), (8, [1, 2, 3]), (None, [5, 5]), (9, [1, 2]), (9, [1, 2])]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in search(frame(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 9, 5.0), (0, 2, 1, 4.0)]
    assert search(frame(spark, rows).limit(0), F.col("vec_id") == 0).count() == 0
    assert search(frame(spark, [(0, [1.0])]), F.col("vec_id") == 0).count() == 0


def test_anisotropic_codes_lower_the_error_along_the_vector():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def along(match):
        q = Quantizer.fit(x, match)
        c = q.codes(x)
        back = np.stack([q.books[s][c[:, s]] for s in range(c.shape[1])], 1).reshape(len(x), -1)[:, :16]
        return float((((x - back) * x).sum(1) ** 2).mean())

    assert along(0.5) < 0.7 * along(0.0)
