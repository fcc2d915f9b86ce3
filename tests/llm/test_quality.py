import math
from collections import defaultdict

import numpy as np
import pytest

from tidegauge.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_classifier(docs, labels.where("doc_id % 2 = 0"))
    rows = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("text", "quality").collect()
    found = model.log_odds([r.text for r in rows]) > 0
    assert np.mean(found == np.array([r.quality == 1 for r in rows])) > 0.95


def test_posteriors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), f"h{i % 7}" if i % 11 else None, f"p{i % 3}", float(rng.normal() + (i % 7) / 3)) for i in range(400)]
    scores = spark.createDataFrame(rows, "id long, host string, path string, log_odds double")
    sites = quality.fit_sites(scores)
    from pyspark.sql import functions as F

    got = {r.id: r for r in quality._judged(quality._at_site(scores, sites, F.col("host"), F.col("path")), sites).collect()}
    p = {i: 1 / (1 + math.exp(-z)) for i, _, _, z in rows}
    host, path = defaultdict(list), defaultdict(list)
    for i, h, q, _ in rows:
        host[h].append(p[i])
        path[h, q].append(p[i])
    mean = sum(p.values()) / len(p)
    assert math.isclose(sites.mean, mean) and quality.LEAST_STRENGTH <= sites.host_strength <= quality.MOST_STRENGTH
    logit = lambda x: math.log(x / (1 - x))
    for i, h, q, z in rows:
        a = (sites.host_strength * mean + sum(host[h]) - p[i]) / (sites.host_strength + len(host[h]) - 1)
        b = (sites.path_strength * a + sum(path[h, q]) - p[i]) / (sites.path_strength + len(path[h, q]) - 1)
        assert math.isclose(got[i].host_posterior, a, rel_tol=1e-9) and math.isclose(got[i].path_posterior, b, rel_tol=1e-9)
        assert math.isclose(got[i].probability, 1 / (1 + math.exp(-(z + logit(b) - logit(mean)))), rel_tol=1e-9)


def test_kept_rows_agree_and_odd_inputs(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None, None, None, None), (None, "", "xx", "s", 0), (-2, "The end of it. " * 20, "en", None, 1)], docs.schema)
    docs = docs.unionByName(odd)
    keep = {r.doc_id for r in quality.classify_quality(docs, labels).where("keep").collect()}
    out = quality.keep_quality(docs, labels)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == keep
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(d in keep for d, q in truth.items() if q == 1) >= 0.98 * sum(truth.values())
    assert sum(d in keep for d, q in truth.items() if q == 0) <= 3
    assert quality.classify_quality(docs, labels.limit(0)).count() == docs.count()
    assert quality.classify_quality(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0, 1.0]])
def test_small_samples(y):
    x = np.array([quality.features("a b"), quality.features("!! !!")])[: len(y)]
    assert np.isfinite(quality.Classifier.fit(x, np.array(y)).log_odds(["", "word"])).all()
