"""Document quality by hierarchical empirical Bayes.

A logistic classifier on counts of characters, words and lines gives each document its
evidence, a log-odds. Sites pool the probabilities of their documents in two levels:
a host's posterior is shrunk toward the global mean, a path's toward its host's, each
by a prior strength estimated from all hosts or paths by the method of moments. A
document's own share is left out of its site's posterior. Its final log-odds is its
evidence plus what its path's posterior differs from the global prior.

All statistics are grouped sums over all documents, combined before they are shuffled;
what reaches the driver is one row of moments, and at most ``SAMPLE`` labelled rows of
features to fit the classifier on, taken in the order of a hash of the id.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, rows_without, settle, small_batches

#: The most labelled documents that the classifier is fitted on.
SAMPLE = 20_000
#: Probability of quality below which a document is rejected.
THRESHOLD = 0.5
#: Bounds of the prior strengths, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1e6
_EDGE = 1e-6

_CLASSES = [bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t\n\x0b\x0c\r", b"!", b"#$%&*", b"|", b".,;:?-'\"()", bytes(range(128, 256))]


def features(text: str) -> list[float]:
    """Shares and rates of a text, all bounded or in logarithms."""
    raw, words, lines = text.encode("utf-8", "replace"), text.split(), text.split("\n")
    size, n = max(1, len(raw)), max(1, len(words))
    share = [(len(raw) - len(raw.translate(None, c))) / size for c in _CLASSES]
    letters = share[0] + share[1] + 1e-9
    again = sum(map(operator.eq, words, words[1:])) / n
    full = [x for x in lines if x.strip()]
    return [
        1.0, *[math.sqrt(s) for s in share], share[0] / letters, again, math.sqrt(again), len(set(words)) / n,
        math.log1p(len(words)), math.log1p(size / n), math.log1p(max(map(len, words), default=0)),
        len(set(full)) / max(1, len(full)), math.log1p(len(text) / len(lines)), math.log1p(text.count("!!") + text.count("***") + text.count("###")) / math.log1p(n + 2),
    ]


@dataclass(frozen=True)
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def _expanded(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, x[:, 1:] ** 2])

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, penalty: float = 3.0, steps: int = 12) -> Classifier:
        """Penalised logistic regression by Newton's method; without both classes, the rate alone."""
        if len(y) == 0 or y.min() == y.max():
            rate = (y.sum() + 1) / (len(y) + 2)
            wide = len(features(""))
            w = np.zeros(Classifier._expanded(np.ones((1, wide))).shape[1])
            w[0] = math.log(rate / (1 - rate))
            return Classifier(np.zeros(wide), np.ones(wide), w)
        mean, scale = x.mean(0), x.std(0) + 1e-3
        mean[0], scale[0] = 0, 1
        z = Classifier._expanded(np.clip((x - mean) / scale, -6, 6))
        w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
        ridge[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (y - p) - ridge * w
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), grad)
            w = w + step * min(1.0, 10 / (np.linalg.norm(step) + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        return Classifier(mean, scale, w)

    def log_odds(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([features(t) for t in texts])
        return np.clip(self._expanded(np.clip((x - self.mean) / self.scale, -6, 6)) @ self.weights, -12, 12)


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Classifier:
    """Fit on at most ``sample`` documents with a label of 0 or 1. Ids or labels that are null, and labels without a document, don't count."""
    chosen = labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    chosen = chosen.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    with small_batches(docs.sparkSession):
        rows = texts.select("id", "y", "text").mapInArrow(run, "id long, y int, x array<double>").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("id").collect()
    return Classifier.fit(np.array([r.x for r in rows]).reshape(len(rows), len(features(""))), np.array([float(r.y) for r in rows]))


def _evidence(texts: DataFrame, model: Classifier) -> DataFrame:
    """``texts`` (its last column is the text) with ``log_odds`` in place of the text."""
    keep = texts.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = model.log_odds(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(z, pa.float64())], [*keep, "log_odds"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return texts.mapInArrow(run, f"{schema}, log_odds double")


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(_EDGE), F.least(F.lit(1 - _EDGE), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, prior: Column) -> float:
    """How many documents the prior is worth: what is left of the spread of the groups' means without that of their documents."""
    n, mean = F.col("n").cast("double"), F.col("total") / F.col("n")
    within = F.greatest(F.lit(0.0), F.col("squares") / n - mean * mean)
    row = groups.where("n > 1").agg(F.sum(n * (mean - prior) ** 2 - within), F.sum(n), F.sum(n * prior * (1 - prior))).first()
    if not row or not row[1]:
        return LEAST_STRENGTH
    between, spread = max(0.0, row[0] / row[1]), row[2] / row[1]
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, spread / between - 1 if between > spread / MOST_STRENGTH else MOST_STRENGTH))


@dataclass(frozen=True)
class Sites:
    """Sums by host and path, with the prior that a path has from its host."""

    paths: DataFrame
    mean: float
    host_strength: float
    path_strength: float


def fit_sites(scores: DataFrame) -> Sites:
    """From ``host``, ``path`` and ``log_odds`` of all documents; a null host or path is a site of its own."""
    p = 1 / (1 + F.exp(-F.col("log_odds")))
    paths = settle(scores.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("total"), F.sum(p * p).alias("squares")), "quality-sites")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    row = hosts.agg(F.sum("total"), F.sum("n")).first()
    mean = (row[0] or 0.0) / row[1] if row and row[1] else 0.5
    s1 = _strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("total").alias("host_total"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    s2 = _strength(joined, (F.lit(s1 * mean) + F.col("host_total")) / (F.lit(s1) + F.col("host_n")))
    return Sites(joined.select("host", "path", "n", "total", "host_n", "host_total"), mean, s1, s2)


def _posterior(sites: Sites, own: Column) -> tuple[Column, Column]:
    """Host's and path's posterior mean without a document of probability ``own``."""
    less = lambda total: F.greatest(F.lit(0.0), F.col(total) - own)
    host = (F.lit(sites.host_strength * sites.mean) + less("host_total")) / (F.lit(sites.host_strength) + F.col("host_n") - 1)
    return host, (F.lit(sites.path_strength) * host + less("total")) / (F.lit(sites.path_strength) + F.col("n") - 1)


def _at_site(rows: DataFrame, sites: Sites, host: Column, path: Column) -> DataFrame:
    found = sites.paths.withColumnsRenamed({"host": "site_host", "path": "site_path"})
    return rows.join(found, host.eqNullSafe(F.col("site_host")) & path.eqNullSafe(F.col("site_path")))


def _judged(rows: DataFrame, sites: Sites) -> DataFrame:
    host, path = _posterior(sites, 1 / (1 + F.exp(-F.col("log_odds"))))
    z = F.col("log_odds") + _logit(F.col("path_posterior")) - _logit(F.lit(sites.mean))
    return rows.withColumn("host_posterior", host).withColumn("path_posterior", path).withColumn("probability", 1 / (1 + F.exp(-z)))


def classify_quality(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """id, host, path, ``log_odds``, both posteriors, ``probability`` and ``keep`` of each row.

    Null texts count as empty; null hosts and paths are sites of their own; repeated
    rows count as often as they occur; without labels of both kinds the evidence is the
    same for all. An empty table gives an empty result.
    """
    model = fit_classifier(docs, labels, id_col, text_col, sample=sample)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{path_col}`").cast("string").alias("path"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    scores = settle(_evidence(slim, model), "quality-scores")
    sites = fit_sites(scores)
    judged = _judged(_at_site(scores, sites, F.col("host"), F.col("path")), sites)
    return judged.select(F.col("id").alias(id_col), "host", "path", "log_odds", "host_posterior", "path_posterior", "probability", (F.col("probability") >= threshold).alias("keep"))


def keep_quality(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that :func:`classify_quality` keeps, with all their columns.

    Evidence is computed once, without the texts; of the rows themselves only those are
    shuffled whose text's hash is marked as rejected.
    """
    model = fit_classifier(docs, labels, id_col, text_col, sample=sample)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{path_col}`").cast("string").alias("path"), text.alias("text"))
    scores = settle(_evidence(slim, model), "quality-scores")
    sites = fit_sites(scores)
    judged = _judged(_at_site(scores, sites, F.col("host"), F.col("path")), sites)
    gone = settle(judged.where(F.col("probability") < threshold).select("id", "text_hash", F.col("host").alias("other0"), F.col("path").alias("other1")).distinct(), "quality-gone")
    release(scores)
    return rows_without(docs, gone, id_col, text_col, (host_col, path_col))
