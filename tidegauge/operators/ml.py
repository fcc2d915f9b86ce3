"""What surrounds models: datasets, baselines, importance, ensemble weights, search and selection."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from .series import KEY, by_index, val, valid


def sequences(series: DataFrame, length: int, horizon: int = 1, train: float = 0.7, check: float = 0.15) -> DataFrame:
    """Sliding windows ``x`` with the next values ``y``, split in time order into train, validation and test."""
    rows = valid(series)
    x, y = by_index().rowsBetween(-(length - 1), 0), by_index().rowsBetween(1, horizon)
    out = rows.select(KEY, "idx", F.collect_list("value").over(x).alias("x"), F.collect_list("value").over(y).alias("y")).where((F.size("x") == length) & (F.size("y") == horizon))
    place = F.percent_rank().over(by_index())
    return out.withColumn("split", F.when(place < train, "train").when(place < train + check, "validation").otherwise("test"))


def persistence(series: DataFrame, horizon: int) -> DataFrame:
    """The last value, for each step: the baseline of the neural forecasters."""
    last = valid(series).groupBy(KEY).agg(F.max_by("value", "idx").alias("forecast"))
    return last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(KEY, "step", "forecast")


def permutation_importance(rows: DataFrame, features: list[str], target: str, predict: Callable[[dict], object], seed: int = 42) -> DataFrame:
    """Rise of the mean squared error when a feature's values are shuffled; ``predict`` maps columns to a column.

    Values are dealt anew by numbering the rows in random order inside blocks, not by collecting a column.
    """
    base = rows.agg(F.avg((F.col(target) - predict({f: F.col(f) for f in features})) ** 2).alias("base"))
    blocks = rows.withColumn("_b", F.spark_partition_id())
    a = blocks.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(F.monotonically_increasing_id())))
    out = None
    for k, f in enumerate(features):
        other = blocks.select("_b", F.col(f).alias("_v"), F.row_number().over(Window.partitionBy("_b").orderBy(F.rand(seed + k))).alias("_i"))
        mixed = a.join(other, ["_b", "_i"])
        e = mixed.agg(F.avg((F.col(target) - predict({g: F.col("_v") if g == f else F.col(g) for g in features})) ** 2).alias("mse")).select(F.lit(f).alias("feature"), "mse")
        out = e if out is None else out.unionByName(e)
    return out.join(F.broadcast(base)).select("feature", (F.col("mse") - F.col("base")).alias("importance"))


def ensemble_weights(errors: DataFrame, how: str = "inverse_variance") -> DataFrame:
    """Weights of ``model, error`` rows that sum to 1: equal, inverse variance, or softmax of the negative error."""
    t = errors.groupBy("model").agg(F.avg(F.col("error") ** 2).alias("mse"), F.var_pop("error").alias("v"))
    raw = {"equal": F.lit(1.0), "inverse_variance": 1 / F.greatest("v", F.lit(1e-12)), "softmax": F.exp(-F.col("mse"))}[how]
    t = t.withColumn("raw", raw)
    return t.join(F.broadcast(t.agg(F.sum("raw").alias("total")))).select("model", safe_div(F.col("raw"), F.col("total")).alias("weight"))


def ensemble_diversity(predictions: DataFrame) -> DataFrame:
    """Correlation and mean distance of each pair of models' ``row, model, prediction``."""
    p = predictions.select("row", "model", "prediction")
    both = p.toDF("row", "model1", "x").join(p.toDF("row", "model2", "y"), "row").where("model1 < model2")
    return both.groupBy("model1", "model2").agg(safe_div(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("correlation"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("disagreement"))


def grid(space: dict[str, Iterable]) -> list[dict]:
    return [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]


def random_points(space: dict[str, tuple[float, float]], n: int, seed: int = 42) -> list[dict]:
    rng = random.Random(seed)
    return [{k: rng.uniform(*r) for k, r in space.items()} for _ in range(n)]


def search(points: list[dict], score: Callable[[dict], float]) -> tuple[dict, float]:
    """The point with the largest score; of equal ones the first."""
    scored = [(score(p), -i) for i, p in enumerate(points)]
    best = max(scored)
    return points[-best[1]], best[0]


def bayesian_search(space: dict[str, tuple[float, float]], score: Callable[[dict], float], trials: int = 30, start: int = 5, gamma: float = 0.1, seed: int = 42) -> tuple[dict, float]:
    """Kernel-weighted mean as surrogate, distance to the nearest trial as uncertainty, upper bound as acquisition."""
    rng = random.Random(seed)
    unit = lambda p: [(p[k] - a) / ((b - a) or 1) for k, (a, b) in space.items()]
    tried = [(p, score(p)) for p in random_points(space, start, seed)]
    for _ in range(trials - start):
        def bound(p: dict) -> float:
            d = [math.dist(unit(p), unit(q)) for q, _ in tried]
            w = [math.exp(-(x * x) / gamma) + 1e-12 for x in d]
            return sum(a * s for a, (_, s) in zip(w, tried, strict=True)) / sum(w) + min(d)

        p = max(random_points(space, 200, rng.randrange(1 << 30)), key=bound)
        tried.append((p, score(p)))
    return max(tried, key=lambda x: x[1])


def successive_halving(points: list[dict], score: Callable[[dict, int], float], rounds: int = 3, eta: int = 3) -> dict:
    """Each round keeps the best 1 / eta of the points and gives the rest of the budget to them."""
    budget = 1
    for _ in range(rounds):
        points = sorted(points, key=lambda p: -score(p, budget))[: max(1, len(points) // eta)]
        budget *= eta
    return points[0]


def pareto_front(rows: DataFrame, key: str, objectives: list[str]) -> DataFrame:
    """Rows that no other is at least as good as in every objective and better in one (all maximised); see :mod:`.skyline`."""
    from . import skyline

    return skyline.pareto_front(rows, objectives).select(key, *objectives)


def early_stop(history: DataFrame, patience: int = 5, least: float = 0.0) -> DataFrame:
    """Of ``run, epoch, loss``: the epoch at which each run stops, ``patience`` after its last improvement."""
    upto = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.min("loss").over(upto), F.lit(math.inf))
    h = history.withColumn("improved", F.col("loss") < best - least)
    last = F.max(F.when(F.col("improved"), F.col("epoch"))).over(Window.partitionBy("run").orderBy("epoch"))
    h = h.withColumn("last", last)
    return h.groupBy("run").agg(F.coalesce(F.min(F.when(F.col("epoch") - F.col("last") >= patience, F.col("epoch"))), F.max("epoch")).alias("stopped_at"), F.min("loss").alias("best_loss"))


def rank_models(rows: DataFrame, performance: float = 0.6, time: float = 0.2, complexity: float = 0.2) -> DataFrame:
    """By weighted performance, and min-max scaled time and complexity (less is better)."""
    t = rows.agg(F.min("seconds").alias("t0"), F.max("seconds").alias("t1"), F.min("complexity").alias("c0"), F.max("complexity").alias("c1"))
    scaled = lambda c, a, b: F.coalesce(safe_div(F.col(c) - F.col(a), F.col(b) - F.col(a)), F.lit(0.0))
    total = performance * F.col("performance") + time * (1 - scaled("seconds", "t0", "t1")) + complexity * (1 - scaled("complexity", "c0", "c1"))
    return rows.join(F.broadcast(t)).select("model", total.alias("score")).orderBy(F.desc("score"), "model")


def similar_datasets(features: DataFrame, target: str, k: int = 10) -> DataFrame:
    """The k datasets nearest to ``target`` by min-max scaled features (``dataset`` and numeric columns)."""
    names = [c for c in features.columns if c != "dataset"]
    t = features.agg(*[F.min(c).alias(f"lo_{c}") for c in names], *[F.max(c).alias(f"hi_{c}") for c in names])
    z = features.join(F.broadcast(t)).select("dataset", F.array(*[F.coalesce(safe_div(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0)) for c in names]).alias("z"))
    from ..functions.expr import euclidean

    me = z.where(F.col("dataset") == target).select(F.col("z").alias("t"))
    return z.where(F.col("dataset") != target).join(F.broadcast(me)).select("dataset", (1 / (1 + euclidean(F.col("z"), F.col("t")))).alias("similarity")).orderBy(F.desc("similarity"), "dataset").limit(k)


def positional_encoding(df: DataFrame, position: str, dim: int) -> DataFrame:
    """Adds ``encoding``: sines and cosines of falling frequency."""
    p = F.col(position).cast("double")
    parts = [f(p / 10000 ** (2 * (i // 2) / dim)) for i in range(dim) for f in [F.sin if i % 2 == 0 else F.cos]]
    return df.withColumn("encoding", F.array(*parts))


def compact(series: DataFrame) -> DataFrame:
    """Lossy codes: seconds since the point before, and the value as one of 65536 steps of its range."""
    t = series.groupBy(KEY).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    delta = F.unix_seconds(F.col("ts").cast("timestamp")) - F.lag(F.unix_seconds(F.col("ts").cast("timestamp"))).over(by_index())
    code = F.round(65535 * F.coalesce(safe_div(val() - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))).cast("int")
    return series.join(t, KEY).withColumn("delta_s", delta).select(KEY, "idx", "delta_s", code.alias("code"), "lo", "hi")


def restore(codes: DataFrame) -> DataFrame:
    return codes.withColumn("value", F.col("lo") + F.col("code") / 65535 * (F.col("hi") - F.col("lo")))
