"""Placing rows into shards by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` with u hashed from the key and the child's name, and the smallest
draw wins, so a child gets keys in proportion to its weight and a changed weight moves
keys only to or from the subtree that it belongs to. A shard added later stands in a
rack of the tree, but draws at the root with its own weight; a key that it wins goes
straight to it. If instead the ancestors' weights were raised, a key drawn into the
region could end in a shard that was there before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Rows that one task numbers within a shard.
ROWS_PER_RUN, LEAST_RUNS = 1_000_000, 16


@dataclass(frozen=True)
class ShardTree:
    """``weights[region][rack][i]`` are the weights of the shards, numbered in this order; ``added`` those that came later."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]
    added: tuple[float, ...] = field(default=())

    @staticmethod
    def uniform(shards: int, regions: int = 4, racks: int = 2) -> ShardTree:
        """``shards`` of weight 1, spread over at most ``regions`` x ``racks``."""
        if shards < 1:
            raise ValueError("a tree needs a shard")
        cut = lambda n, k: [n // k + (i < n % k) for i in range(min(n, k))]
        return ShardTree(tuple(tuple(tuple([1.0] * n) for n in cut(m, racks)) for m in cut(shards, regions)))

    def grown(self, weight: float = 1.0) -> ShardTree:
        """This tree with one more shard; it takes keys from all others in proportion and moves no other key."""
        return ShardTree(self.weights, (*self.added, weight))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region) + len(self.added)


def _draw(key: Column, *name: Column | int | str) -> Column:
    """An exponential variate of rate 1, fixed by key and name."""
    h = F.xxhash64(key, *[x if isinstance(x, Column) else F.lit(x) for x in name])
    return -F.log((F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0**-53))


def _least(scores: list[Column]) -> Column:
    return F.array_min(F.array(*[F.struct(s.alias("score"), F.lit(i).alias("child")) for i, s in enumerate(scores)]))["child"]


def with_shard(rows: DataFrame, key: str, tree: ShardTree, name: str) -> DataFrame:
    """``rows`` with the shard of the column ``key`` as int column ``name``. A null key is a key like others.

    Each level is a projection of its own, so that no draw is evaluated twice.
    """
    k, region, rack = F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("_region"), F.col("_rack")
    grid, deep, wide = tree.weights, max(len(r) for r in tree.weights), max(len(c) for r in tree.weights for c in r)

    def draws(level: str, parent: tuple[Column, ...], weights: list[Column]) -> list[Column]:
        return [F.when(w > 0, _draw(k, level, *parent, i) / w).otherwise(F.lit(math.inf)) for i, w in enumerate(weights)]

    at = lambda values, index: F.element_at(F.array(*[F.lit(float(v)) for v in values]), index + 1)
    cells = [r[i] if i < len(r) else () for r in grid for i in range(deep)]
    starts = [float(sum(map(len, cells[:i]))) for i in range(len(cells))]
    top = draws("region", (), [F.lit(float(sum(map(sum, r)))) for r in grid]) + draws("added", (), [F.lit(w) for w in tree.added])
    staged = rows.withColumn("_region", _least(top))
    staged = staged.withColumn("_added", region - len(grid)).withColumn("_region", F.least(region, F.lit(len(grid) - 1)))
    staged = staged.withColumn("_rack", _least(draws("rack", (region,), [at([sum(r[i]) if i < len(r) else 0 for r in grid], region) for i in range(deep)])))
    place = region * deep + rack
    staged = staged.withColumn("_leaf", _least(draws("shard", (region, rack), [at([c[i] if i < len(c) else 0 for c in cells], place) for i in range(wide)])))
    shard = F.when(F.col("_added") >= 0, F.col("_added") + sum(map(len, cells))).otherwise(at(starts, place) + F.col("_leaf"))
    return staged.select(*rows.columns, shard.cast("int").alias(name))


def shard_documents(docs: DataFrame, tree: ShardTree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of each row.

    The id and the number of shards decide the shard; equal texts with different ids
    may part. ``slot`` numbers the rows of a shard without gaps by (run, id, checksum,
    size). A shard is numbered in runs of about ``ROWS_PER_RUN`` rows, each begun where
    the runs before it end, so no task holds a whole shard. Null texts count as empty,
    null ids share one shard, repeated rows get a slot each.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.col(f"`{id_col}`").cast("long")
    runs = max(LEAST_RUNS, math.ceil(docs.count() / ROWS_PER_RUN / tree.shards))
    rows = docs.select(key.alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    rows = with_shard(with_shard(rows, "id", tree, "shard"), "id", tree.grown(), "grown_shard")
    rows = settle(rows.withColumn("run", F.pmod(F.xxhash64("row", F.lit("run")), F.lit(runs))), "sharding")
    ends = rows.groupBy("shard", "run").count()
    begins = ends.select("shard", "run", (F.sum("count").over(Window.partitionBy("shard").orderBy("run")) - F.col("count")).alias("begin"))
    within = F.row_number().over(Window.partitionBy("shard", "run").orderBy("id", "text_crc32", "size", "row")) - 1
    return (
        rows.withColumn("within", within)
        .join(begins, ["shard", "run"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("begin") + F.col("within")).cast("long").alias("slot"), "grown_shard")
    )
