"""Running totals, fills and differences of series whose rows are in many tasks.

A window by series sorts a series in one task. Here rows are dealt by ranges of (series, time), so a long series
has many blocks and short ones share a block. Three steps follow: a total of each block, the
running total of the blocks before it (a few rows for each series), and the
running total within the block, to which that of the blocks before is added. The
result is that of the window, and no task has more than a block.

The dealt rows are staged once, so that blocks stay what they are when executors are lost.
Rows without a time go, as with :func:`.series.canonicalize`; times are meant to be unique within a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from ..functions.staged import staged
from .series import KEY
from .windows import _known

BLOCK_KEY = ["block", KEY]


def dealt(series: DataFrame, blocks: int | None = None) -> DataFrame:
    """Rows with their ``block``: ranges of (series, time) of about equal size, as many as shuffle partitions unless given."""
    rows = series.where(F.col("ts").isNotNull())
    n = blocks or max(2, int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return staged(rows.repartitionByRange(n, KEY, "ts").withColumn("block", F.spark_partition_id()))


def _forward() -> Window:
    return Window.partitionBy(*BLOCK_KEY).orderBy("ts")


def running(rows: DataFrame, **columns: tuple[str, Column]) -> DataFrame:
    """Adds columns to dealt rows; each is a kind and what it runs over, in time order of each series.

    ``sum``, ``min`` and ``max`` up to a row; ``last``: the last value up to it that isn't null; ``next``: the first from it on; ``before``: that of the row before, null or not.
    """
    rows = rows.withColumns({f"_x_{name}": c for name, (_, c) in columns.items()})
    totals, carried, local = [], [], {}
    past = Window.partitionBy(KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = _forward().rowsBetween(Window.unboundedPreceding, 0)
    # what follows is what precedes in the other order: Spark computes a frame that ends with the partition anew for each row
    later = Window.partitionBy(KEY).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*BLOCK_KEY).orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    for name, (kind, _) in columns.items():
        x, total, before = F.col(f"_x_{name}"), F.col(f"_t_{name}"), F.col(f"_c_{name}")
        has = F.when(x.isNotNull(), F.col("ts"))
        if kind in ("sum", "min", "max"):
            agg = {"sum": F.sum, "min": F.min, "max": F.max}[kind]
            totals.append(agg(x).alias(f"_t_{name}"))
            carried.append(agg(total).over(past).alias(f"_c_{name}"))
            here = agg(x).over(upto)
            join = {"sum": F.coalesce(here + before, here, before), "min": F.least(here, before), "max": F.greatest(here, before)}[kind]
            local[name] = join
        elif kind == "last":
            totals.append(F.max_by(x, has).alias(f"_t_{name}"))
            carried.append(F.last(total, True).over(past).alias(f"_c_{name}"))
            local[name] = F.coalesce(F.last(x, True).over(upto), before)
        elif kind == "next":
            totals.append(F.min_by(x, has).alias(f"_t_{name}"))
            carried.append(F.last(total, True).over(later).alias(f"_c_{name}"))
            local[name] = F.coalesce(F.last(x, True).over(onward), before)
        elif kind == "before":
            totals.append(F.max_by(F.struct(x.alias("v")), "ts").alias(f"_t_{name}"))
            carried.append(F.lag(total).over(Window.partitionBy(KEY).orderBy("block")).alias(f"_c_{name}"))
            local[name] = F.when(F.row_number().over(_forward()) == 1, before["v"]).otherwise(F.lag(x).over(_forward()))
        else:
            raise ValueError(kind)
    blocks = rows.groupBy(*BLOCK_KEY).agg(*totals).select(*BLOCK_KEY, *carried)
    blocks = blocks.withColumnsRenamed({"block": "_block", KEY: "_of"})
    out = rows.join(blocks, (F.col("block") == F.col("_block")) & F.col(KEY).eqNullSafe(F.col("_of"))).drop("_block", "_of")
    out = out.withColumns(local)
    return out.drop(*[f"{p}{name}" for name in columns for p in ("_x_", "_c_")])


def with_index(rows: DataFrame) -> DataFrame:
    """``idx`` and ``vidx`` of dealt rows, as :func:`.series.with_index` gives them."""
    has = F.col("value").isNotNull()
    out = running(rows, idx=("sum", F.lit(1).cast("long")), vidx=("sum", has.cast("long")))
    return out.withColumns({"idx": F.col("idx") - 1, "vidx": F.when(has, F.col("vidx") - 1)})


def forward_fill(rows: DataFrame) -> DataFrame:
    return running(rows, filled=("last", _known(F.col("value"))))


def backward_fill(rows: DataFrame) -> DataFrame:
    return running(rows, filled=("next", _known(F.col("value"))))


def linear_fill(rows: DataFrame) -> DataFrame:
    """Interior gaps on the line between their neighbours, by index (``idx`` is needed)."""
    v = _known(F.col("value"))
    point = F.when(v.isNotNull(), F.struct(F.col("idx").cast("double").alias("at"), v.alias("v")))
    t = running(rows, _a=("last", point), _b=("next", point))
    a, b = F.col("_a"), F.col("_b")
    line = a["v"] + (b["v"] - a["v"]) * safe_div(F.col("idx") - a["at"], b["at"] - a["at"])
    return t.withColumn("filled", F.coalesce(_known(F.col("value")), line)).drop("_a", "_b")


def differences(rows: DataFrame) -> DataFrame:
    """``difference`` from the row before."""
    return running(rows, _p=("before", F.col("value"))).withColumn("difference", F.col("value") - F.col("_p")).drop("_p")


def cusum(rows: DataFrame, drift: float = 0.5, limit: float = 4.0) -> DataFrame:
    """Both one-sided sums of each point, as :func:`.stationarity.cusum` gives them: prefix sums less their running minima."""
    v = F.col("value")
    rows = rows.where(v.isNotNull() & (F.abs(v) != F.lit(float("inf"))))
    t = rows.groupBy(KEY).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").alias("n"))
    away = v - F.col("m")
    sums = running(rows.join(t, KEY), p_up=("sum", away - drift * F.col("s")), p_down=("sum", -away - drift * F.col("s")))
    least = running(sums, l_up=("min", F.col("p_up")), l_down=("min", F.col("p_down")))
    for name in ("up", "down"):
        least = least.withColumn(name, F.col(f"p_{name}") - F.least(F.lit(0.0), F.col(f"l_{name}")))
    alarm = (F.greatest("up", "down") > limit * F.col("s")) & (F.col("s") > 0) & (F.col("n") >= 10)
    return least.select(KEY, "idx", "ts", "value", "up", "down", alarm.alias("alarm"))
