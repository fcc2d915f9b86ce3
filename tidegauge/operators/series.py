"""The long table of series, ``(series_id, ts, value)``, and what turns other tables into it.

A missing value is NULL; NaN becomes NULL on the way in and infinities stay. ``idx``
numbers the rows of a series from 0 in time order and ``vidx`` those with a value. The
window of one series runs in one task, so the longest series bounds a task's size;
per-series totals are grouped and joined back rather than kept in window buffers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEY = "series_id"


def ordered() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy("ts")


def by_index() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy("idx")


def val() -> Column:
    return F.col("value")


def place() -> Column:
    return F.col("idx").cast("double")


def to_series(df: DataFrame, key: str | None, ts: str, value: str | Column) -> DataFrame:
    """A series for each value of ``key`` (one named ``all`` without it)."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return df.select((F.col(key).cast("string") if key else F.lit("all")).alias(KEY), F.col(ts).alias("ts"), F.nanvl(v, F.lit(None)).alias("value"))


def canonicalize(series: DataFrame) -> DataFrame:
    """One row for each time: values of equal times are averaged, missing ones left out. Rows without a time go."""
    return series.where(F.col("ts").isNotNull()).groupBy(KEY, "ts").agg(F.avg("value").alias("value"))


def with_index(series: DataFrame) -> DataFrame:
    """Adds ``idx``, and ``vidx``, null where the value is."""
    has = F.col("value").isNotNull()
    n = F.count_if(has).over(ordered().rowsBetween(Window.unboundedPreceding, 0)) - 1
    return series.withColumns({"idx": (F.row_number().over(ordered()) - 1).cast("long"), "vidx": F.when(has, n).cast("long")})


def indexed(df: DataFrame, key: str | None, ts: str, value: str | Column) -> DataFrame:
    return with_index(canonicalize(to_series(df, key, ts, value)))


def valid(series: DataFrame) -> DataFrame:
    """Rows with a finite value; ``idx`` stays that of the whole series."""
    v = F.col("value")
    return series.where(v.isNotNull() & (F.abs(v) != F.lit(float("inf"))))


def with_totals(series: DataFrame, *totals: Column, by: tuple[str, ...] = (KEY,), of: DataFrame | None = None) -> DataFrame:
    """Adds grouped totals of ``of`` (or of ``series``) to each row."""
    return series.join((of if of is not None else series).groupBy(*by).agg(*totals), list(by))


def time_slice(series: DataFrame, start, end) -> DataFrame:
    """Both ends included; the series gets the suffix ``_slice``."""
    return series.where(F.col("ts").between(F.lit(start), F.lit(end))).withColumn(KEY, F.concat(KEY, F.lit("_slice")))


def push_points(series: DataFrame, points: DataFrame) -> DataFrame:
    """Adds the points whose time the series doesn't have yet."""
    new = points.join(series.select(KEY, "ts"), [KEY, "ts"], "left_anti")
    return series.select(KEY, "ts", "value").unionByName(new.select(KEY, "ts", "value"))


def remove_at(series: DataFrame, index: int) -> DataFrame:
    return with_index(series.where(F.col("idx") != index).select(KEY, "ts", "value"))


def check_strictly_ascending(series: DataFrame) -> DataFrame:
    """The rows whose time isn't after the one before; none in a canonical series."""
    before = F.lag("ts").over(by_index())
    return series.withColumn("before", before).where(F.col("ts") <= F.col("before"))


def summary(series: DataFrame) -> DataFrame:
    """Count, missing, mean, median, extremes and population variance of each series."""
    v = F.col("value")
    return series.groupBy(KEY).agg(
        F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_missing"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("std"),
    )


def infer_frequency(series: DataFrame) -> DataFrame:
    """``frequency`` of each series from the mean of its first nine intervals, null with fewer than two points."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(by_index())
    first = series.withColumn("gap", gap).where(F.col("idx") <= 9).groupBy(KEY).agg(F.avg("gap").alias("g"))
    s, ms = F.floor(F.col("g") / 1e6), F.floor(F.col("g") / 1e3)
    name = F.when(F.col("g").isNull(), None)
    for seconds, word in ((1, "second"), (60, "minute"), (3600, "hour"), (86400, "day"), (604800, "week")):
        name = name.when(s == seconds, word)
    name = name.when(s > 0, F.concat(F.lit("custom_"), s.cast("string"), F.lit("s"))).when(ms <= 0, "microsecond").when(ms == 1, "millisecond")
    return first.select(KEY, name.otherwise(F.concat(F.lit("custom_"), ms.cast("string"), F.lit("ms"))).alias("frequency"), (F.col("g") / 1e6).alias("mean_interval_s"))


def align_on_time(a: DataFrame, b: DataFrame) -> DataFrame:
    """``ts``, ``x`` and ``y`` at the times that two series share."""
    return a.select("ts", F.col("value").alias("x")).join(b.select("ts", F.col("value").alias("y")), "ts")


def value_counts_filter(df: DataFrame, column: str, op: str, value=None) -> DataFrame:
    """Rows by one of the predicates of a data source's query."""
    c = F.col(column)
    tests = {
        "eq": lambda: c == value, "ne": lambda: c != value, "gt": lambda: c > value, "ge": lambda: c >= value, "lt": lambda: c < value, "le": lambda: c <= value,
        "contains": lambda: c.contains(value), "starts_with": lambda: c.startswith(value), "ends_with": lambda: c.endswith(value),
        "in": lambda: c.isin(*value), "not_in": lambda: ~c.isin(*value), "is_null": lambda: c.isNull(), "is_not_null": lambda: c.isNotNull(),
    }
    return df.where(tests[op]())
