"""Importing series from CSV, TSV, JSON and Parquet."""

from __future__ import annotations

import os
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import KEY

DELIMITERS = (",", ";", "\t", "|")
#: Parts of a header that mark the time column, in order of preference (fixed values).
TIME_NAMES = ("timestamp", "time", "datetime", "date", "created_at", "updated_at", "ts", "dt", "when", "occurred_at", "recorded_at", "unix_time")
#: Formats of times, tried in this order.
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "MM/dd/yyyy",
)
MISSING = ("", "null", "na", "nan")


def parse_time(c: Column) -> Column:
    """Whole numbers are epoch milliseconds above 10^12, else seconds; then the formats in order; null if none fits."""
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike(r"^-?\d+$"), F.expr("1")).isNotNull()
    whole = text.try_cast("long")
    epoch = F.when(F.abs(whole) > 10**12, F.timestamp_millis(whole)).otherwise(F.timestamp_seconds(whole))
    return F.when(number, epoch).otherwise(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS]))


def parse_value(c: Column, missing: float | None = None) -> Column:
    """Doubles; missing marks and what isn't a number become ``missing``."""
    text = F.lower(F.trim(c.cast("string")))
    v = F.when(~text.isin(*MISSING), text.try_cast("double"))
    return F.coalesce(F.nanvl(v, F.lit(None)), F.lit(missing).cast("double")) if missing is not None else F.nanvl(v, F.lit(None))


def sniff_csv(spark: SparkSession, path: str) -> tuple[str, bool]:
    """Delimiter (the most frequent in the first ten lines) and whether the first line is a header."""
    lines = [r.value for r in spark.read.text(path).limit(10).collect()]
    counts = Counter({d: sum(x.count(d) for x in lines) for d in DELIMITERS})
    delimiter = max(DELIMITERS, key=lambda d: counts[d])

    def numeric(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    header = bool(lines) and any(x.strip().strip('"') and not numeric(x.strip().strip('"')) for x in lines[0].split(delimiter))
    return delimiter, header


def time_column(columns: list[str]) -> str:
    low = {c: c.lower() for c in columns}
    return next((c for c in columns if any(n in low[c] for n in TIME_NAMES)), columns[0])


def _time_of(df: DataFrame, time: str | list[str] | None) -> Column:
    time = time or time_column(df.columns)
    if isinstance(time, str):
        return parse_time(F.col(f"`{time}`"))
    return parse_time(F.concat_ws(" ", *[F.col(f"`{c}`") for c in time]) if len(time) > 1 else F.col(f"`{time[0]}`"))


def to_long(df: DataFrame, time: str | list[str] | None = None, values: list[str] | None = None, missing: float | None = None) -> DataFrame:
    """A series for each value column; rows without a readable time go. ``time``: a column, or a date and a time column."""
    time = time or time_column(df.columns)
    parts = [time] if isinstance(time, str) else time
    names = values or [c for c in df.columns if c not in parts]
    ts = _time_of(df, parts)
    cells = F.array(*[F.struct(F.lit(c).alias(KEY), F.col(f"`{c}`").cast("string").alias("raw")) for c in names])
    rows = df.select(ts.alias("ts"), F.explode(cells).alias("cell")).where(F.col("ts").isNotNull())
    return rows.select(F.col(f"cell.{KEY}").alias(KEY), "ts", parse_value(F.col("cell.raw"), missing).alias("value"))


def take_rows(df: DataFrame, skip_rows: int = 0, max_rows: int | None = None, keep: Column | None = None) -> DataFrame:
    """Without the first ``skip_rows`` rows, then the first ``max_rows`` of those that ``keep`` holds for, in the order of reading.

    Each task gives no more than these numbers of row ids to find the two cuts.
    """
    at = F.col("__at")
    rows = df.withColumn("__at", F.monotonically_increasing_id())
    if skip_rows > 0:
        cut = rows.select("__at").orderBy("__at").limit(skip_rows).agg(F.max("__at")).scalar()
        rows = rows.where(at > cut)
    if max_rows is not None:
        rows = (rows if keep is None else rows.where(keep)).orderBy("__at").limit(max(0, max_rows))
    return rows.drop("__at")


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, header: bool | None = None, skip_rows: int = 0, max_rows: int | None = None, **options) -> DataFrame:
    """``skip_rows`` data rows are passed over; ``max_rows`` bounds the rows with a readable time."""
    if delimiter is None or header is None:
        found = sniff_csv(spark, path)
        delimiter, header = delimiter or found[0], found[1] if header is None else header
    df = spark.read.csv(path, sep=delimiter, header=header, inferSchema=False, mode="PERMISSIVE")
    if not header:
        df = df.toDF(*[f"column_{i}" for i in range(len(df.columns))])
    if skip_rows or max_rows is not None:
        df = take_rows(df, skip_rows, max_rows, _time_of(df, options.get("time")).isNotNull())
    return to_long(df, **options)


def read_json(spark: SparkSession, path: str, shape: str = "objects", **options) -> DataFrame:
    """``objects``: an array or lines of records; ``arrays``: one object of parallel arrays."""
    df = spark.read.option("multiLine", shape == "arrays" or not path.endswith("l")).json(path)
    if shape == "arrays":
        df = df.select(F.explode(F.arrays_zip(*df.columns)).alias("r")).select("r.*")
    return to_long(df, **options)


def read_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    return to_long(spark.read.parquet(path), **options)


def read_series(spark: SparkSession, path: str, **options) -> DataFrame:
    """By the file's ending: csv, tsv, txt, json, jsonl or parquet."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind in (".csv", ".txt"):
        return read_csv(spark, path, **options)
    if kind == ".tsv":
        return read_csv(spark, path, delimiter="\t", **options)
    if kind in (".json", ".jsonl"):
        return read_json(spark, path, **options)
    if kind == ".parquet":
        return read_parquet(spark, path, **options)
    raise ValueError(f"no reader for {kind or path}")


def import_statistics(df: DataFrame, time: str | None = None, values: list[str] | None = None) -> DataFrame:
    """Rows, rows without a readable time, and missing or unreadable values, in one pass."""
    time = time or time_column(df.columns)
    names = values or [c for c in df.columns if c != time]
    bad = [F.count_if(parse_value(F.col(f"`{c}`")).isNull()).alias(f"missing_{c}") for c in names]
    return df.agg(F.count("*").alias("n_rows"), F.count_if(parse_time(F.col(f"`{time}`")).isNull()).alias("n_bad_times"), *bad)
