"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import bit_array, bit_is_set

#: The characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
#: log2 of the bits that mark rows which a join may drop.
MARK_BITS = 22
#: Rows and bytes of an Arrow batch.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by the driver and all executors. Without one, a local folder serves a local session; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver's Python ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before
        pass


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of a few megabytes for what is written inside, so that rows of texts and sets don't fill a Python worker."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It runs once, its lineage ends there, and what it numbered (row ids, partitions)
    stays as it is when executors are lost later.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete what :func:`settle` wrote; all that reads the tables must be written already."""
    for df in tables:
        path = getattr(df, "_settled_at", None) if df is not None else None
        if path:
            _remove(df.sparkSession, path)


def rows_without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, others: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id, hash of the text and ``others`` aren't in ``gone`` (``id``, ``text_hash``, ``other0``, ...).

    Hashes of ``gone`` are marked in a bit array of fixed size, so only rows that are marked are shuffled.
    """
    spot = lambda c: F.col(c).bitwiseAND((1 << MARK_BITS) - 1)
    marks = bit_array(gone.select(spot("text_hash").alias("p")), MARK_BITS).scalar()
    keys = {"id": F.col(f"`{id_col}`").cast("long"), "text_hash": F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))}
    keys |= {f"other{k}": F.col(f"`{c}`").cast("string") for k, c in enumerate(others)}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[c.alias(k) for k, c in keys.items()])
    rows, gone = rows.withColumn("marked", bit_is_set(marks, spot("text_hash"))), gone.select([F.col(k).alias(f"gone_{k}") for k in keys])
    same = F.col("text_hash") == F.col("gone_text_hash")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"gone_{k}"))
    stay = rows.where("marked").join(gone, same, "left_anti")
    return rows.where("not marked").select("doc.*").unionByName(stay.select("doc.*"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def without_blanks(text: Column) -> Column:
    """One ``replace`` for each blank: with ``translate`` in its place executors took some hundred MB more heap."""
    text = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text
