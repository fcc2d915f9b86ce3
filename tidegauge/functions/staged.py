"""Tables written to the folder that the driver and all executors share, where a plan must not grow or run twice."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a local session without it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written and read back; the files go when the driver's Python ends, or by :func:`dropped`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    atexit.register(dropped, out)
    return out


def dropped(df: DataFrame) -> None:
    """Delete what :func:`staged` wrote; all that reads it must have run."""
    spark, path = df.sparkSession, getattr(df, "_staged_at", None)
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before
        pass
