"""A store of series as Parquet partitions, with metadata, a result cache and run metrics.

Layout below the root: ``data`` (partitioned by series), ``meta``, ``cache`` and
``metrics``. Every change is an append; reads take the newest row of a key.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.series import KEY


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    _SCHEMAS = {
        "data": "ts timestamp, value double, stored double, series_id string",
        "meta": "series_id string, n long, start timestamp, end timestamp, deleted boolean, at double",
        "cache": "key string, kind string, result string, expires double, at double",
        "metrics": "operation string, seconds double, n_rows long, ok boolean, at double",
    }

    def _read(self, name: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self._SCHEMAS[name])
        return self.spark.read.schema(self._SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def _newest(self, name: str, key: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(F.desc("at"))
        return self._read(name).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

    def list_series(self) -> DataFrame:
        return self._newest("meta", KEY).where("not deleted").select(KEY, "n", "start", "end").orderBy(KEY)

    def store(self, series: DataFrame) -> None:
        """Fails if a series of that name is stored already."""
        if taken := [r[0] for r in series.select(KEY).distinct().join(self.list_series(), KEY, "left_semi").limit(5).collect()]:
            raise ValueError(f"already stored: {', '.join(taken)}")
        now = time.time()
        rows = series.select(F.col("ts").cast("timestamp").alias("ts"), "value", F.lit(now).alias("stored"), KEY)
        rows.repartition(KEY).sortWithinPartitions(KEY, "ts").write.mode("append").partitionBy(KEY).parquet(f"{self.root}/data")
        meta = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))
        meta.withColumns({"deleted": F.lit(False), "at": F.lit(now)}).write.mode("append").parquet(f"{self.root}/meta")

    def delete(self, name: str) -> bool:
        """Whether there was such a series."""
        row = self.list_series().where(F.col(KEY) == name).first()
        if row is None:
            return False
        gone = self.spark.createDataFrame([(name, 0, None, None, True, time.time())], self._SCHEMAS["meta"])
        gone.write.mode("append").parquet(f"{self.root}/meta")
        return True

    def load(self, name: str, start=None, end=None) -> DataFrame:
        """Points in time order, of a closed range if one is given; the partition filter reaches the scan."""
        live = self._newest("meta", KEY).where("not deleted").select(KEY, "at")
        rows = self._read("data").where(F.col(KEY) == name).join(live, KEY).where("stored = at").select(KEY, "ts", "value")
        if start is not None:
            rows = rows.where(F.col("ts") >= F.lit(start))
        if end is not None:
            rows = rows.where(F.col("ts") <= F.lit(end))
        return rows.orderBy("ts")

    @staticmethod
    def key(kind: str, parameters: dict) -> str:
        return hashlib.sha256(f"{kind}:{sorted(parameters.items())}".encode()).hexdigest()

    def cache_result(self, kind: str, parameters: dict, result: DataFrame, seconds: float = 3600.0) -> None:
        """Keeps a small result (one JSON document per row) until it expires; a later one replaces it."""
        now = time.time()
        rows = result.select(F.to_json(F.struct("*")).alias("result")).agg(F.to_json(F.collect_list("result")).alias("result"))
        rows.select(F.lit(self.key(kind, parameters)).alias("key"), F.lit(kind).alias("kind"), "result", F.lit(now + seconds).alias("expires"), F.lit(now).alias("at")).write.mode("append").parquet(f"{self.root}/cache")

    def cached(self, kind: str, parameters: dict, schema: str) -> DataFrame | None:
        rows = self._newest("cache", "key").where((F.col("key") == self.key(kind, parameters)) & (F.col("expires") > time.time()))
        if rows.isEmpty():
            return None
        return rows.select(F.explode(F.from_json("result", "array<string>")).alias("r")).select(F.from_json("r", schema).alias("r")).select("r.*")

    def record(self, operation: str, seconds: float, n_rows: int, ok: bool = True) -> None:
        self.spark.createDataFrame([(operation, float(seconds), n_rows, ok, time.time())], self._SCHEMAS["metrics"]).write.mode("append").parquet(f"{self.root}/metrics")

    def metrics(self, operation: str | None = None, most: int = 100) -> DataFrame:
        rows = self._read("metrics")
        return (rows.where(F.col("operation") == operation) if operation else rows).orderBy(F.desc("at")).limit(most)
