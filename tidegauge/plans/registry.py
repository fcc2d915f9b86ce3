"""A registry for analyses, sources and functions that users add."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Plugin:
    name: str
    kind: str
    run: Callable
    version: str = "1"
    enabled: bool = True


class Registry:
    """``kind`` is ``source`` (spark, **options -> frame), ``analysis`` (frame, **options -> frame) or ``function`` (a UDF for SQL)."""

    def __init__(self) -> None:
        self._plugins: dict[str, Plugin] = {}

    def add(self, plugin: Plugin, replace: bool = False) -> None:
        if plugin.name in self._plugins and not replace:
            raise ValueError(f"{plugin.name} is registered already")
        if plugin.kind not in ("source", "analysis", "function"):
            raise ValueError(f"no kind {plugin.kind}")
        self._plugins[plugin.name] = plugin

    def remove(self, name: str) -> bool:
        return self._plugins.pop(name, None) is not None

    def enable(self, name: str, on: bool = True) -> None:
        self._plugins[name].enabled = on

    def find(self, kind: str | None = None, text: str = "") -> list[Plugin]:
        return [p for _, p in sorted(self._plugins.items()) if (kind is None or p.kind == kind) and text in p.name]

    def _get(self, name: str, kind: str) -> Plugin:
        p = self._plugins.get(name)
        if p is None or p.kind != kind or not p.enabled:
            raise KeyError(f"no enabled {kind} {name}")
        return p

    def read(self, spark: SparkSession, name: str, **options) -> DataFrame:
        return self._get(name, "source").run(spark, **options)

    def analyze(self, df: DataFrame, name: str, **options) -> DataFrame:
        return self._get(name, "analysis").run(df, **options)

    def register_functions(self, spark: SparkSession) -> list[str]:
        """Make all enabled functions callable from SQL."""
        names = [p.name for p in self.find("function") if p.enabled]
        for n in names:
            spark.udf.register(n, self._plugins[n].run)
        return names
