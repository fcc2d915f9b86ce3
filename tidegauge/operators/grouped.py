"""Running a NumPy function on each series: recurrences, dynamic programmes and dense algebra.

A series is one task's work and is held whole; everything that grouped sums or windows
can express lives in the other modules.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .series import KEY, valid


def per_series(series: DataFrame, fn: Callable[[np.ndarray, np.ndarray], dict], schema: str, least: int = 1) -> DataFrame:
    """``fn(values, idx)`` gives columns (arrays or scalars) of each series with at least ``least`` finite values."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x, idx = pdf["value"].to_numpy(float), pdf["idx"].to_numpy(np.int64)
        if len(x) < least:
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in [KEY, *names]})
        out = fn(x, idx)
        size = max([len(v) for v in out.values() if isinstance(v, (np.ndarray, list))] or [1])
        return pd.DataFrame({KEY: np.array([key[0]] * size, object), **{n: out[n] if isinstance(out[n], (np.ndarray, list)) else [out[n]] * size for n in names}})

    return valid(series).select(KEY, "idx", "value").groupBy(KEY).applyInPandas(run, f"{KEY} string, {schema}")


def autocorrelations(x: np.ndarray, lags: int) -> np.ndarray:
    """r of lags 0 to ``lags``, covariances over n; zeros for a constant."""
    d = x - x.mean()
    v = (d * d).sum()
    return np.array([1.0] + [float((d[: len(d) - k] * d[k:]).sum() / v) if v else 0.0 for k in range(1, lags + 1)])


def least_squares(design: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, their standard errors, residuals."""
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    r = y - design @ beta
    mse = (r * r).sum() / max(1, len(y) - design.shape[1])
    return beta, np.sqrt(np.maximum(0, mse * np.diag(np.linalg.pinv(design.T @ design)))), r
