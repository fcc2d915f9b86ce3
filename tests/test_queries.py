"""A selection of queries against their SQL in DuckDB, and the contract of the entry module."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from tidegauge.plans import oracles

SF = "/root/testdata/sf0.001"
NAMES = ["flagship", "describe", "rolling", "linear_fill", "gaps", "histogram", "anomaly_iqr", "detect_anomalies", "temporal_clusters", "longest_runs", "autocorrelation", "cross_correlation", "correlation_spearman", "rolling_correlation", "seasonal_strength", "effect_month", "cusum", "forecast_seasonal_naive", "clean_linear", "distance_cosine", "pareto_front", "persistence", "compact", "parse_times", "sliding_windows",
         "kernel_density", "qq_points", "shapiro_wilk", "anomaly_volatility", "anomaly_seasonal_context", "ensemble_vote", "trend_summary", "mann_kendall", "decompose_multiplicative", "stl", "correlation_tests", "rolling_spearman", "acf_periods", "pattern_consistency", "evolving_strength", "effect_easter", "effect_holidays", "kpss_trend", "quality_scores", "quality_trend", "stream_modified_zscore", "session_windows", "standardized_moments", "seasonal_patterns", "sens_slope"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.7g}"
    if hasattr(v, "tzinfo") and v is not None:
        return str(v.replace(tzinfo=None))
    return None if v is None else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want


def test_sql_has_its_query():
    assert set(oracles.SQL) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_names_need_no_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=os.path.dirname(__spark_entry__.__file__), capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-500:]
