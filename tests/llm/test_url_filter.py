import pytest
from pyspark.sql import functions as F

from tidegauge.llm.queries import BLOCKED_HOSTS, RULES
from tidegauge.llm.url_filter import Cascade, host_cascade, judge_urls


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        ends = [rest.find(c) for c in "/?#" if c in rest]
        cut = min(ends, default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.key))
        return host, path, best.key, best.verdict
    return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in BLOCKED_HOSTS) else "allow"


URLS = [None, "", "no scheme", "http://", "http://org", "http://a.org/", "HTTP://WWW.Example.ORG/es/x", "http://example.org/en/1", "http://example.org/en/12#f", "http://example.org/en/2?q=/es/", "http://notexample.org/es/", "x://a.com/fr/", "x://a.com/de/y", "x://com/de/", "x://a.com/dex",
        "http://cheap-pills.example.com/en/", "http://www.cheap-pills.example.com/fr/1", "http://a.b://c.org/x", "http://.org/", "http://org./", "http://É.COM/de/", "http://x.com\n/de/", "http://example.org?x/es/", "http://" + "a." * 3000 + "org/" + "p" * 5000, "http://casino.example.net"]


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(i, u, "clash", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, RULES, BLOCKED_HOSTS).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}
    assert judge_urls(df.limit(0), RULES, BLOCKED_HOSTS).count() == 0


@pytest.mark.parametrize("step", [37, 2])
def test_cascade_is_exact_over_its_universe(spark, step):
    universe = spark.range(60000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where(f"cast(substr(key, 2) as int) % {step} = 1")
    cascade = Cascade(listed, universe)
    assert len(cascade.levels) >= 2
    rows = cascade.beside(universe, "w").select("key", cascade.member(F.col("key"), "w").alias("m")).collect()
    assert all(r.m == (int(r.key[1:]) % step == 1) for r in rows)


def test_the_query_builds_several_levels(spark):
    from tidegauge.llm.queries import blocked_hosts

    cascade, _ = host_cascade(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), blocked_hosts(spark))
    assert len(cascade.levels) >= 2


def test_levels_of_several_arrays(spark, monkeypatch):
    monkeypatch.setattr("tidegauge.llm.url_filter.MOST_LOG2", 12)
    universe = spark.range(9000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = Cascade(universe.where("cast(substr(key, 2) as int) % 3 = 1"), universe)
    assert len(cascade.levels[0].parts) > 1
    rows = cascade.beside(universe, "w").select("key", cascade.member(F.col("key"), "w").alias("m")).collect()
    assert all(r.m == (int(r.key[1:]) % 3 == 1) for r in rows)


def test_an_empty_list_has_no_members(spark):
    universe = spark.createDataFrame([("a",), (None,)], "key string")
    cascade = Cascade(universe.limit(0), universe)
    assert [r.m for r in cascade.beside(universe, "w").select(cascade.member(F.col("key"), "w").alias("m")).collect()] == [False, False]
