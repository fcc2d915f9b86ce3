import json

import pytest

from tidegauge.plans import compose
from tidegauge.plans.registry import Plugin, Registry
from tidegauge.sources import readers, synthetic, writers
from tidegauge.sources.catalog import Catalog


def test_csv_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("when;v;w\n2024-01-01 00:00:00;1;na\n2024-01-01T01:00:00Z;x;2\nbad;3;4\n1704074400;5;\n1704078000000;6;7\n")
    path = f"file://{tmp_path}/a.csv"
    assert readers.sniff_csv(spark, path) == (";", True)
    rows = sorted((r.series_id, str(r.ts), r.value) for r in readers.read_series(spark, path).collect())
    assert [r[2] for r in rows if r[0] == "v"] == [1.0, None, 5.0, 6.0] and [r[1] for r in rows if r[0] == "v"] == [f"2024-01-01 0{h}:00:00" for h in range(4)]
    stats = readers.import_statistics(spark.read.csv(path, sep=";", header=True)).first()
    assert (stats.n_rows, stats.n_bad_times, stats.missing_v, stats.missing_w) == (5, 1, 1, 2)


def test_headerless_file_keeps_its_first_row(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("1704067200\t1\n1704067260\t2\n")
    rows = readers.read_series(spark, f"file://{tmp_path}/b.tsv").collect()
    assert sorted(r.value for r in rows) == [1.0, 2.0] and {r.series_id for r in rows} == {"column_1"}


def test_json_shapes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"ts": "2024-01-01 00:00:00", "v": 1}\n{"ts": "2024-01-02 00:00:00", "v": null}\n')
    (tmp_path / "b.json").write_text(json.dumps({"ts": ["2024-01-01 00:00:00", "2024-01-02 00:00:00"], "v": [1, 2]}))
    assert sorted(r.value or 0 for r in readers.read_series(spark, f"file://{tmp_path}/a.jsonl").collect()) == [0, 1.0]
    assert sorted(r.value for r in readers.read_series(spark, f"file://{tmp_path}/b.json", shape="arrays").collect()) == [1.0, 2.0]
    with pytest.raises(ValueError):
        readers.read_series(spark, "x.xlsx")


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    s = synthetic.sine(spark, 48)
    c.store(s)
    with pytest.raises(ValueError):
        c.store(s)
    assert [r.series_id for r in c.list_series().collect()] == ["sine"] and c.load("sine").count() == 48
    first = c.load("sine").first()
    assert c.load("sine", first.ts, first.ts).count() == 1
    assert c.delete("sine") and not c.delete("sine") and c.load("sine").count() == 0
    c.store(synthetic.linear(spark, 5).withColumn("series_id", s["series_id"] if False else __import__("pyspark").sql.functions.lit("sine")))
    assert c.load("sine").count() == 5
    c.cache_result("k", {"a": 1}, spark.range(3))
    assert sorted(r.id for r in c.cached("k", {"a": 1}, "id long").collect()) == [0, 1, 2] and c.cached("k", {"a": 2}, "id long") is None
    c.cache_result("k", {"a": 1}, spark.range(3), seconds=-1)
    assert c.cached("k", {"a": 1}, "id long") is None
    c.record("op", 0.5, 10)
    assert c.metrics("op").count() == 1 and c.metrics("other").count() == 0


def test_exports_and_report(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.23456, None), ('q"x', 2.0, 3)], "n string, v double, k int")
    assert writers.render(df, "csv").splitlines()[1:] == ["a|b,1.2346,", '"q""x",2.0000,3']
    assert "a\\|b" in writers.render(df) and "<td>a|b</td>" in writers.render(df, "html") and json.loads(writers.render(df, "json"))[0]["v"] == 1.2346
    writers.export(df, str(tmp_path / "x.txt"), "text")
    assert "1.2346" in (tmp_path / "x.txt").read_text()
    with pytest.raises(ValueError):
        writers.render(spark.range(20), most=5)


def test_registry_and_profiles(spark):
    r = Registry()
    r.add(Plugin("twice", "analysis", lambda df, n=2: df.selectExpr(f"id * {n} AS id")))
    r.add(Plugin("numbers", "source", lambda spark, n: spark.range(n)))
    with pytest.raises(ValueError):
        r.add(Plugin("twice", "analysis", print))
    assert [x.id for x in r.analyze(r.read(spark, "numbers", n=3), "twice").collect()] == [0, 2, 4]
    r.enable("twice", False)
    with pytest.raises(KeyError):
        r.analyze(spark.range(1), "twice")
    assert r.remove("twice") and not r.remove("twice")
    assert all(p.validated() for p in compose.PROFILES.values())
    with pytest.raises(ValueError):
        compose.Profile(horizon=0, anomaly="none").validated()


def test_synthetic(spark):
    walk = synthetic.random_walk(spark, 50).orderBy("ts").collect()
    assert len(walk) == 50
    a, b = (synthetic.autoregressive(spark, 200, seed=1).orderBy("ts").collect() for _ in range(2))
    assert [r.value for r in a] == [r.value for r in b]
    rows = synthetic.correlated_pair(spark, 500, 0.9)
    assert rows.count() == 1000


def test_csv_skips_and_bounds_rows(spark, tmp_path):
    lines = ["time,v", *[f"2024-01-{i:02d} 00:00:00,{i}" for i in range(1, 10)]]
    lines[4] = "unreadable,4"
    path = tmp_path / "rows.csv"
    path.write_text("\n".join(lines))
    got = lambda **o: sorted(r.value for r in readers.read_csv(spark, str(path), **o).collect())
    assert got(skip_rows=2) == [3, 5, 6, 7, 8, 9]
    assert got(skip_rows=2, max_rows=3) == [3, 5, 6]
    assert got(max_rows=0) == [] and got(skip_rows=50) == [] and len(got()) == 8
