import base64
import gzip
import hashlib

import pytest

from tidegauge.llm import warc

PAGES = [(1, "http://a.org/x?q", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "no scheme\r\nX: y", ""), (4, "http://b.org", None), (5, "http://c.org", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (None, "http://d.org", "z"), (7, "http://e.org", "x" * 300000), (8, "u", "<p>é</p>")]


def brute(rows):
    out = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        first = min(same, default=None)
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out[page_id] = (len(body), sha, *(("response", None) if page_id == first or page_id is None else ("revisit", first)))
    return out


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, "c") for r in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_captures(spark, path).collect()}
    assert got == brute(PAGES)
    files = list((tmp_path / "w").glob("part-*"))
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Type: metadata") for f in files) == len(PAGES)


def test_every_revisit_refers_to_a_record(spark, tmp_path):
    rows = [*PAGES, (2, "u", "<p>é</p>"), (1, "u", "<p>é</p>"), (5, "v", PAGES[4][2]), (9, "v", "z"), (None, "w", "z"), (None, "w", "only null ids"), (None, "x", "only null ids")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), f"file://{tmp_path}/w")
    records = warc.read_records(spark, f"file://{tmp_path}/w").select("record_id", "record_type", "refers_to").collect()
    responses = {r.record_id for r in records if r.record_type == "response"}
    refers = [r.refers_to for r in records if r.record_type == "revisit"]
    assert len(refers) == 6 and all(x in responses for x in refers)
    assert len({r.record_id for r in records}) == len(records) == 3 * len(rows)


@pytest.mark.parametrize("parts", [2, 7])
def test_revisits_of_tied_rows_refer_to_a_record(spark, tmp_path, parts):
    rows = [(k, f"http://h{k * 31 % 17}.org/{c}", f"payload {k}") for k in range(40) for c in range(3)] + [(100 + k, "u", f"payload {k}") for k in range(40)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts), f"file://{tmp_path}/w")
    records = warc.read_records(spark, f"file://{tmp_path}/w").select("record_id", "record_type", "refers_to").collect()
    responses = {r.record_id for r in records if r.record_type == "response"}
    refers = [r.refers_to for r in records if r.record_type == "revisit"]
    assert len(responses) == 120 and len(refers) == 40 and set(refers) <= responses
    assert len({r.record_id for r in records}) == len(records) == 3 * len(rows)


def test_nested_rows_lose_no_record(spark):
    rows = [("<r1>", "response", None, 1), ("<q1>", "request", "<r1>", 2), ("<q2>", "request", "<r1>", 3), ("<m1>", "metadata", "<gone>", 4), ("<i>", "warcinfo", None, 5), ("<r2>", "revisit", None, 6), ("<q3>", "request", None, 7)]
    records = spark.createDataFrame(rows, "record_id string, record_type string, concurrent_to string, response int")
    nested = {r.capture_id: r for r in warc.assemble_transactions(records).collect()}
    assert set(nested) == {"<r1>", "<r2>"}
    assert nested["<r1>"].request.record_id == "<q1>" and nested["<r1>"].n_requests == 2 and nested["<r1>"].n_metadata == 0 and nested["<r2>"].request is None
    assert {r.record_id for r in warc.unassembled(records).collect()} == {"<q2>", "<m1>", "<i>", "<q3>"}


def test_ties_are_all_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "t")] * 2 + [(2, "u", "t")], "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.page_captures(spark, f"file://{tmp_path}/w").collect()) == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_least_bytes_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/a", least_bytes=5)
    assert {r.page_id for r in warc.page_captures(spark, f"file://{tmp_path}/a").collect() if r.record_type == "revisit"} == {2, 8}
    warc.write_archives(df.limit(0), f"file://{tmp_path}/b")
    assert warc.page_captures(spark, f"file://{tmp_path}/b").count() == 0


def test_broken_archives_raise(tmp_path):
    with pytest.raises(ValueError):
        list(warc._parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", "x"))
    with pytest.raises(ValueError):
        list(warc._parse(b"junk", "x"))
    with pytest.raises(ValueError):
        warc._inflate(gzip.compress(b"abc")[:-5])
