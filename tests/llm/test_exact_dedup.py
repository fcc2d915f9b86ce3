import hashlib
import re
from collections import defaultdict

from tidegauge.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

SCHEMA = "doc_id long, text string, kept string, `a.b` int"
ROWS = [(1, "a b", "x", 1), (2, "ab", None, 2), (3, "a\tb \n", "y", 3), (4, None, None, None), (5, "", "z", 5), (6, "c", "q", 6), (None, "c ", None, 7), (7, "x" * 5000, "l", 8), (8, "x" * 5000, "l", 9), (9, "x" * 4999 + "y", "l", 9)]


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    out = {}
    for text, g in groups.items():
        best = sorted(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        for r in g:
            out[r[0]] = (best[0], len(g), r is best, hashlib.sha256(text.encode()).hexdigest())
    return out


def test_matches_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(df).collect()}
    assert found == {k: v[:3] for k, v in brute(ROWS).items()}


def test_kept_rows_have_all_columns(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = drop_exact_duplicates(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {k for k, v in brute(ROWS).items() if v[2]}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "t")] * 3 + [(2, "u")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(df).collect()) == [(1, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True), (2, 2, 1, True)]
    assert drop_exact_duplicates(df).count() == 2
    assert exact_duplicates(df.limit(0)).count() == 0 and drop_exact_duplicates(df.limit(0)).count() == 0
