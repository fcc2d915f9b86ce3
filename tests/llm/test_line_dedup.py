import random
import re
import shutil
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import line_dedup
from tidegauge.llm.cuckoo import CuckooFilter
from tidegauge.llm.line_dedup import LineIndex, drop_shared_lines

SCHEMA = "doc_id long, text string, n long, doc string, gone int"


def key(line):
    k = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)


def brute(rows, min_chars=10):
    order = lambda i: (i is None, i or 0)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(held[key(x)]) < 2 or min(held[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def corpus(seed, n=80):
    rng = random.Random(seed)
    shared = [f"A shared line number {i}" for i in range(12)] + ["short", "nine char", "exactly 10", "ÉÉÉÉÉÉÉÉÉÉ", "日本語日本語日本語日", ""]
    rows = []
    for i in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.5 else f"only here {i} {k}" for k in range(rng.randint(0, 9))]
        lines = [rng.choice(["", " ", "\t", "\r"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "  ", "\r", "\x0b\x0c"]) for x in lines]
        rows.append((i * 3 % 101, "\n".join(lines)))
    very = "\n".join(f"a line of a long text {k % 70_000}" for k in range(100_000))
    return [*rows, (500, None), (501, ""), (502, "\n\n"), (None, "A shared line number 1\nhello"), (None, "null has this one\nnull has this one"), (503, "null has this one"), (504, very), (505, "a line of a long text 69999\na line of a long text 3\n"), rows[5]]


def rows_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("most", [0, 1 << 26])
def test_matches_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", most)
    rows = corpus(1)
    assert rows_of(drop_shared_lines(frame(spark, rows))) == brute(rows)
    assert drop_shared_lines(frame(spark, rows).limit(0)).count() == 0


def state(index):
    return sorted(tuple(r) for r in index.counts().where("n > 0").select("shard", "hi", "lo", "n", "first").collect()), sorted(tuple(r) for r in index.refs().select("hi", "lo", "doc").collect())


def test_insertions_and_deletions_are_reversible(spark, tmp_path):
    """The index after any changes is the one that the remaining documents would have given at once."""
    path = f"file://{tmp_path}"
    rows = [r for r in corpus(2, 50) if r[0] != 504]
    index = LineIndex(spark, path, shards=4)
    index.insert(frame(spark, rows[:25]))
    index = LineIndex.open(spark, path)
    index.insert(frame(spark, rows[20:]))  # some come again
    gone = [rows[0][0], rows[30][0], rows[7][0], None]
    index.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
    left = [r for r in rows if r[0] not in gone]
    once = LineIndex(spark, f"{path}/once", shards=4)
    once.insert(frame(spark, left))
    assert state(index) == state(once)
    assert rows_of(index.apply(frame(spark, left))) == brute(left)
    for f in index.filters().collect():
        lo = {n: np.array([r["lo"] for r in index.counts().where((F.col("shard") == f["shard"]) & (F.col("n") >= n)).collect()], np.int64) for n in (1, 2)}
        for least, name in ((1, "present"), (2, "shared")):
            held = CuckooFilter.from_bytes(bytes(f[name]))
            assert held.holds(lo[least]).all() and np.count_nonzero(held.table) == len(lo[least])
    index.insert(frame(spark, [r for r in rows if r[0] in gone]))  # they come back
    assert rows_of(LineIndex.open(spark, path).apply(frame(spark, rows))) == brute(rows)
    shutil.rmtree(tmp_path)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(1 << 63), 1 << 63, 50_000))
    f = CuckooFilter.of(keys[:40_000])
    assert f.holds(keys[:40_000]).all() and f.holds(keys[40_000:]).mean() < 0.002
    f.remove(keys[:10_000])
    assert f.holds(keys[10_000:40_000]).all() and f.holds(keys[:10_000]).mean() < 0.002
    assert np.count_nonzero(f.table) == 30_000
    assert not CuckooFilter(np.zeros(64, np.uint16)).insert(keys[:100])
    assert CuckooFilter.from_bytes(CuckooFilter.of(keys[:0]).to_bytes()).holds(keys).sum() == 0


def test_hash_is_sparks(spark):
    texts = ["", "a line", "日本語" * 20, "x" * 1000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("h")).collect()
    assert [r.h for r in got] == [line_dedup._hash(t.encode()) for t in texts]
