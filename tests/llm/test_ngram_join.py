import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import ngram_join
from tidegauge.llm.components import components
from tidegauge.llm.shingles import shingle_sets


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width=4, percent=85):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(rows))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(120)]
    for i in range(120):
        kind = i % 6
        if kind == 0:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 200))]
        elif kind == 1:
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind == 2:
            w = passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 20))]
        elif kind == 3:
            w = [rng.choice("ab") for _ in range(rng.randint(1, 8))]
        elif kind == 4:
            w = words(rows[rng.randrange(len(rows))][1])
        else:
            w = passage + base[: rng.randint(0, 60)]
        rows.append((i, "\t ".join(x.upper() if rng.random() < 0.3 else x for x in w)))
    return [*rows, (500, None), (501, " \n"), (None, "only one"), (None, "ONLY  one"), (None, "a lonely text of words"), (7, rows[7][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", 3)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n int, text_hash string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect()), key=str)
    assert got == brute(rows)


def test_one_document_of_each_group_stays(spark):
    rows = corpus(3)[:-4]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, marked string")
    out = ngram_join.drop_similar(df, width=5, percent=80)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in brute(rows, 5, 80)})
    assert ngram_join.drop_similar(df.limit(0)).count() == 0


def test_shingles_of_odd_texts():
    texts = ["", None, " \t\n", "A b C d", "a  B\x0bc\x0cd e", "é ÉÈ ñ x y", "one", "a b a b a b", "z" * 5_000_000 + " q w e r", " ".join(f"w{i}" for i in range(900_000))]
    got = [len(s) for s in shingle_sets(pa.array(texts), 4)]
    assert got == [len(shingles(t, 4)) for t in texts]
    a, b, c = list(shingle_sets(pa.array(["x y A b c d", "a B  c D", "é É"]), 4))
    assert b[0] in a and len(np.intersect1d(a, c)) == 0
    assert [len(s) for s in shingle_sets(pa.array(["p q r s", "t", "u v w x y"]).slice(1), 4)] == [1, 2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)] + [(300, 300 + k) for k in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, **{300 + k: 300 for k in range(50)}}


def test_blocks_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rows = corpus(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("size", [50, 200])
def test_first_pass_gives_no_more_pairs_than_components(spark, size):
    """One long list of near copies, each its own component."""
    rng = np.random.default_rng(size)
    parity = bytearray(rng.bytes(32))
    nodes = spark.createDataFrame([(i, 100, parity) for i in range(size)], "node long, n long, parity binary")
    members = nodes.select(F.lit(7).cast("long").alias("shingle"), "node")
    first = ngram_join._long_list_pairs(members, None, nodes, 85, False).collect()
    assert len(first) == size - 1
    assert len(components(spark.createDataFrame(first)).collect()) == size
    assert ngram_join._long_list_pairs(members, None, nodes, 85, True).count() == size * (size - 1) // 2
