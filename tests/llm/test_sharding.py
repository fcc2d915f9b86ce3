import math
import zlib

import xxhash

from tidegauge.llm.sharding import ShardTree, shard_documents, with_shard


def xx(values):
    """Spark's xxhash64 of strings and ints."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & 0xFFFFFFFF).to_bytes(4, "little"), h)
    return h


def draw(key, *name):
    return -math.log(((xx((key, *name)) >> 11) + 0.5) * 2.0**-53)


def brute(key, tree):
    top = [draw(key, "region", i) / sum(map(sum, r)) for i, r in enumerate(tree.weights)] + [draw(key, "added", i) / w for i, w in enumerate(tree.added)]
    r = top.index(min(top))
    n = sum(len(k) for g in tree.weights for k in g)
    if r >= len(tree.weights):
        return n + r - len(tree.weights)
    racks = [draw(key, "rack", r, i) / sum(k) for i, k in enumerate(tree.weights[r])]
    k = racks.index(min(racks))
    leaves = [draw(key, "shard", r, k, i) / w for i, w in enumerate(tree.weights[r][k])]
    before = [len(c) for g in tree.weights[:r] for c in g] + [len(c) for c in tree.weights[r][:k]]
    return sum(before) + leaves.index(min(leaves))


def test_tree_matches_brute_force(spark):
    for tree in (ShardTree.uniform(40), ShardTree.uniform(7, 3, 2).grown().grown(2.0), ShardTree((((1.0, 3.0), (2.0,)), ((1.0,),)))):
        rows = with_shard(spark.range(300).withColumnRenamed("id", "k"), "k", tree, "s").collect()
        assert [(r.k, r.s) for r in rows] == [(r.k, brute(str(r.k), tree)) for r in rows]


def test_growing_moves_rows_only_to_the_new_shard(spark):
    tree = ShardTree.uniform(40)
    rows = with_shard(with_shard(spark.range(20000), "id", tree, "a"), "id", tree.grown(), "b").collect()
    assert all(r.a == r.b or r.b == 40 for r in rows)
    assert 300 < sum(r.b == 40 for r in rows) < 700
    counts = [sum(r.a == s for r in rows) for s in range(40)]
    assert min(counts) > 350 and max(counts) < 650


def test_a_weight_change_stays_in_its_subtree(spark):
    a = ShardTree((((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 1.0))))
    b = ShardTree((((1.5, 0.5), (1.0, 1.0)), ((1.0, 1.0), (1.0, 1.0))))
    rows = with_shard(with_shard(spark.range(5000), "id", a, "a"), "id", b, "b").collect()
    moved = {(r.a, r.b) for r in rows if r.a != r.b}
    assert moved == {(1, 0)}


def test_slots_sizes_and_odd_rows(spark):
    df = spark.createDataFrame([(i % 90, "é" * (i % 5)) for i in range(400)] + [(None, None), (None, "x"), (3, None)], "doc_id long, text string")
    rows = shard_documents(df, ShardTree.uniform(5, 2, 2)).collect()
    assert len(rows) == 403 and {r.law for r in rows} == {"key"}
    for s in {r.shard for r in rows}:
        mine = sorted(r.slot for r in rows if r.shard == s)
        assert mine == list(range(len(mine)))
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id == 7} <= {(16 + 2 * n, zlib.crc32(("é" * n).encode())) for n in range(5)}
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id is None} == {(16, 0), (17, zlib.crc32(b"x"))}
    assert shard_documents(df.limit(0), ShardTree.uniform(5)).count() == 0
