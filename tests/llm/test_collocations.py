import re
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import collocations as C


def pieces(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute(rows, least, most=2000, max_words=5):
    out = []
    for lang in {lang or "und" for lang, _ in rows}:
        f, n = Counter(), 0
        for own, text in rows:
            if (own or "und") == lang:
                for ws in pieces(text):
                    n += len(ws)
                    for m in range(1, max_words + 1):
                        f.update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and f[p[i:j]] <= a}
        scored = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for i, x in enumerate(sorted(scored)[:most])]
    return sorted(out)


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [*(f"w{i}" for i in range(30)), "É", "a\x01", "b\x7f", "日本"]
    rows = []
    for i in range(150):
        ws = [vocabulary[min(int(x), len(vocabulary) - 1)] for x in rng.exponential(6, int(rng.integers(0, 60)))]
        if i % 3 == 0:
            ws[5:5] = ["the", "quick", "brown", "fox", "jumps", "over"]
        glue = [" ", "  ", "\t", ". ", ", ", "\n", "!"]
        rows.append(([None, "en", "zh hant", "de\tx"][i % 4], "".join(w.upper() + glue[int(g)] for w, g in zip(ws, rng.choice(7, len(ws), p=[0.6, 0.1, 0.1, 0.1, 0.04, 0.04, 0.02]), strict=True))))
    return [*rows, ("en", None), ("fr", ""), ("en", "the the the the the the the the"), ("en", "x"), (None, " \t.\n")]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "lang string, text string, phrase string, n int")


@pytest.mark.parametrize("seed,least", [(1, 3), (2, 6)])
def test_matches_brute_force(spark, seed, least):
    rows = corpus(seed)
    got = sorted(tuple(r) for r in C.collocations(frame(spark, rows).repartition(5), least=least).collect())
    assert got == brute(rows, least) and len(got) > 50


def test_slices_borders_and_limit(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 64)  # texts of several slices, each of few words
    rows = corpus(3) + corpus(3)[:40]
    spark.conf.set("spark.sql.shuffle.partitions", "37")  # many borders between tasks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in C.collocations(frame(spark, rows), least=4, most=7).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows, 4, 7)


def test_empty_and_large_counts(spark):
    empty = frame(spark, corpus(1)).limit(0)
    assert C.collocations(empty).count() == 0
    rows = [("en", "a b, " * 30_000 + "a c. b")]
    assert sorted(tuple(r) for r in C.collocations(frame(spark, rows)).collect()) == brute(rows, 100)


def test_prefixes_across_batches():
    """The stack counts the same, wherever a batch or a task ends, in codes or spelled."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    known = C.Dictionary([("en", "a"), ("en", "b"), ("l" * 300, "z"), ("l" * 300, "b")], np.zeros(1024, np.uint64))
    spell = {"en": {"a": b"\x80\x00", "b": b"\x80\x01"}, "l" * 300: {"z": b"\x80\x00", "b": b"\x80\x01"}}
    rows = [(lang, [str(x) for x in rng.choice(["a", "b", "z", "\x80 \x09"[0], "\u00e9x"], int(rng.integers(2, 6)))]) for lang in spell for _ in range(300)]
    keys = sorted((C._head(lang.encode()) + b"".join(spell[lang].get(w, b"\x01" + w.encode() + b" ") for w in ws) for lang, ws in rows), reverse=True)
    want = Counter((lang, " ".join(ws[:m])) for lang, ws in rows for m in range(2, len(ws) + 1))
    for step in (1, 7, 600):
        got = Counter()
        for task in (keys[:123], keys[123:]):
            batches = [pa.RecordBatch.from_arrays([pa.array(task[i : i + step], pa.binary()), pa.array([1] * len(task[i : i + step]))], ["key", "n"]) for i in range(0, len(task), step)]
            for out in C._count_prefixes(lambda: known, 5, 1)(iter(batches)):
                for lang, phrase, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
                    got[lang, phrase] += n
        assert got == want


def test_words_beyond_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr(C, "DICTIONARY", 20)
    monkeypatch.setattr(C, "OF_A_LANGUAGE", 4)
    rows = corpus(5)
    assert sorted(tuple(r) for r in C.collocations(frame(spark, rows), least=3).collect()) == brute(rows, 3)
