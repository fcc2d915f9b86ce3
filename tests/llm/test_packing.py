import random
import zlib

import numpy as np
import pytest

from tidegauge.llm import packing
from tidegauge.llm.queries import tokenizer_path
from tidegauge.llm.word_bpe import WordBpe

Tokenizer = pytest.importorskip("tokenizers").Tokenizer
public_tokenizers = pytest.importorskip("public_tokenizers")


def fresh():
    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_ids_are_the_tokenizers(monkeypatch):
    monkeypatch.setattr("tidegauge.llm.word_bpe.MOST_WORDS", 5)
    bpe, tokenizer = WordBpe(tokenizer_path("word_bpe_49k.json")), fresh()
    for t in ("", "it's I'M  a\tb\x1cc ÉCOLE ½²³ n°5 Ｆull ΣΑΣ İstanbul", "don't,'s ''ll <|endoftext|> 123 45a_b__c", "hello <|endoftext|> world", "a<|STARTOFTEXT|>b <|startoftext|>", "日本語 🙂 text", "é ́x", "a\x85b\xa0c d", "x" * 20000, "'sa a's 's 'S x'll"):
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == ids_of(tokenizer, t).tolist()


def test_tables_of_runs_are_bounded(monkeypatch):
    """What a worker remembers has few entries, and none for each combination of a run and its signs or for long runs."""
    monkeypatch.setattr("tidegauge.llm.word_bpe.MOST_WORDS", 50)
    bpe, tokenizer = WordBpe(tokenizer_path("word_bpe_49k.json")), fresh()
    texts = [f"word, word. word! {'x' * (1000 + k)} {k}:{k + 1}" for k in range(40)]
    for t in texts:
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == ids_of(tokenizer, t).tolist()
    tables = [v for v in vars(bpe).values() if isinstance(v, dict) and type(v) is not dict]
    held = [k for v in tables for k in v]
    assert 0 < len(held) <= 50 and sum(map(len, held)) < 1000 and "word" in held and "word," not in held


def test_operators_keep_all_items():
    rng = random.Random(5)
    lengths = [rng.randint(1, 99) for _ in range(300)]
    a = packing.best_fit(list(range(300)), lengths, 100, [])
    b = packing.best_fit(sorted(range(300), key=lambda i: -lengths[i]), lengths, 100, [])
    for bins in (a, b, packing.crossover(a, b, lengths, 100, rng), packing.mutate(a, lengths, 100, rng), packing.evolve(lengths, 100, 1, [a])[0]):
        assert sorted(i for x in bins for i in x) == list(range(300))
        assert all(sum(lengths[i] for i in x) <= 100 for x in bins)
    best, crossed = packing.evolve(lengths, 100, 1, [a])
    assert len(best) <= len(b) + 1 and len(best) <= len(a) and crossed >= 2 * packing.LEAST


def check(rows, documents, capacity):
    tokenizer = fresh()
    want = sorted(((d, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].astype("<u4").tobytes())) for d, t in documents for ids in [np.append(ids_of(tokenizer, t), 1)] for k, at in enumerate(range(0, len(ids), capacity))), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in rows)


def test_packs_all_documents(spark):
    rng = random.Random(1)
    documents = [(i, " ".join(rng.choice(["the", "of", "Ünï", "x1"]) for _ in range(rng.randint(0, 90)))) for i in range(400)] + [(None, None), (None, ""), (3, "the " * 1000), (3, "the " * 1000), (9, "a <|endoftext|> b")]
    df = spark.createDataFrame([(*d, 1) for d in documents], "doc_id long, text string, piece int")
    n, total = check(packing.pack_documents(df, tokenizer_path("word_bpe_49k.json"), capacity=64).collect(), documents, 64)
    assert n <= total / 64 * 1.05 + 2
    assert packing.pack_documents(df.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    pieces = spark.range(500).selectExpr("id AS row", "id % 90 + 1 AS length")
    rows = packing.pack_lengths(pieces, 100, block=50).collect()
    assert sorted(r.row for r in rows) == list(range(500))
    with pytest.raises(ValueError):
        packing.pack_lengths(pieces, 100, islands=1)


def test_the_query_evolves_and_fills_sequences(spark):
    """Crossovers and migrations happen on the way of the query itself, over the whole table of sf0.01."""
    from tidegauge.llm.common import table

    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json")).collect()
    n, total = check(rows, [tuple(r) for r in docs.collect()], packing.CAPACITY)
    assert n <= -(-total // packing.CAPACITY) * 1.005 + 1
    small = spark.createDataFrame([(i, r.length) for i, r in enumerate(rows) if r.length < packing.CAPACITY], "row long, length long")
    state = packing.evolved(small).groupBy("block", "island").agg({"crossovers": "min", "immigrants": "min"}).toDF("block", "island", "crossovers", "immigrants").collect()
    assert len(state) >= packing.ISLANDS and all(r.crossovers >= 2 and r.immigrants >= 1 for r in state)
