import math
import random

import pytest

from tidegauge.llm.double_array import DoubleArray
from tidegauge.llm.queries import tokenizer_path
from tidegauge.llm.unigram import MARK, UNKNOWN, Unigram, encode_documents

pytest.importorskip("public_tokenizers")
TEXTS = ["", " ", "Hello world", "  two  spaces ", "line\nbreak\n\n", "日本語 🙂 ünïcödé", "a" * 700, "tab\tx", f"mark {MARK} here", "\u0001�"]


@pytest.fixture(scope="module")
def model():
    return Unigram.load(tokenizer_path("piece_bpe_32k.model"))


def brute(model, text):
    """Viterbi over characters with a dictionary of pieces; of equal sums the longer last piece."""
    scores = {model.pieces[i]: (s, i) for i, s in zip(model.usable, model.scores.tolist(), strict=True)}
    s, longest = MARK + text.replace(" ", MARK), max(map(len, scores))
    best, came = [0.0] + [-math.inf] * len(s), [None] * (len(s) + 1)
    for at in range(len(s)):
        for end in range(at + 1, min(len(s), at + longest) + 1):
            if (p := s[at:end]) in scores and best[at] + scores[p][0] > best[end]:
                best[end], came[end] = best[at] + scores[p][0], (at, [scores[p][1]])
        if s[at] not in scores and best[at] + model.unknown > best[at + 1]:
            best[at + 1], came[at + 1] = best[at] + model.unknown, (at, [int(model.byte_ids[b]) for b in s[at].encode()])
    out, at = [], len(s)
    while at:
        at, ids = came[at]
        out = ids + out
    return out


def test_matches_brute_force(model):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abcdeé \n▁xyz🙂") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for t in texts:
        assert model.encode(t) == brute(model, t), t
    assert model.unknown == float(model.scores.min()) + UNKNOWN


def test_round_trip_and_single_words(model):
    for t in TEXTS:
        assert model.decode(model.encode(t)) == t.replace(MARK, " ")
    for w in ("▁word", "▁日🙂x", "▁" + "ab" * 300):
        assert model.one(w.encode()) == model.many([w.encode()])[0]


def test_documents(spark):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)] + [(None, None, None), (1, " ", None)], "doc_id long, text string, ids array<int>")
    rows = encode_documents(df, tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.round_trip for r in rows)
    assert {r.n_ids for r in encode_documents(df.where("doc_id is null"), tokenizer_path("piece_bpe_32k.model"), digest=True).collect()} == {1}
    assert encode_documents(df.limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_double_array():
    rng = random.Random(3)
    keys = sorted({bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 6))) for _ in range(400)})
    trie = DoubleArray(keys)
    for _ in range(300):
        data = bytes(rng.choice(b"abc\x00\xff") for _ in range(10))
        assert [(n, keys[v]) for n, v in trie.prefixes(data, 2)] == [(n, data[2 : 2 + n]) for n in range(1, 9) if data[2 : 2 + n] in keys and len(data[2 : 2 + n]) == n]
