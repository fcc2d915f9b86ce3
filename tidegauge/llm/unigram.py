"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A space becomes the marker U+2581, with one more in front of the text; then the
segmentation with the largest sum of piece scores is taken. A character that is no
piece by itself may be taken alone at ``UNKNOWN`` below the lowest score and is written
as its UTF-8 bytes. Decoding puts the pieces and bytes together, turns markers into
spaces and drops the first.

No piece has a marker after another character, and characters outside all pieces stand
alone, so the best segmentation of a text is that of its words in a row. Words are
remembered in a table of bounded size; unseen ones are solved many at a time, each
position and trie step being one array operation over all of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .double_array import DoubleArray

MARK, UNKNOWN = "▁", -10.0
MOST_WORDS = 300_000
#: Words solved together; longer words than LONG bytes are solved one by one.
TOGETHER, LONG = 50_000, 200
#: Characters of the texts whose unseen words are gathered before they are solved.
GATHER = 2_000_000


class Unigram:
    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], usable: list[int]):
        """``usable``: ids of ordinary pieces; ``byte_ids``: the id that stands for each byte."""
        self.pieces, self.usable = pieces, usable
        self.trie = DoubleArray([pieces[i].encode() for i in usable])
        self.ids = np.array(usable, np.int64)
        self.scores = np.array([scores[i] for i in usable], np.float64)
        self.unknown = float(self.scores.min()) + UNKNOWN
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int64)
        self.raw = [p.encode() for p in pieces]
        for b, i in byte_ids.items():
            self.raw[i] = bytes([b])
        chars = {c for i in usable for c in pieces[i]}
        self.splits = all(re.fullmatch(f"{MARK}*[^{MARK}]*", pieces[i]) for i in usable)
        stop = "" if "\n" in chars else "\n"
        self.word = re.compile(f"{MARK}*[^{MARK}{stop}]+|{MARK}+" + f"|{stop}" * bool(stop))
        self.known: dict[str, bytes] = {}

    @staticmethod
    def load(path: str) -> Unigram:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        pieces = [sp.id_to_piece(i) for i in every]
        usable = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        byte_ids = {int(pieces[i][3:-1], 16): i for i in every if sp.is_byte(i)}
        return Unigram(pieces, [sp.get_score(i) for i in every], byte_ids, usable)

    def words(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        return self.word.findall(marked) if self.splits else [marked]

    def learn(self, words: set[str]) -> None:
        """Solve the words of ``words`` that aren't known."""
        if len(self.known) + len(words) > MOST_WORDS:
            self.known.clear()
        new = sorted(((w.encode(), w) for w in words if w not in self.known), key=lambda x: len(x[0]))
        lo = 0
        while lo < len(new):
            size = len(new[lo][0])
            if size > LONG:
                self.known[new[lo][1]] = self.one(new[lo][0])
                lo += 1
                continue
            hi, most = lo, max(size, size * 5 // 4)
            while hi < len(new) and hi - lo < TOGETHER and len(new[hi][0]) <= most:
                hi += 1
            for (_, w), ids in zip(new[lo:hi], self.many([d for d, _ in new[lo:hi]]), strict=True):
                self.known[w] = ids
            lo = hi

    def many(self, data: list[bytes]) -> list[bytes]:
        """The ids of each of ``data`` by one Viterbi pass over all of them."""
        n, sizes = len(data), np.array([len(d) for d in data])
        wide = int(sizes.max())
        text = np.frombuffer(b"".join(d.ljust(wide, b"\0") for d in data), np.uint8).reshape(n, wide).astype(np.int32)
        best = np.full((n, wide + 1), -np.inf)
        best[:, 0] = 0
        came, by = np.zeros((n, wide + 1), np.int32), np.full((n, wide + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for at in range(wide):
            rows = np.flatnonzero((best[:, at] > -np.inf) & (sizes > at))
            if not len(rows):
                continue
            lead = text[rows, at]
            char = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single, state, live = np.zeros(n, bool), np.zeros(len(rows), np.int32), rows
            width = np.zeros(n, np.int32)
            width[rows] = char
            for step in range(min(self.trie.depth, wide - at)):
                nxt = base[state] + text[live, at + step]
                ok = (check[nxt] == state) & (nxt > 0) & (sizes[live] > at + step)
                live, state = live[ok], nxt[ok]
                if not len(live):
                    break
                piece = value[state]
                ends = piece >= 0
                r, p = live[ends], piece[ends]
                single[r[width[r] == step + 1]] = True
                self._better(best, came, by, r, at, step + 1, best[r, at] + self.scores[p], p)
            for w in range(1, 5):
                r = rows[(char == w) & ~single[rows]]
                if len(r):
                    self._better(best, came, by, r, at, w, best[r, at] + self.unknown, np.full(len(r), -1, np.int32))
        return self._traced(data, sizes, came, by)

    @staticmethod
    def _better(best: np.ndarray, came: np.ndarray, by: np.ndarray, rows: np.ndarray, at: int, width: int, score: np.ndarray, piece: np.ndarray) -> None:
        """Ties stay with the segmentation found first, whose last piece is longer."""
        win = score > best[rows, at + width]
        rows = rows[win]
        best[rows, at + width], came[rows, at + width], by[rows, at + width] = score[win], at, piece[win]

    def _traced(self, data: list[bytes], sizes: np.ndarray, came: np.ndarray, by: np.ndarray) -> list[bytes]:
        out: list[list[int]] = [[] for _ in data]
        rows, at = np.arange(len(data)), sizes.copy()
        while len(rows := rows[at[rows] > 0]):
            here = at[rows]
            piece, begin = by[rows, here], came[rows, here]
            ids = np.where(piece >= 0, self.ids[np.maximum(piece, 0)], -1)
            for r, i, a, b in zip(rows.tolist(), ids.tolist(), begin.tolist(), here.tolist(), strict=True):
                if i >= 0:
                    out[r].append(i)
                else:
                    out[r] += self.byte_ids[np.frombuffer(data[r][a:b], np.uint8)[::-1]].tolist()
            at[rows] = begin
        return [np.array(x[::-1], "<u4").tobytes() for x in out]

    def one(self, data: bytes) -> bytes:
        """The same for one word, a position at a time."""
        best, came = [0.0] + [-np.inf] * len(data), [(0, -1)] * (len(data) + 1)
        for at in range(len(data)):
            if best[at] == -np.inf:
                continue
            c = data[at]
            width, single = 1 + (c >= 0xC0) + (c >= 0xE0) + (c >= 0xF0), False
            for n, p in self.trie.prefixes(data, at):
                single |= n == width
                if (s := best[at] + float(self.scores[p])) > best[at + n]:
                    best[at + n], came[at + n] = s, (at, p)
            if not single and (s := best[at] + self.unknown) > best[at + width]:
                best[at + width], came[at + width] = s, (at, -1)
        out, at = [], len(data)
        while at:
            begin, p = came[at]
            out.append([int(self.ids[p])] if p >= 0 else self.byte_ids[np.frombuffer(data[begin:at], np.uint8)].tolist())
            at = begin
        return np.array([i for x in reversed(out) for i in x], "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as unsigned 32-bit little-endian integers."""
        split = [self.words(t) for t in texts]
        unseen: set[str] = set()
        for words in split:
            unseen.update(words)
        self.learn(unseen)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text.replace(MARK, " ").removeprefix(" ")


_OUT = "doc_id long, ids array<int>, round_trip boolean"
_DIGEST = "doc_id long, n_ids long, n_bytes long, ids_crc32 long, round_trip boolean"


def _gathered(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    ids, texts, held = [], [], 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        ids.append(doc_id)
        texts.append(text.as_py())
        held += len(texts[-1])
        if held > GATHER:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _same(model: Unigram, ids: np.ndarray, text: str) -> bool:
    return model.decode(ids.tolist()) == text.replace(MARK, " ")


def _encoder(path: str, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.load(path)
        low, high = int(model.byte_ids.min()), int(model.byte_ids.max())
        for batch in batches:
            for keys, texts in _gathered(batch):
                packed = model.encode_all(texts)
                ids = [np.frombuffer(p, "<u4") for p in packed]
                same = pa.array([_same(model, i, t) for i, t in zip(ids, texts, strict=True)], pa.bool_())
                if digest:
                    counts = [pa.array([len(i) for i in ids], pa.int64()), pa.array([int(((i >= low) & (i <= high)).sum()) for i in ids], pa.int64()), pa.array([zlib.crc32(p) for p in packed], pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *counts, same], ["doc_id", "n_ids", "n_bytes", "ids_crc32", "round_trip"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), same], ["doc_id", "ids", "round_trip"])

    return run


def encode_documents(docs: DataFrame, model: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``ids`` and whether decoding gives the text back, per row; with ``digest`` the count, count of byte tokens and CRC of the ids.

    ``round_trip`` takes a marker character in a text for the space that it decodes to.
    Null texts count as empty: the marker alone. Rows keep their number, ids their
    nulls and repetitions. ``model`` is a path that every executor has.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.mapInArrow(_encoder(model, digest), _DIGEST if digest else _OUT).withColumnRenamed("doc_id", id_col)
