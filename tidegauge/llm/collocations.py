"""Phrase collocations by Suffix-sigma: the counts of all phrases from one sort of short suffixes.

Each place of a text gives the suffix that begins there, truncated to ``max_words`` words. A
phrase's occurrences are then the suffixes that it begins. Suffixes are shuffled by
language, first word and what follows it, sorted in reverse order, and read once:
a stack holds the open prefix of each length with its count, and a prefix
is done when a suffix arrives that it doesn't begin. The shuffle is by ranges, so a frequent first word
goes on in the next task; the at most ``max_words`` prefixes that a border cuts are counted on
both sides, and added.

Three things keep the shuffle small, and none changes a count. Equal suffixes of a slice of text are one
row with its number. A phrase can be no more frequent than its words, so a
suffix ends before a word that occurs less than ``least`` times in its language. Which
words do is read from a bit array of bounded size; slots that words share cost a longer suffix.
And the ``DICTIONARY`` most frequent words are written as two bytes, the others are spelled out.

The score of a phrase needs the counts of its parts, which are joined afterwards.

Defined results: null texts count as empty, a null language is ``und``; repeated rows count
once each; the id and other columns have no influence. An empty table gives an empty result.
Texts of any length are read in slices that end where a piece does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bits import bit_array
from .common import settle
from .shingles import STEP, _powers, mixed

#: Bytes of text of a slice.
SLICE = 4 << 20
#: Words that are written as two bytes: so many in all, and so many of a language.
DICTIONARY, OF_A_LANGUAGE = 1 << 17, 1 << 15
#: log2 of the bits that tell the frequent words, at least and at most.
FEWEST_BITS, MOST_BITS = 16, 26

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_SPACE = 0x20


class Runs:
    """Runs of bytes of ``data``: their hashes, order and copies."""

    def __init__(self, data: np.ndarray, begin: np.ndarray):
        self.data, self.begin = data, begin
        self.total = np.zeros(len(data) + 1, np.uint64)
        up, self.down = _powers(len(data) + 1)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.total[1:], dtype=np.uint64)

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[begin]) * self.down[begin] + (end - begin).astype(np.uint64) * STEP)

    def about_in_order(self, begin: np.ndarray) -> np.ndarray:
        """Puts runs in the order of their first sixteen bytes."""
        padded = np.concatenate([self.data, np.zeros(16, np.uint8)])
        halves = [np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[begin + k]).view(">u8")[:, 0].astype(np.uint64) for k in (0, 8)]
        return np.lexsort(halves[::-1])

    def spelled(self, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """The bytes from each ``begin`` to its ``end``."""
        sizes = end - begin
        offsets = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        at = np.repeat((begin - offsets[:-1]).astype(np.int32), sizes) + np.arange(offsets[-1], dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[at])])


class Words(Runs):
    """The words of a slice of texts: where each begins and ends in ``data``, and how many follow it in its piece."""

    def __init__(self, raw: np.ndarray):
        stop = _STOP[raw]
        apart = stop | _GAP[raw]
        before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
        before[1:], after[:-1] = apart[:-1], apart[1:]
        starts, ends = np.flatnonzero(~apart & before), np.flatnonzero(~apart & after) + 1
        sizes = ends - starts
        place = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes + 1, out=place[1:])
        data, self.end = np.full(int(place[-1]), _SPACE, np.uint8), place[:-1] + sizes
        data[np.repeat(place[:-1] - starts, sizes) + np.flatnonzero(~apart)] = _LOWER[raw[~apart]]
        super().__init__(data, place[:-1])
        piece = np.cumsum(stop)[starts]
        last = np.append(np.flatnonzero(np.diff(piece)), len(piece) - 1) if len(piece) else np.zeros(0, np.int64)
        self.follow = last[np.searchsorted(last, np.arange(len(piece)))] - np.arange(len(piece))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    """(language, bytes) of slices of the texts of each language; pieces stay whole, and no phrase goes from one text to the next."""
    langs = batch.column(0).to_pylist()
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for lang, text in zip(langs, batch.column(1), strict=True):
        body = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
        for part in _cut(body):
            held.setdefault(lang, []).append(part)
            sizes[lang] = sizes.get(lang, 0) + len(part)
            if sizes[lang] >= SLICE:
                yield lang.encode(), np.frombuffer(b"\n".join(held.pop(lang)), np.uint8)
                del sizes[lang]
    for lang, parts in held.items():
        yield lang.encode(), np.frombuffer(b"\n".join(parts), np.uint8)


def _cut(body: memoryview) -> Iterator[memoryview]:
    """A long text in parts that end at a stop."""
    while len(body) > SLICE:
        data = np.frombuffer(body, np.uint8)
        stops = np.flatnonzero(_STOP[data[:SLICE]])
        if len(stops):
            end = int(stops[-1]) + 1
        else:
            later = np.flatnonzero(_STOP[data[SLICE:]])
            end = SLICE + int(later[0]) + 1 if len(later) else len(body)
        yield body[:end]
        body = body[end:]
    yield body


def _lang_hash(lang: bytes) -> np.uint64:
    h = np.array([len(lang)], np.uint64)
    for b in lang:
        h = mixed(h * STEP + np.uint64(b))
    return h[0]


def _slot(words: Words, lang: bytes) -> np.ndarray:
    return (words.hashes(words.begin, words.end) ^ _lang_hash(lang)).view(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, raw in _slices(batch):
            w = Words(raw)
            _, first, n = np.unique(w.hashes(w.begin, w.end), return_index=True, return_counts=True)
            if len(first):
                order = w.about_in_order(w.begin[first])
                first, n = first[order], n[order]
                yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(first)), w.spelled(w.begin[first], w.end[first]), pa.array(n)], ["lang", "word", "n"])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slot of each (language, word)."""
    for batch in batches:
        for lang in batch.column(0).unique().to_pylist():
            words = batch.filter(pc.equal(batch.column(0), lang)).column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(_slot(Words(np.frombuffer(b"\n".join(words), np.uint8)), lang.encode()))], ["slot"])


class Dictionary:
    """Codes of the most frequent words of each language, and which other words may be frequent.

    A word is written as two bytes, of which the first is 0x80 or more, or as 0x01, its bytes, and a blank.
    """

    def __init__(self, words: list[tuple[str, str]], bits: np.ndarray):
        self.spelled: dict[bytes, list[bytes]] = {}
        for lang, word in words:
            known = self.spelled.setdefault(lang.encode(), [])
            if len(known) < OF_A_LANGUAGE:
                known.append(word.encode())
        slots, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lang, known in self.spelled.items():
            slots.append(_slot(Words(np.frombuffer(b"\n".join(known), np.uint8)), lang))
            codes.append(np.arange(len(known)))
        slot, code = np.concatenate(slots), np.concatenate(codes)
        order = np.argsort(slot)
        self.slot, self.code, self.bits = slot[order], code[order], bits

    def codes(self, slot: np.ndarray) -> np.ndarray:
        """The code of each word, -1 for others."""
        if not len(self.slot):
            return np.full(len(slot), -1)
        at = np.minimum(np.searchsorted(self.slot, slot), len(self.slot) - 1)
        return np.where(self.slot[at] == slot, self.code[at], -1)

    def may_be_frequent(self, slot: np.ndarray) -> np.ndarray:
        place = slot.view(np.uint64) & np.uint64(64 * len(self.bits) - 1)
        return (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0

    def read(self, lang: bytes, body: bytes) -> str:
        """The words of a run of codes and spelled words, parted by blanks."""
        at, out = 0, []
        while at < len(body):
            if body[at] >= 0x80:
                out.append(self.spelled[lang][(body[at] & 0x7F) << 8 | body[at + 1]])
                at += 2
            else:
                end = body.index(b" ", at)
                out.append(body[at + 1 : end])
                at = end + 1
        return b" ".join(out).decode()


def _coded(w: Words, code: np.ndarray) -> Runs:
    """The words as codes or spelled, without gaps: word i is from ``begin[i]`` to ``begin[i + 1]``."""
    short, size = code >= 0, w.end - w.begin
    begin = np.zeros(len(code) + 1, np.int64)
    np.cumsum(np.where(short, 2, size + 2), out=begin[1:])
    data = np.empty(int(begin[-1]), np.uint8)
    at = begin[:-1][short]
    data[at], data[at + 1] = 0x80 | (code[short] >> 8), code[short] & 0xFF
    at, n = begin[:-1][~short], size[~short]
    data[at], data[at + n + 1] = 0x01, _SPACE
    first = np.cumsum(n) - n
    each = np.arange(int(n.sum()))
    data[np.repeat(at + 1 - first, n) + each] = w.data[np.repeat(w.begin[~short] - first, n) + each]
    return Runs(data, begin)


def _head(lang: bytes) -> bytes:
    return (bytes([len(lang)]) if len(lang) < 255 else b"\xff" + len(lang).to_bytes(4, "big")) + lang


def _behead(key: bytes) -> tuple[bytes, bytes]:
    at, n = (1, key[0]) if key[0] < 255 else (5, int.from_bytes(key[1:5], "big"))
    return key[at : at + n], key[at + n :]


def _suffixes(found: Callable[[], Dictionary], max_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Emits ``key`` (language and suffix) and its number in a slice, for suffixes of two words and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = found()
        for batch in batches:
            for lang, raw in _slices(batch):
                w = Words(raw)
                if not len(w.begin):
                    continue
                slot = _slot(w, lang)
                code = known.codes(slot)
                often = (code >= 0) | known.may_be_frequent(slot)
                # words in a row that are frequent and in one piece, from each on
                ends = np.append(np.flatnonzero(~often), len(often))
                run_of = ends[np.searchsorted(ends, np.arange(len(often)))] - np.arange(len(often))
                size = np.minimum(np.minimum(run_of, w.follow + 1), max_words)
                at = np.flatnonzero(size >= 2)
                coded = _coded(w, code)
                begin, end = coded.begin[at], coded.begin[at + size[at]]
                _, first, n = np.unique(coded.hashes(begin, end), return_index=True, return_counts=True)
                if len(first):
                    order = coded.about_in_order(begin[first])  # suffixes that begin alike stand together and pack well
                    first, n = first[order], n[order]
                    key = pc.binary_join_element_wise(pa.scalar(_head(lang), pa.binary()), coded.spelled(begin[first], end[first]), pa.scalar(b"", pa.binary()))
                    yield pa.RecordBatch.from_arrays([key, pa.array(n)], ["key", "n"])

    return run


class _Stack:
    """The open prefix of each length: its hash, bytes and count. ``edge``: it reaches the first row of the task."""

    def __init__(self, max_words: int, least: int):
        self.least, self.levels = least, max_words
        self.hash: list[int | None] = [None] * max_words
        self.body, self.count, self.edge = [b""] * max_words, [0] * max_words, [False] * max_words
        self.begun = False

    def _closed(self, k: int, all_of_them: bool = False) -> Iterator[tuple[bytes, int]]:
        if self.hash[k] is not None and k and (all_of_them or self.edge[k] or self.count[k] >= self.least):
            yield self.body[k], self.count[k]
        self.hash[k] = None

    def read(self, keys: pa.Array, n: np.ndarray) -> Iterator[tuple[bytes, int]]:
        """The (prefix, count) that are done after these rows; of one word they are left to the count of words."""
        offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
        data = np.frombuffer(keys.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:], dtype=np.uint64)
        wide = data[offsets[:-1]] == 255
        at = offsets[:-1] + 1 + data[offsets[:-1]]
        for i in np.flatnonzero(wide).tolist():
            at[i] = offsets[i] + 5 + int.from_bytes(data[offsets[i] + 1 : offsets[i] + 5].tobytes(), "big")
        blanks = np.flatnonzero(data == _SPACE)
        rows = np.arange(len(keys))
        for k in range(self.levels):
            more = at < offsets[rows + 1]
            rows, at = rows[more], at[more]
            if not len(rows):
                yield from self._closed(k)
                continue
            coded = data[at] >= 0x80
            ends = at + 2
            ends[~coded] = blanks[np.searchsorted(blanks, at[~coded])] + 1
            at, begin = ends, offsets[rows]
            h = mixed((total[ends] - total[begin]) * down[begin] + (ends - begin).astype(np.uint64) * STEP)
            new = np.ones(len(rows), bool)
            new[1:] = (h[1:] != h[:-1]) | (np.diff(rows) != 1)
            goes_on = rows[0] == 0 and self.hash[k] is not None and self.hash[k] == int(h[0])
            if not goes_on:
                yield from self._closed(k)
            starts = np.flatnonzero(new)
            counts = np.add.reduceat(n[rows], starts)
            if goes_on:
                counts[0] += self.count[k]
            edge = self.edge[k] if goes_on else (not self.begun and rows[0] == 0)
            done = np.flatnonzero(counts >= self.least)
            if edge and not (len(done) and done[0] == 0):
                done = np.append(0, done)
            open_one = len(starts) - 1 if rows[-1] == len(keys) - 1 else -1
            if k:
                for x in done.tolist():
                    if x != open_one:
                        yield data[begin[starts[x]] : ends[starts[x]]].tobytes(), int(counts[x])
            self.hash[k] = None
            if open_one >= 0:
                x = starts[-1]
                self.hash[k], self.body[k], self.count[k], self.edge[k] = int(h[x]), data[begin[x] : ends[x]].tobytes(), int(counts[-1]), bool(edge and len(starts) == 1)
        self.begun = True

    def close(self) -> Iterator[tuple[bytes, int]]:
        """What is still open when the task's rows end; it may go on in the next task."""
        for k in range(self.levels):
            yield from self._closed(k, True)


def _count_prefixes(found: Callable[[], Dictionary], max_words: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, known = _Stack(max_words, least), found()

        def out(done: list[tuple[bytes, int]]) -> pa.RecordBatch:
            split = [_behead(b) for b, _ in done]
            columns = [pa.array([lang.decode() for lang, _ in split], pa.string()), pa.array([known.read(*x) for x in split], pa.string()), pa.array([n for _, n in done], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])

        for batch in batches:
            if batch.num_rows and (done := list(stack.read(batch.column(0), np.asarray(batch.column(1))))):
                yield out(done)
        if done := list(stack.close()):
            yield out(done)

    return run


def _frequent_words(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Words that occur ``least`` times and more, and the number of all words, by language."""
    counted = texts.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = settle(counted.select("lang", F.col("word").cast("string").alias("phrase"), "n").withColumn("kept", F.col("n") >= least), "phrases-words")
    sums = words.groupBy("lang").agg(F.sum("n").alias("total"))
    return words.where("kept"), sums


def phrase_counts(texts: DataFrame, max_words: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(``lang``, ``phrase``, ``words``, ``f``) of phrases that occur ``least`` times and more, and the number of words by language. ``texts``: lang, text."""
    spark = texts.sparkSession
    words, sums = _frequent_words(texts, least)
    n = words.count()
    bits = min(MOST_BITS, max(FEWEST_BITS, (16 * n).bit_length()))
    slots = words.select("lang", "phrase").mapInArrow(_slots, "slot long")
    found = bit_array(slots.select(F.col("slot").bitwiseAND((1 << bits) - 1).alias("p")), bits).first()["words"]
    top = words.orderBy(F.desc("n"), "lang", "phrase").limit(DICTIONARY).select("lang", "phrase").collect()
    sent = spark.sparkContext.broadcast(Dictionary([tuple(r) for r in top], np.array(found, np.int64).view(np.uint64)))
    known = lambda: sent.value

    rows = texts.mapInArrow(_suffixes(known, max_words), "key binary, n long")
    dealt = rows.repartitionByRange(F.desc("key")).sortWithinPartitions(F.desc("key"))
    counted = dealt.mapInArrow(_count_prefixes(known, max_words, least), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    phrases = counted.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f")
    ones = words.select("lang", "phrase", F.lit(1).alias("words"), F.col("n").alias("f"))
    return settle(phrases.unionByName(ones), "phrases"), sums


def _joined(words: Column, begin: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 5, least: int = 100, share: int = 100, most: int = 2000) -> DataFrame:
    """The first ``most`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase inside a longer one that has ``share`` per cent of its occurrences is dropped.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    counts, sums = phrase_counts(texts, max_words, least)
    ws = F.split("phrase", " ")
    longer = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), ws.alias("ws"))
    # a phrase in a longer one with enough occurrences is also in one that has a word more, since that one occurs as often at least
    inner = longer.where("words > 2").select("lang", F.col("a").alias("outer"), F.explode(F.array(_joined(F.col("ws"), 1, F.col("words") - 1), _joined(F.col("ws"), 2, F.col("words") - 1))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    free = longer.join(covered, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (F.col("outer") * 100 < F.col("a") * share))
    cuts = free.select("lang", "phrase", "a", "words", "ws", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("ws"), F.lit(1), F.col("k")).alias("left"), _joined(F.col("ws"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(sums.select("lang", F.col("total").alias("n")), "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("above", F.lit(1000).cast("decimal(4,0)") * big("a") * big("n")).withColumn("below", big("l") * big("r"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    least_cut = F.min(F.struct("score", "k", "l", "r", "n")).alias("x")
    scored = cuts.groupBy("lang", "phrase", "a").agg(least_cut).select("lang", "phrase", "a", "x.l", "x.r", "x.n", "x.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return first.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
