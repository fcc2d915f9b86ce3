"""Hashed word shingles of many texts at once, on the bytes of an Arrow column.

A-Z is lower-cased, words are runs of bytes other than ``[\\x20\\x09-\\x0D]``, a shingle is
``width`` words in a row; a text of fewer words has all of them as its only shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += 32
_LOW += 1
#: An odd base and its inverse modulo 2^64; odd multipliers of the mixing steps.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX1, MIX2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are hashed at once.
SLICE = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, known: dict[str, np.ndarray] = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(known.get("up", ())) < n:
        for name, factor in (("up", BASE), ("down", INVERSE)):
            p = np.full(max(n, SLICE), factor, np.uint64)
            p[0] = 1
            known[name] = np.multiply.accumulate(p)
    return known["up"], known["down"]


def _word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of ``data``; no word crosses a place of ``begins``."""
    blank = _BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[begins] = cut[-1] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, blank[:-1]
    starts = np.flatnonzero(~blank & (before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, blank[1:]
    ends = np.flatnonzero(~blank & (after | cut[1:]))
    up, down = _powers(len(data))
    total = np.cumsum(_LOW[data] * up[: len(data)], dtype=np.uint64)
    low = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mixed((total[ends] - low) * down[starts] + (ends - starts + 1).astype(np.uint64) * STEP), starts


def _joined(w: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = len(w) - width + 1
    h = w[:n]
    for k in range(1, width):
        h = mixed(h * STEP + w[k : k + n])
    return h


def _sets_of(w: np.ndarray, sizes: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted set of each document, whose words stand in a row in ``w``."""
    h, at = _joined(w, width) if len(w) >= width else w[:0], 0
    for n in sizes.tolist():
        if n >= width:
            yield np.unique(h[at : at + n - width + 1])
        elif n:
            yield _joined(w[at : at + n], n)
        else:
            yield w[:0]
        at += n


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, a slice at a time; slices end at blanks."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data):
            back = np.flatnonzero(_BLANK[data[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                rest = np.flatnonzero(_BLANK[data[end:]])
                end = end + int(rest[0]) if len(rest) else len(data)
        out.append(_word_hashes(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, width: int = 4) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for texts without words and nulls."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        hi = min(hi, len(texts))
        part, begins = data[offsets[lo] : offsets[hi]], offsets[lo:hi] - offsets[lo]
        if len(part) > SLICE:
            w = _long_words(part)
            sizes = np.array([len(w)])
        elif len(part):
            w, starts = _word_hashes(part, begins[begins < len(part)])
            sizes = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
        else:
            w, sizes = np.zeros(0, np.uint64), np.zeros(hi - lo, np.int64)
        yield from _sets_of(w, sizes, width)
        lo = hi
