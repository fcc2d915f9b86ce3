"""Token ids of whole texts by a BPE tokenizer with word ends, remembered run by run.

White space is dropped by this kind of tokenizer and no token spans it or leaves a run of
letters, digits or signs, so a text's ids are those of its runs in a row. Runs are
remembered in one table of bounded size; only unseen and very long ones reach the BPE
model. Texts with characters for which the rules of Python and of the tokenizer might
differ, and texts that hold the name of an added token, go through the tokenizer whole.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable

#: Entries of the table, and characters of a run in it; emptying a full table costs time and changes no ids.
MOST_WORDS, LONGEST = 150_000, 64
#: Everything below U+0250 but the separators U+001C to U+001F and the dotted capital I.
_UNSURE = re.compile("[^\x00-\x1b\x20-įı-ɏ]")


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


def _runs() -> re.Pattern:
    low = {c for i in range(0x250) for c in chr(i).lower()}
    of = lambda kind: "".join(re.escape(c) for c in sorted(low) if unicodedata.category(c)[0] == kind)
    letter, digit = of("L"), of("N")
    return re.compile(rf"[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d|[{digit}]|[^\s{letter}{digit}]+")


class _Remembered(dict):
    """Values made when they are first asked for; those of long keys aren't kept, and a full table is emptied."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[key] = found
        return found


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.names, self.runs = self.whole.model, _byte_names(), _runs()
        self.added = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        self.parts = _Remembered(self._part)

    def _part(self, run: str) -> bytes:
        return _packed([t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(self.names))])

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as unsigned 32-bit little-endian integers, as ``Tokenizer.encode`` gives them without special tokens of its own."""
        low = text.lower()
        if _UNSURE.search(text) or any(name in low for name in self.added):
            return _packed(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.parts.__getitem__, self.runs.findall(low)))


@functools.lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBpe:
    """One for each process, since loading it costs more than a small task."""
    return WordBpe(path)


def _packed(ids: list[int]) -> bytes:
    from array import array

    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()
