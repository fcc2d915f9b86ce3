"""Cuckoo filters over 64-bit hashes, many keys at once.

A filter is an array of buckets with four fingerprints of 16 bits. A key's fingerprint
stands in one of two buckets, each of which is found from the other and the fingerprint, so it
can be moved, and taken out again. It never denies a key that it holds.
"""

from __future__ import annotations

import numpy as np

from .shingles import mixed

SLOTS = 4
#: Fullest a filter may get before it is built anew with more buckets.
FULL = 0.85
ROUNDS = 500


def buckets_for(keys: int) -> int:
    """A power of two of buckets that holds so many keys."""
    return 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * FULL)))))


class CuckooFilter:
    def __init__(self, table: np.ndarray):
        self.table = table.reshape(-1, SLOTS)
        self.mask = np.uint64(len(self.table) - 1)

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        """A filter that holds these distinct keys."""
        n = buckets_for(len(hashes))
        while True:  # more buckets always end it
            made = cls(np.zeros(n * SLOTS, np.uint16))
            if made.insert(hashes):
                return made
            n *= 2

    @classmethod
    def from_bytes(cls, body: bytes) -> CuckooFilter:
        return cls(np.frombuffer(body, np.uint16).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def has_room(self, more: int) -> bool:
        return np.count_nonzero(self.table) + more <= FULL * self.table.size

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.view(np.uint64)
        mark = np.maximum(h >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        return mark, (h & self.mask).astype(np.int64)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(mark.astype(np.uint64)) & self.mask).astype(np.int64)

    def _fill(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put what finds a free slot into its bucket; true for the rest."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        turn = np.arange(len(b)) - np.searchsorted(b, b)
        taken = self.table[b] != 0
        fits = turn < SLOTS - taken.sum(1)
        slot = np.argsort(taken, axis=1, kind="stable")[np.arange(len(b)), np.minimum(turn, SLOTS - 1)]
        self.table[b[fits], slot[fits]] = mark[order][fits]
        rest = np.zeros(len(b), bool)
        rest[order[~fits]] = True
        return rest

    def insert(self, hashes: np.ndarray) -> bool:
        """Add keys that it doesn't hold yet; false when it is too full, and then it must be built anew."""
        mark, bucket = self._places(hashes)
        draw = np.random.default_rng(len(hashes))
        for _ in range(ROUNDS):
            for _ in range(2):
                rest = self._fill(mark, bucket)
                mark, bucket = mark[rest], bucket[rest]
                if not len(mark):
                    return True
                bucket = self._other(mark, bucket)
            own, first = np.unique(bucket, return_index=True)  # one a bucket takes the place of another
            slot = draw.integers(0, SLOTS, len(own))
            out = self.table[own, slot].copy()
            self.table[own, slot] = mark[first]
            mark[first], bucket[first] = out, self._other(out, own)
        return False

    def remove(self, hashes: np.ndarray) -> None:
        """Take out keys that it holds."""
        mark, bucket = self._places(hashes)
        while len(mark):
            other = self._other(mark, bucket)
            pair = np.minimum(bucket, other).astype(np.uint64) << np.uint64(16) | mark.astype(np.uint64)
            _, first = np.unique(pair, return_index=True)  # equal pairs take out one copy a round
            m, a, b = mark[first], bucket[first], other[first]
            in_a = self.table[a] == m[:, None]
            where = np.where(in_a.any(1), a, b)
            hit = self.table[where] == m[:, None]
            found = hit.any(1)
            self.table[where[found], hit.argmax(1)[found]] = 0
            rest = np.ones(len(mark), bool)
            rest[first] = False
            mark, bucket = mark[rest], bucket[rest]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        mark, bucket = self._places(hashes)
        same = lambda b: (self.table[b] == mark[:, None]).any(1)
        return same(bucket) | same(self._other(mark, bucket))
