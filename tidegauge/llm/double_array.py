"""A double-array trie over bytes: state s has child c at ``base[s] + c`` if ``check`` there is s."""

from __future__ import annotations

import numpy as np


class DoubleArray:
    def __init__(self, keys: list[bytes]):
        """``keys``: distinct; the value of a key is its place in the list."""
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        size = 1024 + 2 * sum(map(len, keys))
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], free = 0, 257
        #: where the search for room begins, by the number of children; so it never starts over
        begin = [257] * 9
        todo = [(0, 0, len(order), 0)]  # state, first and end of its keys in the order, depth
        while todo:
            state, lo, hi, depth = todo.pop()
            if len(keys[order[lo]]) == depth:
                value[state] = order[lo]
                lo += 1
            children, i = [], lo
            while i < hi:
                c, j = keys[order[i]][depth], i
                while j < hi and keys[order[j]][depth] == c:
                    j += 1
                children.append((c, i, j))
                i = j
            if not children:
                continue
            while check[free] >= 0:
                free += 1
            many, first = min(len(children), 8), children[0][0]
            at = free if many == 1 else max(free, begin[many])
            while True:
                if at + 256 >= len(check):
                    grow = len(check)
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                b = at - first
                if b > 0 and check[at] < 0 and all(check[b + c] < 0 for c, _, _ in children):
                    break
                at += 1
            base[state], begin[many] = b, at
            for c, i, j in children:
                check[b + c] = state
                todo.append((b + c, i, j, depth + 1))
        used = max(i for i, x in enumerate(check) if x >= 0) + 257
        self.base, self.check, self.value = (np.array((x + [-1] * 257)[:used], np.int32) for x in (base, check, value))
        self.depth = max(map(len, keys), default=0)

    def prefixes(self, data: bytes, at: int) -> list[tuple[int, int]]:
        """(length, value) of the keys that ``data`` has at ``at``, shortest first."""
        out, state = [], 0
        for d, c in enumerate(data[at : at + self.depth], 1):
            nxt = int(self.base[state]) + c
            if nxt >= len(self.check) or self.check[nxt] != state or nxt == 0:
                break
            state = nxt
            if self.value[state] >= 0:
                out.append((d, int(self.value[state])))
        return out
