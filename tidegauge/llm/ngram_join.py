"""Similarity join on word shingles by T-occurrence search in the manner of DivideSkip.

Documents with n shingles can only link to those that share T = ceil(threshold * n) of
them. A document's inverted lists are divided: its L longest are skipped, and partners
stand on at least T - L of the others, the short ones. L is chosen by cost: T - 1 would
leave the fewest lists to merge and ask for one occurrence; an eighth more lists are
merged than that leaves, which costs an eighth more rows, and as many more occurrences are asked for
(``_occurrences``). The short lists are merged by Spark's sort on the shingle, which
spills, instead of a heap in memory; occurrences are counted by pair. Candidates
that reach T - L are probed in the long lists by binary search. "Is y on the list of g" and "is g in the
sorted shingles of y" are the same bit; the search reads the latter, which is stored
with the candidate.

Lists count as long in two steps. A table of counters over all shingles finds the very
frequent ones. The lists of the documents' short shingles are then measured exactly, and those of over ``LONGER`` classes
count as long too; documents that had one choose their short lists again, from their
text. Both tables have a fixed size; any order of shingles that all documents share
gives the same result.

Documents with equal sets are one class, and all that follows is done on classes. Two
exact bounds prune candidates before their sets are read: the sizes, and the parities
of groups of shingles, about as many as shingles, which differ in no more places than
the sets do.

Components are wanted, not all pairs. A list of up to ``SHORT`` classes gives its pairs.
A longer one, as large groups of near copies make them, gives each member's pair with
one head, drawn by a hash for each list. When components are known, the members outside
of a list's largest component are its queries, which are tried with all members in
blocks of ``BLOCK``; lists that lie in one component are done. No link between different
components is lost, and no list is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import bit_array, bit_is_set, may_repeat, repeats
from .common import release, rows_without, settle
from .components import components
from .shingles import STEP, mixed, shingle_sets

WIDTH, PERCENT = 4, 85
#: log2 of the counters of shingles, and of the least number of parities of a set.
COUNTER_BITS, PARITY_BITS = 20, 8
#: Members of a list that gives all its pairs, and of a block of a longer one.
SHORT, BLOCK = 12, 2048
#: Lists of more classes are chosen last, and log2 of the slots of the table that tells which.
LONGER, LEVEL_BITS = 4, 22
#: How many times as many parities the members of long lists have.
FINER = 4
#: Pairs whose parities are compared at once, and 64-bit words of parities.
AT_ONCE, WORDS_AT_ONCE = 1 << 15, 1 << 19
#: log2 of the bits that mark texts whose sets are read again.
MARK_BITS = 22
#: log2 of the bits, at most, that tell which sets may occur again; there are 16 for each row until then.
REPEAT_BITS = 27
_MASK, _LEVEL_MASK = np.uint64((1 << COUNTER_BITS) - 1), np.uint64((1 << LEVEL_BITS) - 1)


def _frequent(texts: DataFrame, width: int) -> np.ndarray:
    """The level of each counter: 0, or the more the oftener its shingles occur.

    A task counts its documents' shingles in a table and reports what stands out from
    its mean; sums are grouped by counter, so at most one row for each reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for b in batches:
            held, size = [], 0
            for s in shingle_sets(b.column("text"), width):
                held.append(s)
                size += len(s)
                if size > 1 << 20:
                    counts += np.bincount((np.concatenate(held) & _MASK).astype(np.int64), minlength=len(counts))
                    held, size = [], 0
            if size:
                counts += np.bincount((np.concatenate(held) & _MASK).astype(np.int64), minlength=len(counts))
        slots = np.flatnonzero(counts > max(8.0, 4 * counts.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(counts[slots], pa.int64())], ["slot", "n"])

    found = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    level = np.zeros(1 << COUNTER_BITS, np.uint8)
    if len(found):
        level[found["slot"].to_numpy(np.int64)] = np.log2(found["n"].to_numpy(float)).astype(np.uint8) + 1
    return level


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _parities(s: np.ndarray, finer: int = 1) -> bytes:
    """Bit g tells whether the set has an odd number of shingles in group g, of 2^k >= n groups (``finer`` times as many)."""
    groups = finer << max(PARITY_BITS, (max(1, len(s)) - 1).bit_length())
    odd = np.bincount(((s >> np.uint64(COUNTER_BITS)) & np.uint64(groups - 1)).astype(np.int64), minlength=groups) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """In how many groups the parities of each two differ; more groups are folded into fewer."""
    sizes = np.array([list(map(len, left)), list(map(len, right))])
    out = np.zeros(sizes.shape[1], np.int64)
    for x, y in {(int(a), int(b)) for a, b in sizes.T}:
        at = np.flatnonzero((sizes[0] == x) & (sizes[1] == y))
        for lo in range(0, len(at), AT_ONCE):
            rows = at[lo : lo + AT_ONCE]
            m, n = (np.frombuffer(b"".join(side[i] for i in rows.tolist()), np.uint64).reshape(len(rows), -1) for side in (left, right))
            m, n = _folded(m, n.shape[1]), _folded(n, m.shape[1])
            out[rows] = np.bitwise_count(m ^ n).sum(1, dtype=np.int64)
    return out


def _folded(m: np.ndarray, width: int) -> np.ndarray:
    while m.shape[1] > width:
        half = m.shape[1] // 2
        m = m[:, :half] ^ m[:, half:]
    return m


def _possible(na: np.ndarray, nb: np.ndarray, left: list[bytes], right: list[bytes], percent: int) -> np.ndarray:
    """Which pairs sizes and parities allow to link."""
    need = -(-percent * (na + nb) // (100 + percent))
    ok = np.minimum(na, nb) >= need
    at = np.flatnonzero(ok)
    ok[at] = _distances([left[i] for i in at.tolist()], [right[i] for i in at.tolist()]) <= (na + nb - 2 * need)[at]
    return ok


def _forest(u: np.ndarray, v: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of the edges of a least spanning forest, by rounds in which each tree takes its least edge."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(ends, 2)
    order = np.argsort(far, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    root, kept = list(range(len(names))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    while True:
        label = np.fromiter(map(find, range(len(names))), np.int64, len(names))
        live = np.flatnonzero(label[a] != label[b])
        if not len(live):
            return np.array(kept, np.int64)
        least = np.full(len(names), len(order), np.int64)
        np.minimum.at(least, label[a[live]], place[live])
        np.minimum.at(least, label[b[live]], place[live])
        for e in order[np.unique(least[least < len(order)])].tolist():
            x, y = find(int(a[e])), find(int(b[e]))
            if x != y:
                root[x] = y
                kept.append(e)


def _occurrences(n, percent: int):
    """T - L: on how many of the short lists of a set of size ``n`` (and of partners no smaller) a partner stands at least."""
    return 1 + (n - -(-percent * n // 100) + 1) // 8


def _divided(s: np.ndarray, level: np.ndarray, measured: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the n - L short lists, apart from those among them that were measured as long."""
    n = len(s)
    if not n:
        return s, s
    rank = np.maximum(level[(s & _MASK).astype(np.int64)], measured[(s & _LEVEL_MASK).astype(np.int64)])
    ordered = s[np.lexsort((s, rank))] if rank.any() else s
    taken = ordered[: min(n, n - -(-percent * n // 100) + _occurrences(n, percent))]
    long = measured[(taken & _LEVEL_MASK).astype(np.int64)] > 0
    return taken[~long], taken[long]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.append(0, np.cumsum([len(x) for x in arrays]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(np.concatenate(arrays)) if arrays else np.zeros(0, np.int64)))


def _profiles(texts: DataFrame, level: np.ndarray, width: int, percent: int) -> DataFrame:
    """Per row: size, two sums that identify the set, its short lists and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(1 << LEVEL_BITS, np.uint8)
        for b in batches:
            sizes, sums, lists, parities = [], [], [], []
            for s in shingle_sets(b.column("text"), width):
                sizes.append(len(s))
                sums.append((mixed(s).sum(dtype=np.uint64), mixed(s * STEP + STEP).sum(dtype=np.uint64)))
                lists.append(_divided(s, level, none, percent)[0])
                parities.append(_parities(s))
            first, second = (_signed(np.array([x[k] for x in sums], np.uint64)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(first), pa.array(second), _lists(lists), pa.array(parities, pa.binary())], ["id", "text_hash", "n", "s1", "s2", "lists", "parity"])

    return texts.mapInArrow(run, "id long, text_hash long, n long, s1 long, s2 long, lists array<long>, parity binary")


def _measured(classes: DataFrame) -> np.ndarray:
    """The level of each slot: 0, or the more the longer the longest of its lists of over ``LONGER`` classes.

    Lists are measured exactly, by a grouped count; at most one row for each slot reaches the driver.
    """
    long = classes.select(F.explode("lists").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > LONGER)
    slots = long.groupBy(F.col("shingle").bitwiseAND((1 << LEVEL_BITS) - 1).alias("slot")).agg(F.max("n").alias("n")).toPandas()
    out = np.zeros(1 << LEVEL_BITS, np.uint8)
    if len(slots):
        out[slots["slot"].to_numpy(np.int64)] = np.log2(slots["n"].to_numpy(float)).astype(np.uint8) + 1
    return out


def _whole_lists(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns of whole lists, of rows sorted by list (the first column); what ends a batch waits for the next."""
    rest: list[np.ndarray] | None = None
    for b in batches:
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if cut:
            yield [c[:cut] for c in cols]
        rest = [c[cut:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def _bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(key)) + 1
    return np.append(0, edge), np.append(edge, len(key))


def _merged(percent: int):
    """What each shingle's list gives, from rows sorted by (shingle, n, node): pairs, with the occurrences that they need, or the members of a long list with its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, n, node in _whole_lists(batches, ("shingle", "n", "node")):
            begin, end = _bounds(shingle)
            size = end - begin
            a, b, need = [], [], []
            for m in range(2, SHORT + 1):
                at = begin[size == m]
                for i in range(m):
                    for j in range(i + 1, m):
                        ok = at[n[at + i] * 100 >= percent * n[at + j]]
                        a.append(node[ok + i])
                        b.append(node[ok + j])
                        need.append(_occurrences(n[ok + i], percent))
            length = [np.zeros(sum(map(len, a)), np.int64)]
            for lo, hi in zip(begin[size > SHORT].tolist(), end[size > SHORT].tolist(), strict=True):
                a.append(np.full(hi - lo, shingle[lo]))
                b.append(node[lo:hi])
                need.append(np.ones(hi - lo, np.int64))
                length.append(np.full(hi - lo, hi - lo))
            a, b, need, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, need, length))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, need, length)], ["a", "b", "need", "length"])

    return run


def _pruned(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs that sizes and parities allow."""
    spot = lambda c: F.xxhash64(c).bitwiseAND((1 << MARK_BITS) - 1)
    marks = bit_array(pairs.select(F.explode(F.array("a", "b")).alias("node")).select(spot("node").alias("p")), MARK_BITS).scalar()
    slim = classes.select("node", "n", "parity").where(bit_is_set(marks, spot("node")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            na, nb = (t.column(c).to_numpy() for c in ("na", "nb"))
            keep = pa.array(_possible(na, nb, t.column("pa").to_pylist(), t.column("pb").to_pylist(), percent))
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], ["a", "b"])

    both = pairs.join(slim.toDF("a", "na", "pa"), "a").join(slim.toDF("b", "nb", "pb"), "b")
    return both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def _first_texts(nodes: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """``node``, ``n`` and the text of each class of ``nodes``, from its first document; repeated rows may give a class twice.

    Texts that aren't wanted are passed over by a bit array of fixed size before any is shuffled.
    """
    wanted = settle(classes.join(nodes, "node").select("node", "n", F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("text_hash")), "ngram-wanted")
    spot = F.col("text_hash").bitwiseAND((1 << MARK_BITS) - 1)
    marks = bit_array(wanted.select(spot.alias("p")), MARK_BITS).scalar()
    near = texts.where(bit_is_set(marks, spot))
    return near.join(wanted, (near["text_hash"] == wanted["text_hash"]) & near["id"].eqNullSafe(wanted["first_id"])).select("node", "n", "text")


def _sets(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``node`` and its sorted set, for the classes of ``pairs``."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.tobytes() for s in shingle_sets(b.column("text"), width)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], ["node", "set"])

    return settle(_first_texts(nodes, classes, texts).select("node", "text").mapInArrow(run, "node long, set binary"), "ngram-sets")


def _unchanged(classes: DataFrame, measured: np.ndarray) -> DataFrame:
    """``node``, ``n`` and ``lists`` of the classes that have no measured list among their short ones; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("lists")
            ends = np.asarray(lists.offsets).astype(np.int64)
            flags = measured[(np.asarray(lists.values).view(np.uint64) & _LEVEL_MASK).astype(np.int64)] > 0
            hits = np.append(0, np.cumsum(flags))
            yield b.filter(pa.array(hits[ends[1:]] == hits[ends[:-1]]))

    return classes.select("node", "n", "lists").mapInArrow(run, "node long, n long, lists array<long>")


def _chosen_again(classes: DataFrame, texts: DataFrame, level: np.ndarray, measured: np.ndarray, width: int, percent: int) -> DataFrame:
    """Of the classes that had a measured list among their short ones: ``node``, ``n``, ``lists``, ``long`` (those of the new short lists that are long all the same) and, with any such, finer parities.

    All texts are read once more in place; only the lists of documents that have changed are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(1 << LEVEL_BITS, np.uint8)
        for b in batches:
            at, short, long, fine = [], [], [], []
            for i, s in enumerate(shingle_sets(b.column("text"), width)):
                if not measured[(_divided(s, level, none, percent)[0] & _LEVEL_MASK).astype(np.int64)].any():
                    continue
                x, y = _divided(s, level, measured, percent)
                at.append(i)
                short.append(x)
                long.append(y)
                fine.append(_parities(s, FINER) if len(y) else None)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("text_hash").take(at), _lists(short), _lists(long), pa.array(fine, pa.binary())], ["id", "text_hash", "lists", "long", "fine"])

    # a document is named by plain columns, so that the join and the removal of repeated rows share a shuffle
    name = lambda c, of: [of.alias("text_hash"), F.coalesce(c, F.lit(0).cast("long")).alias("id0"), c.isNull().alias("no_id")]
    found = texts.mapInArrow(run, "id long, text_hash long, lists array<long>, long array<long>, fine binary")
    found = found.select(*name(F.col("id"), F.col("text_hash")), "lists", "long", "fine")
    of = classes.select("node", "n", *name(F.col("first.id"), F.col("first.text_hash")))
    keys = ["text_hash", "id0", "no_id"]
    return settle(found.join(of, keys).dropDuplicates(keys).select("node", "n", "lists", "long", "fine"), "ngram-again")


def _probed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column("sa"), t.column("sb"), strict=True):
                small, big = sorted((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)), key=len)
                at = np.searchsorted(big, small)
                at[at == len(big)] = 0
                shared = int((big[at] == small).sum()) if len(big) else 0
                ok.append((100 + percent) * shared >= percent * (len(small) + len(big)))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], ["a", "b"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return settle(both.select("a", "b", "sa", "sb").mapInArrow(_probed(percent), "a long, b long"), "ngram-links")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that ``roots`` doesn't connect yet."""
    both = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    return both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _verified(pairs: DataFrame, links: DataFrame | None, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Links and roots when ``pairs`` have been tried: first each class's pair with its smallest partner, then what is still apart."""
    if pairs.isEmpty():
        return links, components(links) if links is not None else None
    sets = _sets(pairs, classes, texts, width)  # sorted, for the binary search
    first = settle(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "ngram-first")
    new = _linked(first, sets, percent)
    links = new if links is None else links.unionByName(new)
    roots = components(links)
    rest = settle(_apart(pairs.join(first, ["a", "b"], "left_anti"), roots), "ngram-rest")
    if not rest.isEmpty():
        links = links.unionByName(_linked(rest, sets, percent))
        roots = components(links)
    release(first, rest, sets)
    return links, roots


def _words(parity: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: the places of the parities that have it, and them as a matrix of 64-bit words."""
    sizes = np.fromiter(map(len, parity), np.int64, len(parity))
    out = {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[size] = at, np.frombuffer(b"".join(parity[i] for i in at.tolist()), np.uint64).reshape(len(at), -1)
    return out


def _tried(n: np.ndarray, node: np.ndarray, root: np.ndarray, query: np.ndarray, member: np.ndarray, minor: np.ndarray, parity: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of a query, of a member in another component that both bounds allow it, and how far they are apart."""
    found = _words(parity)
    for size, (at, words) in found.items():
        left = np.flatnonzero(query[at])
        for other, (there, their) in found.items():
            right = np.flatnonzero(member[there])
            if not len(left) or not len(right):
                continue
            x, y, j = _folded(words, their.shape[1]), _folded(their, words.shape[1]), there[right]
            step = max(1, WORDS_AT_ONCE // (y.shape[1] * len(right)))
            for lo in range(0, len(left), step):
                rows = left[lo : lo + step]
                i = at[rows]
                both = n[i][:, None] + n[j][None, :]
                need = -(-percent * both // (100 + percent))
                ok = (np.minimum(n[i][:, None], n[j][None, :]) >= need) & (root[i][:, None] != root[j][None, :])
                ok &= ~minor[j][None, :] | (node[i][:, None] < node[j][None, :])  # two queries meet once
                if ok.any():
                    far = np.bitwise_count(x[rows][:, None, :] ^ y[right][None, :, :]).sum(2, dtype=np.int64)
                    r, c = np.nonzero(ok & (far <= both - 2 * need))
                    yield i[r], j[c], far[r, c]


def _across(percent: int, every: bool):
    """Pairs of a query and a member of a block of a long list, in different components, that pass both bounds.

    All of them with ``every``, else a least spanning forest of those between the
    components: no more pairs than components, and all that they need if the bounds don't deceive.
    """

    def named(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(i), AT_ONCE):
            x, y = node[i[at : at + AT_ONCE]], node[j[at : at + AT_ONCE]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("list", "n", "node", "root", "query", "member", "minor", "parity")
        for key, *all_columns in _whole_lists(batches, columns):
            for lo, hi in zip(*(x.tolist() for x in _bounds(key)), strict=True):
                n, node, root, query, member, minor, parity = (c[lo:hi] for c in all_columns)
                held = np.zeros((0, 3), np.int64)
                for found in _tried(n, node, root, query, member, minor, parity.tolist(), percent):
                    if every:
                        yield from named(node, *found[:2])
                        continue
                    held = np.concatenate([held, np.stack(found, 1)])
                    if len(held) > WORDS_AT_ONCE:
                        held = held[_forest(root[held[:, 0]], root[held[:, 1]], held[:, 2])]
                held = held[_forest(root[held[:, 0]], root[held[:, 1]], held[:, 2])]
                yield from named(node, held[:, 0], held[:, 1])

    return run


def _long_list_pairs(members: DataFrame, roots: DataFrame | None, parities: DataFrame, percent: int, every: bool) -> DataFrame:
    """What long lists still have to offer when ``roots`` are known; ``members``: shingle and node.

    The members outside of a list's largest component are its queries. Of lists with the
    same members one is enough. Up to ``BLOCK`` queries and as many members meet in a
    group, so a list of m members and q queries makes m * ceil(q / BLOCK) + q * ceil(m / BLOCK) rows.
    """
    if roots is None:
        at = members.withColumn("root", F.col("node"))
    else:
        at = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    marks = {f"x{k}": F.xxhash64("node", F.lit(k)) for k in range(2)}
    sizes = at.groupBy("shingle", "root").agg(F.count("*").alias("size"), *[F.bit_xor(m).alias(x) for x, m in marks.items()])
    lists = sizes.groupBy("shingle").agg(F.max_by("root", F.struct("size", "root")).alias("major"), F.sum("size").alias("all"), F.max("size").alias("most"), *[F.bit_xor(x).alias(x) for x in marks])
    lists = lists.where(F.col("all") > F.col("most")).groupBy("all", *marks).agg(F.min(F.struct("shingle", "major", "most")).alias("one"))
    lists = lists.select("one.shingle", "one.major", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("one.most")) / BLOCK).cast("int").alias("asked"))
    at = at.join(lists, "shingle").join(parities, "node").withColumn("minor", F.col("root") != F.col("major"))
    one = F.col("blocks") == 1
    small = at.where(one).select(F.col("shingle").alias("list"), "n", "node", "root", F.col("minor").alias("query"), F.lit(True).alias("member"), "minor", "parity")
    spot = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    copied = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    wide = ["shingle", "n", "node", "root", "minor", "parity"]
    asked = at.where(~one & F.col("minor")).select(*wide, spot("asked").alias("q"), copied("blocks").alias("m"), F.lit(True).alias("query"), F.lit(False).alias("member"))
    held = at.where(~one).select(*wide, copied("asked").alias("q"), spot("blocks").alias("m"), F.lit(False).alias("query"), F.lit(True).alias("member"))
    large = asked.unionByName(held).select(F.xxhash64("shingle", "q", "m").alias("list"), "n", "node", "root", "query", "member", "minor", "parity")
    both = small.unionByName(large).repartition("list").sortWithinPartitions("list")
    return both.mapInArrow(_across(percent, every), "a long, b long").distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """id, ``text_hash``, ``n_shingles``, ``component_id``, ``class_size`` and ``first`` of each row.

    Two documents link when 100 * intersection >= ``percent`` * union of their shingle
    sets. ``component_id`` is the smallest id that links reach, the own one included.
    ``first`` (id and text_hash) is the row that stands for the component: the smallest id,
    null last. Texts that are null or without words have an empty set, link with nothing
    and stand for themselves. Repeated rows are in one class. An empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    level = _frequent(texts, width)
    rows = settle(_profiles(texts, level, width, percent), "ngram-rows")
    key = ["n", "s1", "s2"]
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))
    full, named_by = rows.where("n > 0"), F.xxhash64(*key)
    bits = min(REPEAT_BITS, max(16, (16 * rows.count()).bit_length()))  # rows whose set may occur again are grouped, the others are classes as they are
    twice = may_repeat(repeats(full.select(named_by.alias("h")), bits).scalar(), named_by, bits)
    marked = full.withColumn("twice", twice)
    grouped = marked.where("twice").groupBy(*key).agg(first.alias("first"), F.count("*").alias("class_size"), F.any_value("lists").alias("lists"), F.any_value("parity").alias("parity"))
    alone = marked.where("not twice").select(*key, F.struct(F.col("id").isNull().alias("none"), "id", "text_hash").alias("first"), F.lit(1).cast("long").alias("class_size"), "lists", "parity")
    classes = settle(grouped.unionByName(alone).withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    measured = _measured(classes)
    again = _chosen_again(classes, texts, level, measured, width, percent)
    same = _unchanged(classes, measured).withColumn("long", F.array().cast("array<long>"))
    flagged = lambda c, long: F.transform(c, lambda g: F.struct(g.alias("shingle"), F.lit(long).alias("long")))
    every = same.unionByName(again.select("node", "n", "lists", "long")).select(F.explode(F.concat(flagged("lists", False), flagged("long", True))).alias("p"), "n", "node").select("p.*", "n", "node")
    short, known = every.where("not long").drop("long"), settle(every.where("long").drop("long"), "ngram-known")
    known = known.join(known.groupBy("shingle").agg(F.count("*").alias("length")).where("length > 1"), "shingle")
    postings = short.unionByName(known.where(F.col("length") <= SHORT).drop("length")).repartition("shingle").sortWithinPartitions("shingle", "n", "node")
    merged = settle(postings.mapInArrow(_merged(percent), "a long, b long, need long, length long"), "ngram-merged")
    members = merged.where("length > 0").select(F.col("a").alias("shingle"), F.col("b").alias("node"), "length")
    members = settle(members.unionByName(known.where(F.col("length") > SHORT).select("shingle", "node", "length")), "ngram-members")
    heads = members.groupBy("shingle").agg(F.min_by("node", F.xxhash64("node", "shingle")).alias("head"))
    starred = members.join(heads, "shingle").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).where("a < b")
    counted = merged.where("length = 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"), F.first("need").alias("need")).where(F.col("n") >= F.col("need"))
    tried = settle(counted.select("a", "b").unionByName(starred).distinct(), "ngram-tried")
    links, roots = _verified(settle(_pruned(tried, classes, percent), "ngram-pairs"), None, classes, texts, width, percent)
    parities = classes.select("node", "n", "parity").join(again.where("fine is not null").select("node", "fine"), "node", "left").select("node", "n", F.coalesce("fine", "parity").alias("parity"))
    for whole in (False, True):  # the last pass tries all that the first left apart
        across = settle(_long_list_pairs(members.select("shingle", "node"), roots, parities, percent, whole), "ngram-across")
        if across.isEmpty():
            break
        links, roots = _verified(across, links, classes, texts, width, percent)
        release(across)
    named = classes.select(*key, "node", "first", "class_size")
    if roots is None:
        named = named.withColumn("root", F.col("node"))
    else:
        named = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tops = named.groupBy("root").agg(F.min("first").alias("top"))
    named = settle(named.join(tops, "root").select(*key, "class_size", "top"), "ngram-named")
    release(classes, again, known, merged, members, tried)
    own = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    out = ["id", "text_hash", "n"]
    empty = rows.where("n = 0").select(*out, F.lit(1).cast("long").alias("class_size"), own.alias("top"))
    full = rows.where("n > 0").drop("lists", "parity").join(named, key).select(*out, "class_size", "top")
    return empty.unionByName(full).select(F.col("id").alias(id_col), "text_hash", F.col("n").alias("n_shingles"), F.col("top.id").alias("component_id"), "class_size", F.struct("top.id", "top.text_hash").alias("first"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with all their columns.

    Of a component one document stays, the one with the smallest id; rows that repeat it
    (the same id and text) stay with it. Rows to drop are marked in a bit array of fixed
    size, so the texts of most rows that stay aren't shuffled.
    """
    groups = similar_groups(docs, id_col, text_col, width, percent)
    mine = F.col(f"`{id_col}`").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    gone = settle(groups.where(~mine).select(F.col(f"`{id_col}`").alias("id"), "text_hash").distinct(), "ngram-gone")
    return rows_without(docs, gone, id_col, text_col)
