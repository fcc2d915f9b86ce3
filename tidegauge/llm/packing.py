"""Packing token sequences by a grouping genetic algorithm on islands.

Texts are tokenized once into pieces; what follows moves only (row, length). Pieces
that fill a sequence are done. The others are dealt into blocks of about ``BLOCK``
pieces by a hash, and each block is a bin packing problem of its own, so memory is
bounded whatever the input. Each block evolves on several islands, each a Spark task: a
chromosome is a list of bins, at first a best fit of the pieces in random order; crossover injects
whole well-filled bins of one parent into the other, removes the bins that hold the same pieces,
and best-fits the displaced pieces. Between rounds each island sends its elite to the
next one. A round has at least ``LEAST`` generations, and then ends when no packing can
have fewer sequences. The best packing of the islands is taken.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, settle
from .word_bpe import word_bpe

CAPACITY, END_ID = 4096, 1
#: Pieces of a block, islands of a block, and rounds of evolution with a migration between them.
BLOCK, ISLANDS, ROUNDS = 4096, 2, 2
POPULATION, GENERATIONS, LEAST = 4, 8, 1
_SHIFT = 1 << 32

Bins = list[list[int]]


def best_fit(order: list[int], lengths: list[int], capacity: int, bins: Bins) -> Bins:
    """Put the items of ``order`` into the fullest bin that has room, or a new one; ``bins`` grows in place."""
    room = sorted((capacity - sum(lengths[i] for i in b)) * _SHIFT + k for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(room, lengths[i] * _SHIFT)
        if at < len(room):
            left, k = divmod(room.pop(at), _SHIFT)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        if left > lengths[i]:
            insort(room, (left - lengths[i]) * _SHIFT + k)
    return bins


def fitness(bins: Bins, lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better; at the same number, fuller and emptier ones rather than equal ones."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(into: Bins, other: Bins, lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    """A child of ``into`` with about half of the well-filled bins of ``other``."""
    ranked = sorted(other, key=lambda b: -sum(lengths[i] for i in b))
    injected = [b for b in ranked[: max(1, len(ranked) * 3 // 4)] if rng.random() < 0.6] or ranked[:1]
    taken = {i for b in injected for i in b}
    child, displaced = [list(b) for b in injected], []
    for b in into:
        if taken.isdisjoint(b):
            child.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    return best_fit(sorted(displaced, key=lambda i: -lengths[i]), lengths, capacity, child)


def mutate(bins: Bins, lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    """Dissolve the emptiest bins and a few others, and best-fit their items anew."""
    ranked = sorted(bins, key=lambda b: sum(lengths[i] for i in b))
    n = max(1, len(ranked) // 20)
    gone = ranked[:n] + rng.sample(ranked[n:], min(n, len(ranked) - n))
    ids = {id(b) for b in gone}
    loose = sorted((i for b in gone for i in b), key=lambda i: -lengths[i] * rng.uniform(0.9, 1))
    return best_fit(loose, lengths, capacity, [list(b) for b in bins if id(b) not in ids])


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[Bins], generations: int = GENERATIONS, population: int = POPULATION) -> tuple[Bins, int]:
    """The best packing found, never worse than the elites, and the number of crossovers."""
    rng = random.Random(seed)
    people = list(elites)
    while len(people) < population:
        people.append(best_fit(rng.sample(range(len(lengths)), len(lengths)), lengths, capacity, []))
    bound, rank, crossed = math.ceil(sum(lengths) / capacity), lambda b: fitness(b, lengths, capacity), 0
    people.sort(key=rank, reverse=True)
    for g in range(generations):
        if g >= LEAST and len(people[0]) <= bound:
            break
        a, b = people[0], rng.choice(people[1:])
        young = [crossover(a, b, lengths, capacity, rng), crossover(b, a, lengths, capacity, rng)]
        crossed += len(young)
        people = sorted([*people, *young, mutate(young[0], lengths, capacity, rng)], key=rank, reverse=True)[:population]
    return people[0], crossed


def _from_columns(pdf: pd.DataFrame) -> list[Bins]:
    """The packings that a group holds, by origin; indices are places in the sorted rows."""
    out = []
    for _, one in pdf.groupby("origin", sort=True):
        bins: Bins = [[] for _ in range(int(one["bin"].max()) + 1)]
        for i, b in enumerate(one["bin"].tolist()):
            bins[b].append(i)
        out.append(bins)
    return out


def _island(capacity: int, round_: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, island = map(int, key)
        pdf = pdf.sort_values(["origin", "row"])
        first = pdf[pdf["origin"] == pdf["origin"].iloc[0]]
        lengths = first["length"].tolist()
        elites = _from_columns(pdf) if round_ else []
        bins, crossed = evolve(lengths, capacity, hash((block, island, round_)), elites)
        where = [0] * len(lengths)
        for k, b in enumerate(bins):
            for i in b:
                where[i] = k
        return pd.DataFrame({"block": block, "island": island, "origin": island, "row": first["row"].to_numpy(), "length": lengths, "bin": where, "crossovers": crossed, "immigrants": max(0, len(elites) - 1)})

    return run


def _best(capacity: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["origin", "row"])
        first = pdf[pdf["origin"] == pdf["origin"].iloc[0]]
        lengths = first["length"].tolist()
        bins = max(_from_columns(pdf), key=lambda b: fitness(b, lengths, capacity))
        rows, seqs, offsets, names = [], [], [], first["row"].tolist()
        for k, b in enumerate(bins):
            at = 0
            for i in sorted(b):
                rows.append(names[i])
                seqs.append(int(key[0]) * _SHIFT + k)
                offsets.append(at)
                at += lengths[i]
        return pd.DataFrame({"row": rows, "sequence_id": seqs, "offset": offsets})

    return run


_STATE = "block int, island int, origin int, row long, length int, bin int, crossovers int, immigrants int"


def evolved(small: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """The packing of each island after the last round, with its number of ``crossovers`` in that round and of ``immigrants`` into it."""
    if islands < 2 or rounds < 2:
        raise ValueError("elites migrate between two islands at least, and between two rounds at least")
    blocks = max(1, math.ceil(small.count() / block))
    dealt = small.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "row", F.col("length").cast("int").alias("length"))
    zero = F.lit(0)
    state = dealt.select("block", "island", F.col("island").alias("origin"), "row", "length", zero.alias("bin"), zero.alias("crossovers"), zero.alias("immigrants"))
    for r in range(rounds):
        before = state
        if r:
            state = state.unionByName(state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")))
        state = settle(state.groupBy("block", "island").applyInPandas(_island(capacity, r), _STATE), "packing-islands")
        release(before)
    return state


def pack_lengths(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """``row``, ``sequence_id`` and ``offset`` for each row (``row`` unique, ``length`` in 1..capacity) of a stored table."""
    alone = pieces.where(F.col("length") >= capacity).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    state = evolved(pieces.where(F.col("length") < capacity), capacity, block, islands, rounds)
    return alone.unionByName(state.groupBy("block").applyInPandas(_best(capacity), "row long, sequence_id long, offset long"))


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, step = word_bpe(path), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = bpe.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``.

    A document is its token ids and ``end_id``; only longer ones are cut, into pieces of
    ``capacity`` ids. Null and empty texts are the end id alone; repeated rows and null
    ids are packed like any other row. ``tokenizer`` is a path that every executor has.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    pieces = texts.mapInArrow(_pieces(tokenizer, capacity, end_id), _PIECE)
    pieces = settle(pieces.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    packed = pack_lengths(pieces.select("row", "length"), capacity)
    return pieces.join(packed, "row").select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
