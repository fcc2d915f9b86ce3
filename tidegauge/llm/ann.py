"""Maximum inner product search by score-aware anisotropic quantisation.

Vectors are cut into subspaces of a few dimensions and each part is replaced by one of
16 codewords, so two parts share a byte. Codes and codewords are chosen to minimise not
the residual's length but ``||r||^2 + (eta - 1) <r, x>^2 / ||x||^2``: error along the
vector, which shifts large inner products, costs ``eta`` times as much as error across
it. A query adds table entries for all codes (a table of 256 entries for each byte, from
two of 16), the best candidates are reranked by the inner product of the original
vectors in double precision.

Codebooks are fitted on at most ``SAMPLE`` vectors, in the order of a hash of the id;
every vector is coded and searched. Queries and candidates meet block by block: a task
holds ``QUERY_BLOCK`` queries and ``BLOCK`` candidates, and returns the k nearest of its
block for each of its queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that codebooks are fitted on, and rounds of fitting.
SAMPLE, FIT_ROUNDS = 8_192, 6
#: Dimensions of a subspace, codewords of a subspace.
WIDTH, CODES = 2, 16
#: The norm-relative inner product above which a pair counts as a match; it sets eta.
MATCH = 0.3
BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Candidates of a block that are reranked for each query.
RERANK = 400
#: Queries scored at once.
AT_ONCE = 64


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the rows that take part.

    Vectors that are null, empty, zero or hold a null or non-finite component take no
    part, nor do rows without an id, nor vectors of another length than most (of
    lengths equally frequent, the larger).
    """
    v = F.col("v")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(~odd & F.exists(v, lambda x: x != 0))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (top[0] if top else 0))


@dataclass(frozen=True)
class Quantizer:
    """``books[s]`` are the codewords of subspace s; the vector is padded with zeros to whole subspaces."""

    books: np.ndarray
    extra: float
    dim: int

    @staticmethod
    def _parts(x: np.ndarray, width: int = WIDTH) -> np.ndarray:
        n, d = x.shape
        parts = -(-d // width)
        parts += parts % 2
        out = np.zeros((n, parts * width))
        out[:, :d] = x
        return out.reshape(n, parts, width)

    @staticmethod
    def fit(x: np.ndarray, match: float = MATCH, rounds: int = FIT_ROUNDS, seed: int = 7) -> Quantizer:
        d = x.shape[1]
        eta = max(1.0, (d - 1) * match**2 / (1 - match**2))
        parts = Quantizer._parts(x)
        rng = np.random.default_rng(seed)
        pick = rng.choice(len(x), CODES, replace=len(x) < CODES)
        books = parts[pick].transpose(1, 0, 2).copy()
        q = Quantizer(books, eta - 1, d)
        for _ in range(rounds):
            codes = q.codes(x)
            q = Quantizer(q._refit(parts, codes), eta - 1, d)
        return q

    def _refit(self, parts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """For each codeword the least-squares solution over its vectors, the other parts being fixed."""
        books, pull = self.books.copy(), self.extra / (parts**2).sum((1, 2))
        n, m, w = parts.shape
        along = np.stack([((parts[:, s] - books[s, codes[:, s]]) * parts[:, s]).sum(1) for s in range(m)], 1)
        total = along.sum(1)
        for s in range(m):
            x = parts[:, s]
            others = total - along[:, s]
            a = pull[:, None, None] * x[:, :, None] * x[:, None, :] + np.eye(w)
            b = x + (pull * (others + (x * x).sum(1)))[:, None] * x
            for c in range(CODES):
                mine = codes[:, s] == c
                if mine.any():
                    books[s, c] = np.linalg.solve(a[mine].sum(0), b[mine].sum(0))
            now = ((x - books[s, codes[:, s]]) * x).sum(1)
            total += now - along[:, s]
            along[:, s] = now
        return books

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, begun at the nearest codewords."""
        parts = self._parts(x)
        n, m, _ = parts.shape
        pull = self.extra / (parts**2).sum((1, 2))
        miss, along = np.empty((m, n, CODES)), np.empty((m, n, CODES))
        for s in range(m):
            r = parts[:, s, None, :] - self.books[s][None]
            miss[s], along[s] = (r * r).sum(2), (r * parts[:, s, None, :]).sum(2)
        codes = miss.argmin(2)
        rows = np.arange(n)
        total = sum(along[s, rows, codes[s]] for s in range(m))
        for _ in range(sweeps):
            for s in range(m):
                others = total - along[s, rows, codes[s]]
                codes[s] = (miss[s] + pull[:, None] * (others[:, None] + along[s]) ** 2).argmin(1)
                total = others + along[s, rows, codes[s]]
        return codes.T.astype(np.uint8)

    def packed(self, x: np.ndarray) -> np.ndarray:
        c = self.codes(x)
        return c[:, ::2] | (c[:, 1::2] << 4)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(query, byte, 256): what each pair of codes adds to the inner product."""
        one = np.einsum("qsw,scw->qsc", self._parts(queries), self.books).astype(np.float32)
        return (one[:, 1::2, :, None] + one[:, ::2, None, :]).reshape(len(queries), -1, 256)


def fit_quantizer(vectors: DataFrame, sample: int = SAMPLE) -> Quantizer | None:
    """Fit on at most ``sample`` vectors. A cut by a hash of the id leaves about that many before they are ordered, so the driver isn't sent as many from each partition."""
    cut = min(1 << 30, math.ceil((1 << 30) * 1.2 * sample / max(1, vectors.count())))
    chosen = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < cut)
    rows = chosen.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(sample).collect()
    return Quantizer.fit(np.array([r.v for r in rows])) if rows else None


def encode(vectors: DataFrame, quantizer: Quantizer) -> DataFrame:
    """The index: ``vec_id``, ``v`` and ``code`` (two subspaces a byte) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = np.array(part.column("v").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array([c.tobytes() for c in quantizer.packed(x)], pa.binary())], ["vec_id", "v", "code"])

    return vectors.mapInArrow(run, "vec_id long, v array<double>, code binary")


def _nearest(quantizer: Quantizer, k: int, rerank: int):
    def run(key: tuple, queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(found):
            found = found.sort_values("vec_id", kind="stable")
            ids, x = found["vec_id"].to_numpy(np.int64), np.stack(found["v"].to_numpy())
            codes = np.frombuffer(b"".join(found["code"]), np.uint8).reshape(len(ids), -1)
            columns = [np.ascontiguousarray(codes[:, j]) for j in range(codes.shape[1])]
            asked, q = queries["vec_id"].to_numpy(np.int64), np.stack(queries["v"].to_numpy())
            keep = min(len(ids), rerank + 1)
            for lo in range(0, len(asked), AT_ONCE):
                tables = quantizer.tables(q[lo : lo + AT_ONCE])
                for i, t in enumerate(tables, lo):
                    score = np.zeros(len(ids), np.float32)
                    for j, c in enumerate(columns):
                        score += t[j].take(c)
                    edge = np.partition(score, len(ids) - keep)[len(ids) - keep]
                    above = np.flatnonzero(score > edge)
                    # of equal scores the smaller ids, which come first
                    best = np.concatenate([above, np.flatnonzero(score == edge)[: keep - len(above)]])
                    best = best[ids[best] != asked[i]]
                    exact = x[best] @ q[i]
                    order = np.lexsort((ids[best], -exact))[:k]
                    out.append((np.full(len(order), asked[i]), ids[best[order]], exact[order]))
        cat = lambda j, t: np.concatenate([o[j] for o in out]) if out else np.array([], t)
        return pd.DataFrame({"query_id": cat(0, np.int64), "vec_id": cat(1, np.int64), "score": cat(2, float)})

    return run


def search(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK, block: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k nearest found of each query.

    Queries are the rows of ``is_query`` (a condition on ``vec_id``). Every other row is
    a candidate. Ties go to the smaller id; repeated rows are taken once, with the
    smallest vector of an id. An empty table, or one without a valid vector, gives an
    empty result.
    """
    vectors = valid_vectors(table, id_col, vector_col)
    quantizer = fit_quantizer(vectors)
    if quantizer is None:
        return vectors.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    unique = vectors.groupBy("vec_id").agg(F.min("v").alias("v"))
    counts = unique.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, query_blocks = max(1, math.ceil(counts[0] / block)), max(1, math.ceil(counts[1] / QUERY_BLOCK))
    of = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = encode(unique, quantizer).select(of(blocks, 1).alias("b"), every(query_blocks).alias("q"), "vec_id", "v", "code")
    queries = unique.where(is_query).select(every(blocks).alias("b"), of(query_blocks, 2).alias("q"), "vec_id", "v")
    local = queries.groupBy("b", "q").cogroup(index.groupBy("b", "q")).applyInPandas(_nearest(quantizer, k, rerank), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
