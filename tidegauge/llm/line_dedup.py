"""Reversible line deduplication: sharded cuckoo filters before exact reference counts.

An index holds, in the shared folder,

* ``refs``: a signed log with a row for each (key, document) that came (1) or went (-1);
* ``counts``: how many documents hold each key, and the smallest of them;
* ``filters``: for each shard of keys a cuckoo filter of the keys that are held at all
  (``present``) and one of those that two documents or more hold (``shared``).

A key is a line's 128-bit hash, and its shard follows from it. Documents are added in
batches. A batch asks ``present`` which of its keys may be known; only for these the exact
tables are read, to leave out references that exist. Deleting documents takes their references back,
counts again what they held, and removes keys that nobody holds, or one only, from the
filters. So after any sequence of insertions and deletions the index is the one that the
remaining documents would have given at once.

Which lines go is asked of ``shared``: most lines aren't in it and stay without any join.
Only the others meet the exact counts. While the filters are smaller than ``FILTER_BYTES``
every task has them all; beyond that all lines meet the exact counts. Texts of documents that lose
nothing are never shuffled.

Defined results: null and empty texts are one empty line; keys of fewer than
``min_chars`` code points never go; rows with the same id are one document; null ids are one
document after all others. A line counts once for each document, however often it
stands there, and all its copies stay in the smallest document. An empty table gives
an empty result. Other columns have no influence. ``apply`` is meant for documents of the index; others lose the
lines that two or more documents of the index hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import bit_array, bit_is_set
from .common import BLANKS, LOWER, MARK_BITS, UPPER, _remove, ascii_lower, scratch_path, settle
from .cuckoo import CuckooFilter

MIN_CHARS, SHARDS = 10, 64
#: Filters of up to so many bytes are sent to every task.
FILTER_BYTES = 64 << 20
#: Stands for a null id.
LAST = (1 << 63) - 1
KEY = ["shard", "hi", "lo"]
FILTERS = "shard int, present binary, shared binary"
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: What PySpark's xxhash64 starts from.
SEED = 42


def _document(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST))


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n")


def line_keys(lines: Column, min_chars: int) -> Column:
    """The distinct keys of an array of lines."""
    keys = F.transform(lines, lambda x: ascii_lower(F.btrim(x, F.lit(BLANKS))))
    return F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_chars))


def _hashed(key: str, shards: int) -> list[Column]:
    hi = F.xxhash64(key)
    return [F.pmod(hi, F.lit(shards)).cast("int").alias("shard"), hi.alias("hi"), F.xxhash64(F.lit(1), F.col(key)).alias("lo")]


def _filters_of(key: tuple, table: pa.Table) -> pa.Table:
    """Both filters of a shard from its keys (``lo``) and counts (``n``)."""
    lo, n = np.asarray(table["lo"]), np.asarray(table["n"])
    made = [CuckooFilter.of(lo[n >= least]).to_bytes() for least in (1, 2)]
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "present": pa.array(made[:1], pa.binary()), "shared": pa.array(made[1:], pa.binary())})


def _changed_filters(key: tuple, filters: pa.Table, keys: pa.Table) -> pa.Table:
    """The filters of a shard after the counts of some of its keys went from ``was`` to ``n``; nulls where it must be built anew."""
    shard = pa.array([key[0].as_py()], pa.int32())
    if not filters.num_rows:
        return pa.table({"shard": shard, "present": pa.nulls(1, pa.binary()), "shared": pa.nulls(1, pa.binary())})
    lo, was, n = (np.asarray(keys[c]) for c in ("lo", "was", "n"))
    made: list[bytes | None] = []
    for least, name in ((1, "present"), (2, "shared")):
        f = CuckooFilter.from_bytes(filters[name][0].as_py())
        f.remove(lo[(was >= least) & (n < least)])
        new = lo[(was < least) & (n >= least)]
        made.append(f.to_bytes() if f.has_room(len(new)) and f.insert(new) else None)
    if None in made:
        made = [None, None]
    return pa.table({"shard": shard, "present": pa.array(made[:1], pa.binary()), "shared": pa.array(made[1:], pa.binary())})


def _maybe_known(key: tuple, filters: pa.Table, keys: pa.Table) -> pa.Table:
    lo = np.asarray(keys["lo"])
    known = CuckooFilter.from_bytes(filters["present"][0].as_py()).holds(lo) if filters.num_rows else np.zeros(len(lo), bool)
    return pa.table({"shard": keys["shard"].cast(pa.int32()), "hi": keys["hi"], "lo": keys["lo"], "known": pa.array(known)})


class _AllFilters:
    """The ``shared`` filters of all shards, asked at once."""

    def __init__(self, tables: dict[int, bytes], shards: int):
        self.filters = {s: CuckooFilter.from_bytes(b) for s, b in tables.items()}
        self.shards = shards

    def holds(self, shard: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lo), bool)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, f in self.filters.items():
            rows = order[edges[s] : edges[s + 1]]
            if len(rows):
                out[rows] = f.holds(lo[rows])
        return out


class LineIndex:
    """The lines of the documents that were inserted and not deleted since. Each change writes new tables beside the old ones and then names them in the manifest."""

    def __init__(self, spark: SparkSession, path: str, shards: int = SHARDS, min_chars: int = MIN_CHARS, version: int = 0, log: tuple[str, ...] = (), deleted: bool = False):
        self.spark, self.path, self.shards, self.min_chars = spark, path, shards, min_chars
        self.version, self.log, self.deleted = version, log, deleted

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineIndex:
        """The index that was last written at ``path``."""
        row = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
        return cls(spark, path, row["shards"], row["min_chars"], row["version"], tuple(row["log"]), row["deleted"])

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}-{self.version}")

    def refs(self) -> DataFrame:
        """``shard``, ``hi``, ``lo``, ``doc`` of all references that stand."""
        rows = self.spark.read.parquet(*[f"{self.path}/{x}" for x in self.log])
        if not self.deleted:
            return rows.drop("sign")
        return rows.groupBy(*KEY, "doc").agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign")

    def counts(self) -> DataFrame:
        """``shard``, ``hi``, ``lo``, ``n`` (documents), ``first`` (the smallest)."""
        return self._read("counts")

    def filters(self) -> DataFrame:
        return self._read("filters")

    def _keys(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return docs.select(_document(id_col).alias("doc"), F.explode(line_keys(_lines(text_col), self.min_chars)).alias("key")).select("doc", *_hashed("key", self.shards))

    def _commit(self, log: str, counts: DataFrame, changed: DataFrame | None, deleted: bool) -> None:
        """Write the next version. ``changed``: keys whose count went from ``was`` to ``n``; none for the first version."""
        old, version = self.version, self.version + 1
        counts.write.parquet(f"{self.path}/counts-{version}")
        counts = self.spark.read.parquet(f"{self.path}/counts-{version}")
        build = lambda rows: rows.select("shard", "lo", "n").groupBy("shard").applyInArrow(_filters_of, FILTERS)
        if changed is None:
            filters = build(counts)
        else:
            before, touched = self.filters(), changed.select("shard", "lo", "was", "n")
            after = settle(before.groupBy("shard").cogroup(touched.groupBy("shard")).applyInArrow(_changed_filters, FILTERS), "lines-filters")
            built = build(counts.join(after.where("present IS NULL").select("shard"), "shard", "left_semi"))
            filters = after.where("present IS NOT NULL").unionByName(built)
        filters.write.parquet(f"{self.path}/filters-{version}")
        self.version, self.log, self.deleted = version, (*self.log, log), self.deleted or deleted
        row = self.spark.createDataFrame([(version, self.shards, self.min_chars, list(self.log), self.deleted)], "version int, shards int, min_chars int, log array<string>, deleted boolean")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        if old:
            for name in ("counts", "filters"):
                _remove(self.spark, f"{self.path}/{name}-{old}")

    def _append(self, refs: DataFrame, sign: int) -> tuple[str, DataFrame]:
        name = f"refs-{uuid.uuid4().hex}"
        refs.select(*KEY, "doc", F.lit(sign).alias("sign")).write.parquet(f"{self.path}/{name}")
        return name, self.spark.read.parquet(f"{self.path}/{name}")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add the lines of documents; of a document that is there already, those that it lacks."""
        refs = self._keys(docs, id_col, text_col).dropDuplicates([*KEY, "doc"])
        counted = lambda rows: rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("doc").alias("first"))
        if not self.version:
            name, refs = self._append(refs, 1)
            self._commit(name, counted(refs), None, False)
            return
        refs = settle(refs, "lines-refs")
        keys = refs.groupBy(*KEY).count()
        asked = settle(self.filters().groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(_maybe_known, "shard int, hi long, lo long, known boolean"), "lines-asked").where("known")
        there = self.refs().join(asked, KEY, "left_semi")
        name, refs = self._append(refs.join(there, [*KEY, "doc"], "left_anti"), 1)
        new = counted(refs)
        old = self.counts()
        counts = old.unionByName(new).groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        was = old.join(asked, KEY, "left_semi").select(*KEY, F.col("n").alias("was"))
        changed = new.join(was, KEY, "left").select("shard", "lo", F.coalesce("was", F.lit(0).cast("long")).alias("was"), (F.col("n") + F.coalesce("was", F.lit(0))).alias("n"))
        self._commit(name, counts, changed, False)

    def delete(self, ids: DataFrame) -> None:
        """Take back documents; ``ids`` has one column of ids."""
        gone = ids.select(F.coalesce(F.col(f"`{ids.columns[0]}`").cast("long"), F.lit(LAST)).alias("doc")).distinct()
        name, out = self._append(self.refs().join(gone, "doc", "left_semi"), -1)
        touched = out.select(*KEY).distinct()
        left = self.refs().join(touched, KEY, "left_semi").join(out, [*KEY, "doc"], "left_anti")
        now = settle(left.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("doc").alias("first")), "lines-counts")
        old = self.counts()
        changed = old.join(touched, KEY, "left_semi").select(*KEY, F.col("n").alias("was")).join(now, KEY, "left").select("shard", "lo", "was", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
        self._commit(name, old.join(touched, KEY, "left_anti").unionByName(now), changed, True)

    def _to_drop(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``doc`` and ``gone``: the hashes (``hi``) of the keys that a document loses."""
        rows = self._keys(docs, id_col, text_col)
        size = self.filters().agg(F.sum(F.octet_length("shared"))).first()[0] or 0
        if size <= FILTER_BYTES:
            found = {r["shard"]: bytes(r["shared"]) for r in self.filters().select("shard", "shared").collect()}
            known = self.spark.sparkContext.broadcast(_AllFilters(found, self.shards))

            @F.pandas_udf("boolean")
            def may_be_shared(shard, lo):  # noqa: ANN001, ANN202
                import pandas as pd

                return pd.Series(known.value.holds(shard.to_numpy(), lo.to_numpy()))

            rows = rows.where(may_be_shared("shard", "lo"))
        shared = self.counts().where("n > 1").select(*KEY, "first")
        return rows.join(shared, KEY).where(F.col("doc") != F.col("first")).groupBy("doc").agg(F.collect_set("hi").alias("gone"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The id, ``n_lines`` (of the whole text), ``n_dropped`` and ``text`` (the lines that stay, joined by a line feed) of each row."""
        gone = settle(self._to_drop(docs, id_col, text_col), "lines-gone")
        spot = F.xxhash64("doc").bitwiseAND((1 << MARK_BITS) - 1)
        marks = bit_array(gone.select(spot.alias("p")), MARK_BITS).scalar()
        rows = docs.select(F.col(f"`{id_col}`").alias("id"), _document(id_col).alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
        rows = rows.withColumn("marked", bit_is_set(marks, spot))
        n_lines = F.size(F.split("text", "\n")).cast("long")
        whole = rows.where("not marked").select("id", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), "text")
        asked = rows.where("marked").join(gone, "doc", "left").select("id", "text", "gone")
        kept = asked.mapInArrow(_drop_lines, f"id {dict(rows.dtypes)['id']}, n_lines long, n_dropped long, text string")
        return whole.unionByName(kept).withColumnRenamed("id", id_col)


def _drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strip = BLANKS.encode()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            n_lines, n_dropped, texts = [], [], []
            for text, gone in zip(batch.column(1), batch.column(2), strict=True):
                lines = text.as_buffer().to_pybytes().split(b"\n")
                out = set(np.asarray(gone.values).tolist()) if gone.is_valid else ()
                # a hash of 64 bits is enough among the lines of one document
                keep = [x for x in lines if _hash(x.strip(strip).translate(_FOLD)) not in out] if out else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(keep))
                texts.append(b"\n".join(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines), pa.array(n_dropped), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_lines", "n_dropped", "text"])


def _hash(key: bytes) -> int:
    h = xxhash.xxh64_intdigest(key, SEED)
    return h - (1 << 64) if h >> 63 else h


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without the lines that smaller documents hold; see :meth:`LineIndex.apply`."""
    spark = docs.sparkSession
    index = LineIndex(spark, scratch_path(spark, "lines"), min_chars=min_chars)
    index.insert(docs, id_col, text_col)
    return index.apply(docs, id_col, text_col)
