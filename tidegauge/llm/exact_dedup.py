"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical without blanks. A first scan groups all rows
by length; a second takes the prefix hash of rows whose length occurs again; a third
takes the SHA-256 of the whole text of rows whose length and prefix hash occur again.
Which lengths and prefixes occur again is kept in two bit arrays of fixed size
(:mod:`.bits`), so no text is shuffled to find candidates. Slots of these arrays are
shared by several keys: a text hashed in vain costs time and changes no result.

Defined results: null texts equal empty ones; repeated rows are copies of each other;
a null id loses to any other; of rows equal in all these respects, one stays. An
empty table gives an empty result. Other columns have no influence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import may_repeat, repeats
from .common import settle, without_blanks

#: log2 of the bits that tell lengths and prefixes which occur again: 128 KB and 1 MB.
LENGTH_BITS, PREFIX_BITS = 20, 23
PREFIX_CHARS = 256


def _refined(docs: DataFrame, text_col: str, prefix_chars: int) -> tuple[Column, Column, Column]:
    """(length, prefix hash, may have a copy) of a row of ``docs``, without blanks."""
    text = without_blanks(F.col(f"`{text_col}`"))
    size = F.length(text)
    by_length, by_prefix = F.xxhash64(size), F.xxhash64(size, F.substring(text, 1, prefix_chars))
    lengths = repeats(docs.select(by_length.alias("h")), LENGTH_BITS).scalar()
    same_length = may_repeat(lengths, by_length, LENGTH_BITS)
    prefixes = repeats(docs.where(same_length).select(by_prefix.alias("h")), PREFIX_BITS).scalar()
    return size, by_prefix, same_length & may_repeat(prefixes, by_prefix, PREFIX_BITS)


def _preference(chars: Column, key: Column) -> list[Column]:
    """The largest stays: most code points in the original, then the smallest id (null last)."""
    return [chars, F.bitwise_not(key)]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept`` and the columns of ``carry``."""
    carry = carry or {}
    size, prefix, candidate = _refined(docs, text_col, prefix_chars)
    text = F.col(f"`{text_col}`")
    rows = settle(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), size.alias("size"), prefix.alias("prefix"),
            F.length(F.coalesce(text, F.lit(""))).alias("chars"), F.when(candidate, F.sha2(without_blanks(text), 256)).alias("full"),
            F.struct(*[c.alias(n) for n, c in carry.items()] or [F.lit(0).alias("none")]).alias("carried"),
        ),
        "exact-dedup",
    )
    key = ["size", "prefix", "full"]
    groups = (
        rows.where(F.col("full").isNotNull())
        .groupBy(*key)
        .agg(F.count("*").alias("n"), F.max_by(F.struct("id", "row"), F.struct(*_preference(F.col("chars"), F.col("id")), F.bitwise_not("row"))).alias("best"))
        .where("n > 1")
    )
    out = [F.col("carried")[n].alias(n) for n in carry]
    alone = rows.where(F.col("full").isNull()).select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *out)
    grouped = rows.where(F.col("full").isNotNull()).join(groups, key, "left")
    found = F.col("n").isNotNull()
    return alone.unionByName(
        grouped.select(
            F.col("id").alias(id_col), F.when(found, F.col("best.id")).otherwise(F.col("id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (~found | (F.col("best.row") == F.col("row"))).alias("kept"), *out,
        )
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows without a candidate copy leave the scan as they are. Only the others are
    grouped; each task first keeps one row of each group that it has seen.
    """
    size, prefix, candidate = _refined(docs, text_col, prefix_chars)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("id"), size.alias("size"), prefix.alias("prefix"), F.length(F.coalesce(text, F.lit(""))).alias("chars"), without_blanks(text).alias("plain"), candidate.alias("candidate"))
    kept = rows.where("candidate").groupBy("size", "prefix", F.sha2("plain", 256).alias("full")).agg(F.max_by("doc", F.struct(*_preference(F.col("chars"), F.col("id")))).alias("doc"))
    return rows.where("not candidate").select("doc.*").unionByName(kept.select("doc.*"))
