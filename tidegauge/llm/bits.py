"""Bit arrays of fixed size, built by aggregation and read by plain expressions.

An array is one row with one ``array<bigint>``. A query reads it as a scalar
subquery, so testing a bit needs neither a join nor a Python function, and its size
doesn't depend on the rows that set its bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit_array(positions: DataFrame, log2_bits: int) -> DataFrame:
    """One row ``words``: bit p is set for each value p of the only column of ``positions``."""
    spark, p = positions.sparkSession, F.col(positions.columns[0])
    found = positions.groupBy(F.shiftright(p, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{positions.columns[0]}` & 63 as int))")).alias("bits"))
    every = spark.range(0, 1 << (log2_bits - 6), 1, 1).withColumnRenamed("id", "word")
    full = every.join(found, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def bit_is_set(words: Column, position: Column) -> Column:
    return F.getbit(F.element_at(words, (F.shiftright(position, 6) + 1).cast("int")), position.bitwiseAND(63).cast("int")) == 1


def repeats(hashes: DataFrame, log2_bits: int) -> DataFrame:
    """A bit array that has the slot of every hash that occurs at least twice.

    Slots are shared, so a hash that occurs once may be found too, never the reverse.
    """
    h = hashes.columns[0]
    slots = hashes.select(F.col(h).bitwiseAND((1 << log2_bits) - 1).alias("slot"))
    return bit_array(slots.groupBy("slot").count().where("count > 1").select("slot"), log2_bits)


def may_repeat(words: Column, hashed: Column, log2_bits: int) -> Column:
    return bit_is_set(words, hashed.bitwiseAND((1 << log2_bits) - 1))
