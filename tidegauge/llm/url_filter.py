"""URL filters by Bloom filter cascades.

A cascade tells listed keys from all other keys of the corpus. Its first level is a
Bloom filter of the listed keys; the second encodes those keys of the corpus that pass
the first without being listed; the third the listed keys that pass the second; and so
on until no key passes wrongly. The first level that a key fails decides, so over the
listed keys and the complete key universe of the corpus membership is exact, though
each level is a small bit array and the query joins nothing.

A rule is a host and a path; its key is the two put together (``example.org/es/``). The
keys of a URL are the pairs of a suffix of its host, cut at dots, and a start of its
path, for the numbers of labels and the path lengths that occur among the rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import bit_array, bit_is_set
from .common import ascii_lower, settle

#: Bits for each key at least and positions set for each, up to one false positive in seven; the next levels mend them, so small levels cost least.
BITS_PER_KEY, HASHES = 4, 3
#: A bit array has at least 2^10 and at most 2^26 bits (8 MB), room for 16 million keys; a level of more keys has several, by a hash of the key.
LEAST_LOG2, MOST_LOG2 = 10, 26


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """Bit arrays of equal size; a hash of the key tells which is its own."""

    parts: list[DataFrame]
    log2_bits: int


def _positions(key: Column, level: int, log2_bits: int) -> Column:
    """An array of positions, all from one hash that is seeded by the level; levels are independent of each other."""
    low = (1 << 30) - 1
    h = F.xxhash64(F.lit(level), key)
    a, b = h.bitwiseAND(low), F.shiftrightunsigned(h, 32).bitwiseAND(low)
    return F.array(*[(a + b * i).bitwiseAND((1 << log2_bits) - 1) for i in range(HASHES)])


def _part(key: Column, number: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-number), key), F.lit(parts))


def _level(keys: DataFrame, n: int, number: int) -> Level:
    parts = max(1, math.ceil(n * BITS_PER_KEY / (1 << MOST_LOG2)))
    log2 = min(MOST_LOG2, max(LEAST_LOG2, math.ceil(math.log2(max(1, n * BITS_PER_KEY / parts)))))
    mine = [keys.where(_part(F.col("key"), number, parts) == k) if parts > 1 else keys for k in range(parts)]
    return Level([settle(bit_array(part.select(F.explode(_positions(F.col("key"), number, log2)).alias("p")), log2), "cascade-level") for part in mine], log2)


def _passes(key: Column, level: Level, number: int, words: list[Column]) -> Column:
    at = _positions(key, number, level.log2_bits)
    every = lambda w: F.forall(at, lambda p: bit_is_set(w, p))
    out = every(words[-1])
    for k in range(len(words) - 1):
        out = F.when(_part(key, number, len(words)) == k, every(words[k])).otherwise(out)
    return out


class Cascade:
    """Exact membership in ``listed`` for all keys of ``universe`` (both: one column ``key``)."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        self.levels: list[Level] = []
        inside = settle(listed.where("key is not null").distinct(), "cascade-keys")
        n = inside.count()
        if not n:
            return
        self.levels.append(_level(inside, n, 1))
        wrong = self._through(universe).distinct().join(inside, "key", "left_anti")
        wrong, other = settle(wrong, "cascade-keys"), inside
        while (n := wrong.count()) > 0:
            self.levels.append(_level(wrong, n, len(self.levels) + 1))
            wrong, other = settle(self._through(other), "cascade-keys"), wrong

    def _through(self, keys: DataFrame) -> DataFrame:
        """The keys that pass the last level."""
        level = self.levels[-1]
        names = [f"_words{k}" for k in range(len(level.parts))]
        with_words = keys.withColumns({name: part.scalar() for name, part in zip(names, level.parts, strict=True)})
        return with_words.where(_passes(F.col("key"), level, len(self.levels), [F.col(c) for c in names])).select("key")

    def beside(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the levels' bit arrays as columns, for :meth:`member`."""
        return rows.withColumns({f"{name}_{i}_{k}": part.scalar() for i, level in enumerate(self.levels, 1) for k, part in enumerate(level.parts)})

    def member(self, key: Column, name: str) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            level = self.levels[i - 1]
            words = [F.col(f"{name}_{i}_{k}") for k in range(len(level.parts))]
            out = F.when(_passes(key, level, i, words), out).otherwise(F.lit(i % 2 == 0))
        return F.when(key.isNull(), F.lit(False)).otherwise(out)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column, labels: int) -> list[Column]:
    return [F.substring_index(host, ".", -k) for k in range(1, labels + 1)]


def _rule_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> list[Column]:
    return [F.when(F.length(path) >= n, F.concat(s, F.substring(path, 1, n))) for s in _suffixes(host, labels) for n in lengths]


def _keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")


def _hosts(spark: SparkSession, hosts: list[str] | DataFrame) -> DataFrame:
    return hosts.select(F.col(f"`{hosts.columns[0]}`").cast("string").alias("key")).where("key is not null") if isinstance(hosts, DataFrame) else _keys(spark, hosts)


def host_cascade(pages: DataFrame, blocked_hosts: list[str] | DataFrame, url_col: str = "url") -> tuple[Cascade, int]:
    """The cascade of listed hosts over all host suffixes of ``pages``, and the most labels that a listed host has."""
    listed = _hosts(pages.sparkSession, blocked_hosts)
    labels = listed.agg(F.max(F.length("key") - F.length(F.replace(F.col("key"), F.lit(".")))).alias("n")).first()[0] or 0
    suffixes = _suffixes(url_host(F.col(f"`{url_col}`")), labels + 1)
    return Cascade(listed, pages.select(F.explode(F.array(*suffixes)).alias("key"))), labels + 1


def judge_urls(pages: DataFrame, rules: list[Rule], blocked_hosts: list[str] | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, ``host``, ``path``, ``rule`` and ``verdict`` of each row.

    The longest rule that fits decides; without one, hosts that are listed in
    ``blocked_hosts`` (of any number as the first column of a DataFrame), or lie below one, are blocked and all others allowed. Null URLs
    and URLs without ``://`` have an empty host and path, fit no rule and are allowed.
    """
    spark = pages.sparkSession
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias(id_col), url_host(url).alias("host"), url_path(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    labels = max([r.host.count(".") + 1 for r in rules] or [1])
    lengths = sorted({len(r.path) for r in rules})
    keys = _rule_keys(host, path, labels, lengths)
    bad_host, most = host_cascade(pages, blocked_hosts, url_col)
    suffixes = _suffixes(host, most)
    texts = lambda cols: F.array_compact(F.array(*cols or [F.lit(None).cast("string")]))
    universe = lambda cols: rows.select(F.explode(texts(cols)).alias("key"))
    listed = _keys(spark, [r.key for r in rules])
    by_rule = Cascade(listed, universe(keys))
    blocks = Cascade(_keys(spark, [r.key for r in rules if r.verdict == "block"]), listed)
    wide = bad_host.beside(blocks.beside(by_rule.beside(rows, "_rule"), "_blocks"), "_bad")
    fits = F.filter(texts(keys), lambda k: by_rule.member(k, "_rule"))
    judged = wide.withColumn("rule", F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"])
    blocked = F.when(F.col("rule").isNotNull(), blocks.member(F.col("rule"), "_blocks")).otherwise(F.exists(texts(suffixes), lambda k: bad_host.member(k, "_bad")))
    return judged.select(id_col, "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"))
