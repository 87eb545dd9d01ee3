"""Bloom filters as tables of set bits (bit)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.functions.hashing import HashFunction, spread

#: Filters up to this number of bits are broadcast to membership tests (8 bytes a set bit).
BROADCAST_BITS = 1_000_000


@dataclass(frozen=True)
class BloomSizing:
    bits: int
    hashes: int
    expected: int
    hash_function: HashFunction | None = None

    @staticmethod
    def of_bits_per_element(per_element: float, expected: int, hashes: int) -> BloomSizing:
        return BloomSizing(math.ceil(per_element * expected), hashes, expected)

    @staticmethod
    def of_bits(bits: int, expected: int) -> BloomSizing:
        return BloomSizing(bits, round(bits / expected * math.log(2)), expected)

    @staticmethod
    def of_rate(rate: float, expected: int) -> BloomSizing:
        hashes = math.ceil(-math.log2(rate))
        return BloomSizing(math.ceil(hashes / math.log(2) * expected), hashes, expected)

    def false_positive_rate(self, elements: int | None = None) -> float:
        n = self.expected if elements is None else elements
        return (1 - math.exp(-self.hashes * n / self.bits)) ** self.hashes

    def bits_per_element(self, elements: int | None = None) -> float:
        n = self.expected if elements is None else elements
        return self.bits / n if n else math.inf


def _bits(keys: DataFrame, key: str, sizing: BloomSizing) -> DataFrame:
    placed = spread(keys, key, sizing.hashes, sizing.bits, "_row", "_col", sizing.hash_function)
    return placed.withColumn("bit", F.abs(F.col("_col") % sizing.bits)).drop("_row", "_col")


def build(df: DataFrame, key: Column, sizing: BloomSizing) -> DataFrame:
    """Set bits of the distinct non-null keys."""
    return _bits(df.select(key.alias("key")).where("key IS NOT NULL").distinct(), "key", sizing).select("bit").distinct()


def to_words(filter_: DataFrame) -> DataFrame:
    """(word, bits): the filter as 64-bit words; words without a set bit are left out."""
    bit = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    return filter_.groupBy((F.col("bit") / 64).cast("bigint").alias("word")).agg(F.bit_or(bit).alias("bits"))


def from_words(words: DataFrame) -> DataFrame:
    """A filter (bit) from its 64-bit words (word, bits), as ``to_words`` writes them."""
    places = words.select("word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("place")).where("(shiftrightunsigned(bits, place) & 1L) = 1")
    return places.select((F.col("word") * 64 + F.col("place")).alias("bit")).distinct()


def merge(*filters: DataFrame) -> DataFrame:
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.distinct()


def contains(filter_: DataFrame, keys: DataFrame, sizing: BloomSizing, key: str = "key", out: str = "maybe") -> DataFrame:
    """``keys`` (distinct) with ``out``: whether all bits of the key are set. Members always are."""
    bits = filter_.select(F.col("bit").alias("_bit"))
    if sizing.bits <= BROADCAST_BITS:
        bits = F.broadcast(bits)
    asked = _bits(keys, key, sizing)
    joined = asked.join(bits, F.col("bit") == F.col("_bit"), "left")
    others = [c for c in keys.columns if c != key]
    return joined.groupBy(key, *others).agg(F.bool_and(F.col("_bit").isNotNull()).alias(out))


def contains_all(filter_: DataFrame, keys: DataFrame, sizing: BloomSizing, key: str = "key") -> DataFrame:
    """One row: whether the filter may hold all keys (true for none)."""
    return contains(filter_, keys, sizing, key).agg(F.coalesce(F.bool_and("maybe"), F.lit(True)).alias("all_maybe"))


def set_bits(filter_: DataFrame) -> DataFrame:
    return filter_.agg(F.count(F.lit(1)).alias("n_bits"))


def same(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two filters have the same bits."""
    left = a.select("bit", F.lit(1).alias("w")).unionByName(b.select("bit", F.lit(-1).alias("w")))
    return left.groupBy("bit").agg(F.sum("w").alias("w")).agg((F.coalesce(F.max(F.abs("w")), F.lit(0)) == 0).alias("same"))
