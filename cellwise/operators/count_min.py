"""Count-Min sketches as tables of counters (row, col, cnt).

A sketch is linear, so keys are added up before they are hashed, and sketches of parts are merged by adding counters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions.hashing import HashFunction, bucket, folded, spread

#: Counter tables up to this number of cells (16 bytes each) are broadcast to lookups.
BROADCAST_CELLS = 500_000


@dataclass(frozen=True)
class Sizing:
    """``depth`` = ceil(ln 1/delta) rows of ``width`` = ceil(factor/epsilon) counters; factor 2 for counts, e for weights. A ``hash_function`` replaces the default one."""

    depth: int
    width: int
    hash_function: HashFunction | None = None

    @staticmethod
    def of(delta: float, epsilon: float, weighted: bool = False) -> Sizing:
        return Sizing(math.ceil(math.log(1 / delta)), math.ceil((math.e if weighted else 2.0) / epsilon))

    @property
    def megabytes(self) -> float:
        return self.depth * self.width * 8 / 1024 / 1024

    def error_bound(self, total: int) -> float:
        """With probability 1-delta an estimate exceeds the truth by at most this."""
        return 2.0 * total / self.width


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "row int, col bigint, cnt bigint")


def key_counts(df: DataFrame, key: Column, increment: Column | None = None) -> DataFrame:
    """(key, cnt). Null keys are no keys; a null increment adds nothing."""
    n = F.lit(1) if increment is None else F.coalesce(increment, F.lit(0))
    return df.select(key.alias("key"), n.cast("bigint").alias("n")).where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("cnt"))


def build(df: DataFrame, key: Column, sizing: Sizing, increment: Column | None = None) -> DataFrame:
    """Non-zero counters (row, col, cnt) of the stream."""
    return from_counts(key_counts(df, key, increment), sizing)


def from_counts(counts: DataFrame, sizing: Sizing) -> DataFrame:
    return spread(counts, "key", sizing.depth, sizing.width, hash_function=sizing.hash_function).groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))


def build_weighted(df: DataFrame, key: Column, weight: Column, sizing: Sizing) -> DataFrame:
    """Weighted sketch (row, col, val) with double counters."""
    sums = df.select(key.alias("key"), weight.cast("double").alias("w")).where("key IS NOT NULL").groupBy("key").agg(F.sum("w").alias("val"))
    return spread(sums, "key", sizing.depth, sizing.width, hash_function=sizing.hash_function).groupBy("row", "col").agg(F.sum("val").alias("val"))


def merge(*sketches: DataFrame) -> DataFrame:
    """Cell-wise sum of sketches of one sizing: the sketch of the joined streams."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    value = "val" if "val" in out.columns else "cnt"
    return out.groupBy("row", "col").agg(F.sum(value).alias(value))


def lookup(sketch: DataFrame, keys: DataFrame, sizing: Sizing, key: str = "key", value: str = "cnt", out: str = "estimate") -> DataFrame:
    """``keys`` (distinct) with the estimate of each: the least of its counters, 0 where a counter is missing."""
    cells = sketch.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(value).alias("_val"))
    if sizing.depth * sizing.width <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    placed = spread(keys, key, sizing.depth, sizing.width, "_r", "_c", sizing.hash_function)
    joined = placed.join(cells, (F.col("_r") == F.col("_row")) & (F.col("_c") == F.col("_col")), "left")
    others = [c for c in keys.columns if c != key]
    zero = F.lit(0).cast(dict(sketch.dtypes)[value])
    return joined.groupBy(key, *others).agg(F.min(F.coalesce("_val", zero)).alias(out))


def row_sum(sketch: DataFrame, row: int = 0) -> DataFrame:
    return sketch.where(F.col("row") == row).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))


def dump(sketch: DataFrame, sizing: Sizing, pad: int = 4) -> DataFrame:
    """One text line a row: all counters, left-padded. For sketches that a line can hold."""
    cols = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(sizing.width - 1).cast("bigint"))).alias("col")
    every = sketch.select("row").distinct().select("row", cols, F.lit(0).cast("bigint").alias("cnt"))
    filled = every.unionByName(sketch.select("row", "col", "cnt")).groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))
    cells = F.transform(F.sort_array(F.collect_list(F.struct("col", "cnt"))), lambda e: F.lpad(e["cnt"].cast("string"), pad, " "))
    return filled.groupBy("row").agg(F.array_join(cells, " ").alias("line"))


def estimates_by_sizing(counts: DataFrame, sizings: list[Sizing]) -> DataFrame:
    """(sizing, key, cnt, estimate): every key of ``counts`` (key, cnt) by a sketch of each size (its number in the list), of one hash a key and row for all sizes.

    Sizes differ in depth and width only: a shallower sketch is the first rows of a deeper one.
    """
    hashed = folded(counts.select("key", "cnt"), "key", max(s.depth for s in sizings))
    options = [F.struct(F.lit(i).alias("sizing"), bucket(F.col("_fold"), s.width).alias("col"), (F.col("row") < s.depth).alias("kept")) for i, s in enumerate(sizings)]
    placed = hashed.select("key", "cnt", "row", F.explode(F.array(*options)).alias("o")).where("o.kept").select("key", "cnt", "row", "o.sizing", "o.col")
    cells = placed.groupBy("sizing", "row", "col").agg(F.sum("cnt").alias("_val"))
    return placed.join(cells, ["sizing", "row", "col"]).groupBy("sizing", "key").agg(F.first("cnt").alias("cnt"), F.min("_val").alias("estimate"))


def error_profile(exact: DataFrame, estimated: DataFrame, bound: float) -> DataFrame:
    """One row comparing (key, cnt) with (key, estimate): totals, over- and under-estimates, and estimates beyond the bound."""
    return exact.join(estimated, "key").agg(*profile_columns(F.lit(bound)))


def profile_columns(bound: Column) -> list[Column]:
    """The aggregates of an error profile over rows with cnt and estimate."""
    off = F.col("estimate") - F.col("cnt")
    count = lambda c: F.sum(c.cast("bigint"))
    return [
        F.count(F.lit(1)).alias("n_keys"), F.sum("cnt").alias("total"), F.sum("estimate").alias("estimated_total"), F.max(off).alias("max_error"),
        count(off > 0).alias("n_over"), count(off < 0).alias("n_under"), count(off > bound).alias("n_beyond_bound"),
    ]
