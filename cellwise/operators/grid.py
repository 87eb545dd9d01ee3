"""Regular grids: rounding vectors to cells, and enumerating cells.

A coordinate at precision p is the whole number g = floor(x*10^p + 1/2) (half up); the cell value is g/10^p. Whole numbers make keys, joins and sums
exact and let axes include both ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most cells that may be enumerated unless a caller says otherwise.
MAX_CELLS = 100_000_000


def grid_index(x: Column, precision: int) -> Column:
    return F.floor(x.cast("double") * F.lit(float(10**precision)) + F.lit(0.5))


def round_half_up(x: Column, precision: int) -> Column:
    return grid_index(x, precision) / F.lit(float(10**precision))


def round_vector(v: Column, precision: int) -> Column:
    return F.transform(v, lambda x: round_half_up(x, precision))


def step(precision: int) -> float:
    return 10.0**-precision


def step_vector(precision: int, n: int) -> list[float]:
    return [step(precision)] * n


def grid_total(precision: int) -> int:
    """Cells of the axis [-1, 1]."""
    return 2 * 10**precision


def random_cell(precision: int, seed: int) -> Column:
    """A random cell value of [-1, 1]."""
    return round_half_up(F.rand(seed) * 2 - 1, precision)


def to_binary(x: Column, bits: int) -> Column:
    """Truncation to whole multiples of 2^-bits, as whole numbers; beyond the int range the range's end."""
    y = x.cast("double") * F.lit(float(2**bits))
    return F.greatest(F.least(y, F.lit(2147483647.0)), F.lit(-2147483648.0)).cast("int")


def from_binary(g: Column, bits: int) -> Column:
    return g.cast("double") / F.lit(float(2**bits))


def enumerate_box(spark: SparkSession, low: Sequence[int], high: Sequence[int], names: Sequence[str], max_cells: int = MAX_CELLS) -> DataFrame:
    """All cells of a box of whole-number coordinates, both ends included. The first axis is spread over tasks, the others are generated row by row."""
    total = 1
    for a, b in zip(low, high, strict=True):
        total *= max(0, b - a + 1)
    if total > max_cells:
        raise ValueError(f"{total} cells, more than {max_cells}")
    out = spark.range(low[0], high[0] + 1).select(F.col("id").alias(names[0]))
    for a, b, name in zip(low[1:], high[1:], names[1:], strict=True):
        axis = F.sequence(F.lit(a).cast("bigint"), F.lit(b).cast("bigint")) if b >= a else F.array().cast("array<bigint>")
        out = out.withColumn(name, F.explode(axis))
    return out


def observed_box(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: lowest and highest of every column (``c_min``, ``c_max``); null for an empty table."""
    return df.agg(*[F.min(c).alias(f"{c}_min") for c in columns], *[F.max(c).alias(f"{c}_max") for c in columns])


def enumerate_observed(df: DataFrame, columns: Sequence[str], max_cells: int = MAX_CELLS) -> DataFrame:
    """All cells of the box that the whole-number columns span. The box is one row, its axes are exploded. An empty table gives no cells."""
    span = F.lit(1).cast("decimal(38,0)")
    for c in columns:
        span = span * (F.col(f"{c}_max") - F.col(f"{c}_min") + 1)
    box = observed_box(df, columns).where(" AND ".join(f"{c}_min IS NOT NULL" for c in columns))
    out = box.where(F.when(span > max_cells, F.raise_error(F.lit(f"more than {max_cells} cells")).cast("boolean")).otherwise(F.lit(True)))
    for i, c in enumerate(columns):
        out = out.withColumn(c, F.explode(F.sequence(f"{c}_min", f"{c}_max")))
        if i == 0:
            out = out.repartition(c)
    return out.select(*columns)
