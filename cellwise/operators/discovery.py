"""Recovering weighted cells (x0.., cnt) from a sketch: by enumerating a grid, by heavy hitters, or by random points.

Cells are whole-number coordinates ``g0, g1, ..`` at a precision; their text keys are rendered only to be hashed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions import vectors as V
from cellwise.operators import count_min as C
from cellwise.operators import grid as G
from cellwise.session import broadcast_if_small

#: A normalizer: (value, precision) to the whole-number coordinate of its cell.
Normalizer = Callable[[Column, int], Column]
#: A discovery strategy: (sketch, observed cells, precision, sizing) to weighted cells (g.., cnt).
DiscoveryStrategy = Callable[[DataFrame, DataFrame, int, C.Sizing], DataFrame]


def coordinates(n: int) -> list[str]:
    return [f"g{i}" for i in range(n)]


def to_cells(df: DataFrame, columns: Sequence[Column], precision: int, normalizer: Normalizer = G.grid_index) -> DataFrame:
    """Whole-number coordinates of every row without nulls."""
    names = coordinates(len(columns))
    rows = df.select(*[normalizer(c, precision).alias(n) for c, n in zip(columns, names, strict=True)])
    return rows.where(" AND ".join(f"{n} IS NOT NULL" for n in names))


def cell_key(names: Sequence[str], precision: int) -> Column:
    return V.key(F.array(*[F.col(n) / F.lit(float(10**precision)) for n in names]))


def cell_counts(cells: DataFrame) -> DataFrame:
    """Exact (g.., cnt)."""
    return cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("cnt"))


def sketch_cells(cells: DataFrame, precision: int, sizing: C.Sizing) -> DataFrame:
    """Sketch of the cells: added up by whole numbers first, rendered and hashed once a distinct cell."""
    counts = cell_counts(cells).select(cell_key(cells.columns, precision).alias("key"), "cnt")
    return C.from_counts(counts, sizing)


def estimate_cells(sketch: DataFrame, cells: DataFrame, precision: int, sizing: C.Sizing, min_count: int = 0) -> DataFrame:
    """``cells`` (distinct g..) with their estimates as ``cnt``; those below ``min_count`` are left out (0 keeps empty cells).

    A cell whose first counter is empty is 0 without further lookups.
    """
    names = [c for c in cells.columns if c.startswith("g")]
    keyed = cells.withColumn("key", cell_key(names, precision))
    out = C.lookup(sketch, keyed, sizing, "key", out="cnt").drop("key").select(*names, "cnt")
    return out.where(F.col("cnt") >= min_count) if min_count else out


def by_enumeration(sketch: DataFrame, cells: DataFrame, precision: int, sizing: C.Sizing, min_count: int = 0, max_cells: int = G.MAX_CELLS) -> DataFrame:
    """Estimates of all cells of the box that ``cells`` span."""
    return estimate_cells(sketch, G.enumerate_observed(cells, cells.columns, max_cells), precision, sizing, min_count)


def by_heavy_hitters(sketch: DataFrame, cells: DataFrame, precision: int, sizing: C.Sizing, k: int) -> DataFrame:
    """The k observed cells with the largest estimates (ties to the smaller key), with ``rank`` and ``key``."""
    from pyspark.sql import Window

    est = estimate_cells(sketch, cells.distinct(), precision, sizing).withColumn("key", cell_key(cells.columns, precision))
    best = est.orderBy(F.col("cnt").desc(), "key").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("cnt").desc(), "key")))  # k rows


def random_cells(spark: SparkSession, dims: int, n: int, precision: int, seed: int) -> DataFrame:
    """``n`` cells of [-1, 1]^dims, drawn with repeats: coordinate d of draw i is the upper half of a 31-bit product of two whole numbers made of i, d and the seed."""
    side, m = 10**precision, 2**31 - 1
    drawn = spark.range(n)
    columns = []
    for d in range(dims):
        a = F.pmod((F.col("id") + 1) * F.lit(48271 + 2 * d) + F.lit(seed * 69621 + d), F.lit(m))
        b = F.pmod(a * F.lit(16807), F.lit(m))
        columns.append((F.floor(F.pmod(b * F.lit(39373), F.lit(m)) * F.lit(2 * side + 1) / F.lit(m)) - side).cast("bigint").alias(f"g{d}"))
    return drawn.select(*columns)


def by_random_points(spark: SparkSession, sketch: DataFrame, dims: int, n: int, precision: int, sizing: C.Sizing, seed: int) -> DataFrame:
    """Estimates of ``n`` random cells of [-1, 1]^dims; a cell that is drawn twice comes twice."""
    drawn = random_cells(spark, dims, n, precision, seed)
    times = drawn.groupBy(*drawn.columns).agg(F.count(F.lit(1)).alias("times"))
    keyed = times.withColumn("key", cell_key(drawn.columns, precision))
    found = C.lookup(sketch, keyed, sizing, "key", out="cnt")
    return found.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*drawn.columns, "cnt")


def full_range(spark: SparkSession, bits: int = 20) -> DataFrame:
    """All whole numbers -2^bits .. 2^bits - 1 as ``g0``."""
    return spark.range(-(2**bits), 2**bits).select(F.col("id").alias("g0"))


def heavy_hitter_grid(enumerated: DataFrame, hitters: DataFrame) -> DataFrame:
    """Enumerated cells with the estimate, the count in the heavy hitters, and the estimate only where the cell is a heavy hitter (0 elsewhere)."""
    names = [c for c in enumerated.columns if c.startswith("g")]
    hh = hitters.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("cnt").alias("_cnt"))
    same = F.lit(True)
    for n in names:
        same = same & (F.col(n) == F.col(f"_{n}"))
    joined = enumerated.join(broadcast_if_small(hh), same, "left")
    return joined.select(*names, "cnt", F.coalesce("_cnt", F.lit(0)).alias("hh_cnt"), F.when(F.col("_cnt").isNotNull(), F.col("cnt")).otherwise(F.lit(0)).alias("hh_estimate"))


def grid_matrix(cells: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """One row a y (to be ordered descending): the values by ascending x as an array. A line of the grid is one row, as in a matrix file."""
    return cells.groupBy(y).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(value).alias("v")))), lambda e: e["v"]).alias("line"))
