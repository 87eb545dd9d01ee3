"""k-means on rows or on weighted cells, in any number of dimensions.

The centers are literals of the plan (k of them, k is a parameter), so assigning is a narrow expression: no join. An iteration is one aggregate with k rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Centers = dict[int, list[float]]


def nearest(xs: Sequence[Column], centers: Centers) -> Column:
    """Id of the nearest center; ties to the smallest id. NaN centers are never nearest."""
    sane = {i: c for i, c in centers.items() if not any(math.isnan(v) for v in c)}
    options = []
    for i, c in sorted(sane.items()):
        d = F.lit(0.0)
        for x, v in zip(xs, c, strict=True):
            d = d + (x - F.lit(v)) * (x - F.lit(v))
        options.append(F.struct(d.alias("d"), F.lit(i).alias("id")))
    return F.array_min(F.array(*options))["id"] if options else F.lit(None).cast("int")


def assign(points: DataFrame, xs: Sequence[Column], centers: Centers, out: str = "center") -> DataFrame:
    return points.withColumn(out, nearest(xs, centers))


def step(points: DataFrame, xs: Sequence[Column], weight: Column, centers: Centers, keep_empty: bool) -> Centers:
    """Weighted means of the assigned points. An empty center disappears, or with ``keep_empty`` stays as NaN."""
    rows = points.select(nearest(xs, centers).alias("c"), *[(x * weight).alias(f"s{d}") for d, x in enumerate(xs)], weight.alias("w")).where("w > 0")
    sums = rows.groupBy("c").agg(F.sum("w").alias("w"), *[F.sum(f"s{d}").alias(f"s{d}") for d in range(len(xs))])
    found = {r["c"]: [r[f"s{d}"] / r["w"] for d in range(len(xs))] for r in sums.collect()}  # at most k rows
    if keep_empty:
        return {i: found.get(i, [math.nan] * len(xs)) for i in centers}
    return found


def run(points: DataFrame, xs: Sequence[Column], weight: Column, centers: Centers, iterations: int, keep_empty: bool = False) -> Centers:
    """``points`` are read once an iteration: cache them if they are costly to make."""
    for _ in range(iterations):
        if not centers:
            break
        centers = step(points, xs, weight, centers, keep_empty)
    return centers


def frame(spark, centers: Centers) -> DataFrame:
    n = len(next(iter(centers.values()))) if centers else 0
    return spark.createDataFrame([(i, *c) for i, c in sorted(centers.items())], "id int, " + ", ".join(f"x{d} double" for d in range(n)))


def cost(points: DataFrame, xs: Sequence[Column], weight: Column, centers: Centers) -> DataFrame:
    """One row: the weighted sum of squared distances to the nearest center."""
    options = []
    for c in centers.values():
        d = F.lit(0.0)
        for x, v in zip(xs, c, strict=True):
            d = d + (x - F.lit(v)) * (x - F.lit(v))
        options.append(d)
    return points.agg(F.sum(F.least(*options) * weight if len(options) > 1 else options[0] * weight).alias("cost"))


def init_random(k: int, dims: int, seed: int) -> Centers:
    import random

    rng = random.Random(seed)
    return {i: [rng.uniform(-1, 1) for _ in range(dims)] for i in range(1, k + 1)}


def init_heaviest(cells: DataFrame, xs: Sequence[str], weight: str, k: int) -> Centers:
    """The k heaviest cells, ties to the smaller coordinates; an error if there are fewer."""
    rows = cells.orderBy(F.col(weight).desc(), *xs).limit(k).select(*xs).collect()
    if len(rows) < k:
        raise ValueError(f"{len(rows)} cells for {k} centers")
    return {i: [float(v) for v in r] for i, r in enumerate(rows, 1)}


def init_frame(df: DataFrame, id_: str, xs: Sequence[str], most: int = 10_000) -> Centers:
    """Centers from a table with one row a center; more than ``most`` rows are an error, as centers become literals of the plan."""
    rows = df.select(id_, *xs).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} centers")
    return {r[id_]: [float(r[x]) for x in xs] for r in rows}
