"""Seeded generators of test data."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def polynomial(spark: SparkSession, n: int, coefficients: Sequence[float], exponents: Sequence[float], sigma: float, low: float = -1.0, high: float = 1.0, seed: int = 1, uniform_noise: bool = False) -> DataFrame:
    """(index, y, x): y = sum a x^e plus normal noise, or uniform noise of [-1, 1] times sigma."""
    x = F.rand(seed) * (high - low) + low
    rows = spark.range(n).select(F.col("id").alias("index"), x.alias("x"), (F.rand(seed + 1) * 2 - 1 if uniform_noise else F.randn(seed + 1)).alias("e"))
    y = F.lit(0.0)
    for a, e in zip(coefficients, exponents, strict=True):
        y = y + F.lit(float(a)) * F.pow("x", F.lit(float(e)))
    return rows.select("index", (y + F.col("e") * sigma).alias("y"), "x")


def logistic(spark: SparkSession, n: int, coefficients: Sequence[float], exponents: Sequence[float], sigma: float, seed: int = 123) -> DataFrame:
    """(index, y in {0, 1}, x): a noisy polynomial, rounded and cut to 0 and 1."""
    p = polynomial(spark, n, coefficients, exponents, sigma, seed=seed)
    return p.select("index", F.greatest(F.least(F.floor(F.col("y") + 0.5), F.lit(1)), F.lit(0)).cast("int").alias("y"), "x")


def clusters(spark: SparkSession, n: int, k: int, stddev: float | Sequence[float], span: float = 2.0, dims: int = 2, seed: int = 1) -> tuple[DataFrame, list[list[float]]]:
    """(id, center, x0..) of n points around k uniform centers in +-span/2, dealt out in turn; ``stddev`` is one number or one a cluster."""
    rng = random.Random(seed)
    centers = [[rng.uniform(-span / 2, span / 2) for _ in range(dims)] for _ in range(k)]
    spread = [float(stddev)] * k if isinstance(stddev, (int, float)) else [float(s) for s in stddev]
    c = (F.col("id") % k).cast("int")
    rows = spark.range(n).select("id", (c + 1).alias("center"), *[
        (F.get(F.array(*[F.lit(m[d]) for m in centers]), c) + F.randn(seed + d) * F.get(F.array(*[F.lit(s) for s in spread]), c)).alias(f"x{d}") for d in range(dims)
    ])
    return rows, centers


def perturb(centers: DataFrame, columns: Sequence[str], distance: float, seed: int = 1) -> DataFrame:
    """Centers moved by plus or minus ``distance`` on every axis."""
    return centers.withColumns({c: F.col(c) + F.when(F.rand(seed + i) < 0.5, -distance).otherwise(distance) for i, c in enumerate(columns)})


def random_places(spark: SparkSession, n: int, box: tuple[float, float, float, float], seed: int = 1) -> DataFrame:
    """(id, lat, lon) in a box (lat_min, lon_min, lat_max, lon_max), six decimals."""
    a, b, c, d = box
    return spark.range(n).select("id", F.round(F.rand(seed) * (c - a) + a, 6).alias("lat"), F.round(F.rand(seed + 1) * (d - b) + b, 6).alias("lon"))
