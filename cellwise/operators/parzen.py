"""Windowed geo-temporal counts, exact against sketched.

Every center asks for the cells of a box around it that are within a radius, for each hour and trip type. All centers are answered by one plan: centers are
exploded to cells (whole-number offsets), joined to the cells' exact and estimated counts, and added up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.functions.scalar import haversine

LONG, SHORT = 1, 2


def window_cells(centers: DataFrame, precision: int, window: int, radius: float) -> DataFrame:
    """(center, hour_from.., g0, g1) of cells at most ``window`` steps away on each axis whose whole meters of distance are below ``radius``.

    ``centers`` has ``center``, ``c0``, ``c1`` (whole-number lat and lon) and any further columns.
    """
    axis = F.sequence(F.lit(-window), F.lit(window))
    out = centers.withColumn("d0", F.explode(axis)).withColumn("d1", F.explode(axis))
    out = out.withColumn("g0", F.col("c0") + F.col("d0")).withColumn("g1", F.col("c1") + F.col("d1"))
    s = F.lit(float(10**precision))
    far = haversine(F.col("c0") / s, F.col("c1") / s, F.col("g0") / s, F.col("g1") / s).cast("int")
    return out.where(far < F.lit(radius)).drop("d0", "d1")


def count_windows(centers: DataFrame, cells: DataFrame, precision: int, window: int, radius: float, hour_step: int = 1) -> DataFrame:
    """Per center, hour slot and type: real_count, sketch_count, and false_positive (estimates of cells without any real trip).

    ``cells`` holds (g0, g1, trip_type, hour, real, estimate), one row a cell: real 0 where only the sketch has something.
    """
    asked = window_cells(centers, precision, window, radius).select("center", "g0", "g1")
    joined = asked.join(cells, ["g0", "g1"])
    slot = (F.floor(F.col("hour") / hour_step) * hour_step).cast("int").alias("hour_slot")
    return joined.groupBy("center", slot, "trip_type").agg(
        F.sum("real").alias("real_count"),
        F.sum("estimate").alias("sketch_count"),
        F.sum(F.when(F.col("real") == 0, F.col("estimate")).otherwise(F.lit(0))).alias("false_positive"),
    )


def long_or_short(counts: DataFrame) -> DataFrame:
    """Per center and hour slot: counts of both types, and whether long trips are the more likely by the truth and by the sketch.

    Where nothing was counted the shares are 0/0; such a slot counts as short.
    """
    pick = lambda c, t: F.coalesce(F.sum(F.when(F.col("trip_type") == t, F.col(c))), F.lit(0))
    wide = counts.groupBy("center", "hour_slot").agg(
        pick("real_count", LONG).alias("real_long"), pick("real_count", SHORT).alias("real_short"),
        pick("sketch_count", LONG).alias("sketch_long"), pick("sketch_count", SHORT).alias("sketch_short"),
        F.sum("false_positive").alias("false_positive"),
    )
    share = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    more = lambda p: F.coalesce(share(f"{p}_long", f"{p}_short") > share(f"{p}_short", f"{p}_long"), F.lit(False))
    return wide.withColumn("is_long", more("real")).withColumn("predicted_long", more("sketch"))
