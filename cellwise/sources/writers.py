"""Sinks: CSV and Parquet folders, the console, and the exports of sketches, grids, models and centers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = False) -> None:
    """Overwrites the folder. Arrays are written as text with blanks between entries."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").options(sep=delimiter, header=str(header).lower()).csv(path)


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)


def console(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)


def sketch_export(heavy_hitters: DataFrame, enumerated: DataFrame, combined: DataFrame, path: str) -> None:
    """Three folders: heavyhitters (``key=>count``), enumerated-input-space and hh-input-space (blank-separated)."""
    heavy_hitters.select(F.concat_ws("=>", "key", F.col("cnt").cast("string")).alias("value")).write.mode("overwrite").text(f"{path}/heavyhitters")
    csv(enumerated, f"{path}/enumerated-input-space", " ")
    csv(combined, f"{path}/hh-input-space", " ")


def matrix_export(matrix: DataFrame, y: str, path: str) -> None:
    """One line a y, descending: the values of the line separated by blanks. A matrix is one file, so it is one task."""
    line = F.array_join(F.transform("line", lambda v: v.cast("string")), " ")
    matrix.orderBy(F.col(y).desc()).select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def per_center(df: DataFrame, path: str) -> None:
    """Results of all centers in one table, one folder a center."""
    df.write.mode("overwrite").options(sep="\t", header="true").partitionBy("center").csv(path)
