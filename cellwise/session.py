"""Session, table and shared-folder helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "cellwise", partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and benches."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder. On a cluster a missing setting is an error, because a
    machine-local folder would be lost with its executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cellwise-")
        spark.conf.set("spark.checkpoint.dir", found)
        _drop_at_exit(spark, found)
    return found


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass

    atexit.register(drop)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, keeps its statistics for the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _drop_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _drop_at_exit(spark, path)
    return path


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that no later action reads: of rounds that a loop has left behind. Tables that are not staged are left alone."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path:
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            df._staged_at = None


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, dealt out to all cores if it has fewer partitions than there are cores (one small file is one partition).

    For costly Python steps over few, small files; a scan with enough partitions is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def python_partitions(spark: SparkSession) -> int:
    """Partitions for costly Python steps over compact rows, which adaptive execution would else put in a few tasks for being small in bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else without."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_hot(left: DataFrame, right: DataFrame, on: Column, hot: Column) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key: rows of ``right`` for which ``hot`` holds are broadcast, the others are joined by shuffle, so that no
    key gathers many rows of ``left`` in one task. The caller proves that few are hot, as by a least share of all rows. ``hot`` must not be null."""
    marked = left.join(F.broadcast(right.where(hot).withColumn("_hot", F.lit(True))), on, "left")
    met = marked.where("_hot").drop("_hot")
    rest = marked.where("_hot IS NULL").select(*left.columns).join(right.where(~hot), on)
    return met.unionByName(rest)
