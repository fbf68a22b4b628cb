"""Folding of per-batch snapshots, so that a long-running stream reads few folders.

A stream writes one folder ``batch_id=<n>`` per micro-batch and overwrites it
when the batch is replayed.  Folders of batches before the running one never
change again: ``fold`` merges them into one base folder with a negative number
of its own and drops them; ``drop_before`` drops snapshots that newer ones replace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.session import ensure_checkpoint_dir

NAME = "batch_id"


def _folders(spark: SparkSession, path: str) -> tuple[object, dict[int, object]]:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return fs, {}
    found = [s.getPath() for s in fs.listStatus(root)]
    return fs, {int(p.getName().split("=", 1)[1]): p for p in found if p.getName().startswith(f"{NAME}=")}


def fold(spark: SparkSession, path: str, upto: int, merge: Callable[[DataFrame], DataFrame]) -> None:
    """All snapshots of batches before ``upto`` (positive) as one.

    ``merge`` must give the same when it sees a row again beside the merged
    ones (maxima and minima do): until the old folders are gone, readers see both.  The
    base folder appears whole, by one rename, and is not written again, so a
    call that failed is made good by calling it again or by a later one."""
    fs, folders = _folders(spark, path)
    base = -upto
    old = [n for n in folders if n < upto and n != base]
    if not old:
        return
    if base not in folders:
        ensure_checkpoint_dir(spark)
        rows = merge(spark.read.parquet(path).where(F.col(NAME) < upto).drop(NAME)).checkpoint(eager=True)
        (rows.withColumn(NAME, F.lit(base).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(NAME).parquet(path))
    for n in old:
        fs.delete(folders[n], True)


def drop_before(spark: SparkSession, path: str, batch_id: int) -> None:
    """Drop the snapshots of batches before ``batch_id``."""
    fs, folders = _folders(spark, path)
    for n, folder in folders.items():
        if n < batch_id:
            fs.delete(folder, True)


def drop(spark: SparkSession, path: str) -> None:
    """Drop a folder that one writer made for itself."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
