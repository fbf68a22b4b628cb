"""Admission in messages: batches of at most ``batch_size`` messages out of landed files.

Spark's file stream admits whole files.  ``bounded_batches`` hands a micro-batch
on in parts of at most ``batch_size`` messages, in the order of files (time of
landing, then name) and of rows in them.  The place of a message is (file, row):
Parquet numbers the rows of a file itself, so a part is named by files and row
ranges, without a sort or a shuffle, and only its own files are read for it.  The last finished part is
recorded, so a restart goes on in the middle of a file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.streaming.runners import _write_batch

PLACE = ["_file", "_landed"]
PARTS = 1 << 24  # parts of a micro-batch that batch numbers leave room for


def landed_messages(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int = 100,
                    start_at=None) -> DataFrame:
    """Stream of landed Parquet files for ``bounded_batches``.

    ``start_at`` (a fixed time, kept over restarts) is "now" for a consumer
    that wants new messages only: the rows of files landed before it are not read."""
    df = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
          .select("*", F.col("_metadata.file_path").alias("_file"),
                  F.col("_metadata.file_modification_time").alias("_landed")))
    return df if start_at is None else df.where(F.col("_landed") >= F.lit(start_at))


def cut(files: list[tuple[str, int]], batch_size: int) -> Iterator[list[tuple[str, int, int]]]:
    """Parts of at most ``batch_size`` rows: lists of (file, first row, last row); all are full but the last."""
    part, room = [], batch_size
    for name, n in files:
        row = 0
        while row < n:
            take = min(room, n - row)
            part.append((name, row, row + take - 1))
            row, room = row + take, room - take
            if room == 0:
                yield part
                part, room = [], batch_size
    if part:
        yield part


def _rows_of(batch: DataFrame, columns: list[str], sizes: dict[str, int], part: list[tuple[str, int, int]]) -> DataFrame:
    spark = batch.sparkSession
    schema = T.StructType([f for f in batch.schema.fields if f.name in columns])
    reads = spark.read.schema(schema)
    pieces, whole = [], []
    for name, lo, hi in part:  # only the first and the last file of a part can be cut
        if hi - lo + 1 == sizes[name]:
            whole.append(name)
            continue
        if whole:
            pieces.append(reads.parquet(*whole))
            whole = []
        pieces.append(reads.parquet(name).where(F.col("_metadata.row_index").between(lo, hi)))
    if whole:
        pieces.append(reads.parquet(*whole))
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in pieces])


def bounded_batches(handle: Callable[[DataFrame, int], None], batch_size: int, log_path: str):
    """``foreachBatch`` body over ``landed_messages``: ``handle(messages, number)``
    for one part of at most ``batch_size`` messages after another, by rising number.

    A part that failed is handed out again under the same number and with the
    same messages, and so are those behind it; finished ones are not.  The
    driver holds a name and a count per file of the micro-batch
    (``max_files_per_trigger`` bounds them)."""
    if batch_size < 1:
        raise ValueError(f"batch_size must be positive: {batch_size}")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = [c for c in batch.columns if c not in PLACE]
        found = batch.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n")).collect()
        files = [(r["_file"], r["n"]) for r in sorted(found, key=lambda r: (r["_landed"], r["_file"]))]
        try:
            done = (spark.read.schema("part bigint, batch_id bigint").parquet(log_path)
                    .where(F.col("batch_id") == batch_id).agg(F.max("part")).first()[0])
        except AnalysisException:  # no part was ever finished
            done = None
        for k, part in enumerate(cut(files, batch_size)):
            if done is not None and k <= done:
                continue
            handle(_rows_of(batch, columns, dict(files), part), batch_id * PARTS + k)
            _write_batch(spark.range(1).select(F.lit(k).cast("bigint").alias("part")), batch_id, log_path)

    return run
