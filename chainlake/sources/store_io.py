"""Persistent block store: a Parquet dataset partitioned by ``chain_id`` and
``height_bucket``.

* Range reads add the derived bucket predicate, so partition pruning and
  Parquet row-group filtering apply.
* ``put`` is idempotent: the batch is deduplicated, only the partitions it
  touches are read (dynamic partition pruning through a semi-join on the
  partition columns), and only heights the store lacks are appended.
* Every write carries a ``version`` (a growing number).  A deletion appends
  tombstones, which hide only rows of an earlier version, so a block that is
  put again after its deletion is visible.
* Zones: every write first records the bounds and the number of its rows per
  partition, so that the newest rows of each chain are read from its highest
  partitions alone (``latest``).  Zones may count too much (a write that failed,
  a deletion of absent rows); what is read is counted before it is trusted.
* Nothing is rewritten in place: an upsert (``last``) appends the new rows
  and then hides the replaced ones, so concurrent puts lose nothing.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chainlake.operators import store as st
from chainlake.session import ensure_checkpoint_dir

STORE_SCHEMA = T.StructType([
    T.StructField("block_height", T.LongType()),
    T.StructField("block", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("version", T.LongType()),
    T.StructField("chain_id", T.StringType()),
    T.StructField("height_bucket", T.LongType()),
])
PARTITIONS = ["chain_id", "height_bucket"]
CODEC = "zstd"  # of the blocks; they are JSON with many repeats, of which Parquet's default leaves about twice as much
ZONE_SCHEMA = T.StructType([
    T.StructField("chain_id", T.StringType()),
    T.StructField("height_bucket", T.LongType()),
    T.StructField("low", T.LongType()),
    T.StructField("head", T.LongType()),
    T.StructField("n", T.LongType()),
])


class BlockTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self._version = 0

    def exists(self) -> bool:
        return self._has_files()

    def _has_files(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(conf).exists(p)

    def init(self) -> "BlockTable":
        """Create the dataset if absent; calling it again is a no-op."""
        if not self._has_files():
            self.spark.createDataFrame([], ZONE_SCHEMA).write.mode("append").parquet(self.zone_path)
            (self.spark.createDataFrame([], STORE_SCHEMA)
             .write.mode("ignore").partitionBy(*PARTITIONS).parquet(self.path))
        return self

    @property
    def zone_path(self) -> str:
        return self.path.rstrip("/") + "__zones"

    def _record(self, rows: DataFrame, sign: int = 1, of: DataFrame | None = None) -> None:
        """Add the zones of ``rows`` (with PARTITIONS), before they are written; ``sign`` -1 for rows to hide.
        All partitions of the batch ``of`` are named, whatever other writers change until the write.  Only heights are read."""
        if not self._exists(self.zone_path):
            self.rebuild_zones()
        zones = self._zones_of(rows, sign)
        if of is not None:
            zones = zones.unionByName(self._zones_of(of, 0))
        zones.write.mode("append").parquet(self.zone_path)

    @staticmethod
    def _zones_of(rows: DataFrame, sign: int = 1) -> DataFrame:
        return rows.groupBy(*PARTITIONS).agg(F.min("block_height").alias("low"), F.max("block_height").alias("head"),
                                             (F.count(F.lit(1)) * sign).alias("n"))

    def rebuild_zones(self) -> None:
        """Zones of a table that was written without them; only its heights are read."""
        if self._has_files():
            self._zones_of(self.read()).write.mode("append").parquet(self.zone_path)

    def zones(self) -> DataFrame:
        """(chain_id, height_bucket, low, head, n): bounds of all rows ever written to a partition and about how many are visible."""
        if not self._exists(self.zone_path):
            self.rebuild_zones()
        return (self.spark.read.schema(ZONE_SCHEMA).parquet(self.zone_path).groupBy(*PARTITIONS)
                .agg(F.min("low").alias("low"), F.max("head").alias("head"), F.sum("n").alias("n")))

    def fold_zones(self) -> None:
        """One row per partition in place of one per write.  Until the old files are gone a partition counts twice,
        which ``latest`` finds out."""
        ensure_checkpoint_dir(self.spark)
        zones = _with_file(self.spark.read.schema(ZONE_SCHEMA).parquet(self.zone_path))
        old = zones.select("_file").distinct().checkpoint(eager=True)
        folded = (zones.join(old, "_file", "left_semi").groupBy(*PARTITIONS)
                  .agg(F.min("low").alias("low"), F.max("head").alias("head"), F.sum("n").alias("n")).checkpoint(eager=True))
        folded.write.mode("append").parquet(self.zone_path)
        self._delete(old)

    def newest_partitions(self, n: int) -> DataFrame:
        """(chain_id, height_bucket) of each chain from the highest down, until its zones count ``n`` rows."""
        zones = self.zones()
        down = Window.partitionBy("chain_id").orderBy(F.col("height_bucket").desc())
        top = zones.where("n > 0").withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= n)  # a group limit
        above = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = (top.withColumn("above", above).where(F.col("above") < n)
               .groupBy("chain_id").agg(F.min("height_bucket").alias("cut")))  # one row per chain
        # partitions above the cut may hold rows even where as many were deleted as written
        return zones.join(F.broadcast(cut), "chain_id").where(F.col("height_bucket") >= F.col("cut")).select(*PARTITIONS)

    def latest(self, n: int) -> DataFrame:
        """The ``n`` rows of each chain with the largest heights, read from its newest partitions.

        Chains whose newest partitions hold fewer rows than their zones said
        are read whole, so the result is that of a full scan."""
        ensure_checkpoint_dir(self.spark)
        if n <= 0 or not self._has_files():
            return st.latest_n_per_chain(self.spark.createDataFrame([], STORE_SCHEMA).drop("version"), 0)
        parts = self.newest_partitions(n).checkpoint(eager=True)  # a few per chain
        top = st.latest_n_per_chain(self.read().join(F.broadcast(parts), PARTITIONS, "left_semi"), n).checkpoint(eager=True)
        found = top.groupBy("chain_id").agg(F.count(F.lit(1)).alias("found"))
        more = self.zones().join(F.broadcast(parts), PARTITIONS, "left_anti").select("chain_id").distinct()
        short = more.join(found, "chain_id", "left").where(F.coalesce("found", F.lit(0)) < n).select("chain_id").checkpoint(eager=True)
        if short.isEmpty():
            return top
        rest = st.latest_n_per_chain(self.read().join(F.broadcast(short), "chain_id", "left_semi"), n)
        return top.join(F.broadcast(short), "chain_id", "left_anti").unionByName(rest)

    def heads(self) -> DataFrame:
        """(chain_id, head): largest visible height of each chain, from its newest partitions."""
        return self.latest(1).select("chain_id", F.col("block_height").alias("head"))

    @property
    def tombstone_path(self) -> str:
        return self.path.rstrip("/") + "__deleted"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    def _next_version(self) -> int:
        """A number above that of every earlier write of this driver (and, by the clock, of others)."""
        self._version = max(time.time_ns(), self._version + 1)
        return self._version

    @staticmethod
    def _visible(data: DataFrame, tombs: DataFrame) -> DataFrame:
        # the partition columns are join keys too: a pruned read prunes the tombstones alike
        member = [*PARTITIONS, "block_height", "block"]
        gone = tombs.groupBy(*member).agg(F.max("version").alias("_gone"))
        hidden = F.col("_gone").isNotNull() & (F.coalesce("version", F.lit(0)) <= F.col("_gone"))
        return data.join(gone, member, "left").where(~hidden).select(*data.columns)

    def read(self) -> DataFrame:
        """Visible rows."""
        data = self.spark.read.schema(STORE_SCHEMA).parquet(self.path)
        if not self._exists(self.tombstone_path):
            return data.drop("version")
        tombs = self.spark.read.schema(STORE_SCHEMA).parquet(self.tombstone_path)
        return self._visible(data, tombs).drop("version")

    def delete(self, members: DataFrame) -> None:
        """Hide exact members by appending tombstones: nothing is rewritten,
        so a failure mid-way can only leave a member visible a bit longer.
        Rows that are put later are not hidden."""
        self._hide(members, self._next_version())

    def _hide(self, members: DataFrame, version: int) -> None:
        members = self.prepare(members)
        self._record(members, -1)
        (self._dealt(members.withColumn("version", F.lit(version)))
         .write.mode("append").partitionBy(*PARTITIONS).parquet(self.tombstone_path))

    @staticmethod
    def prepare(batch: DataFrame) -> DataFrame:
        """Rows with the table's columns; those without a chain or a height have no place in it."""
        b = batch if "seq" in batch.columns else batch.withColumn("seq", F.lit(0).cast("bigint"))
        return b.where(F.col("chain_id").isNotNull() & F.col("block_height").isNotNull()).select("chain_id", "block_height", "block", "seq").withColumn(
            "height_bucket", st.height_bucket(F.col("block_height")))

    @staticmethod
    def _dealt(rows: DataFrame) -> DataFrame:
        """Rows to append, a partition in one task: a batch over all heights writes a file per partition, not one per
        partition and task.  A partition has at most ``HEIGHT_BUCKET`` heights."""
        return rows.select(*[f.name for f in STORE_SCHEMA.fields]).repartition(*PARTITIONS)

    def _touched(self, batch: DataFrame) -> DataFrame:
        """Stored rows of the partitions the batch touches (pruned by DPP)."""
        parts = batch.select(*PARTITIONS).distinct()
        return self.read().join(parts, PARTITIONS, "left_semi")

    def put(self, batch: DataFrame, policy: str = "first") -> None:
        self.init()
        b = st.dedupe_blocks(self.prepare(batch), policy).withColumn(
            "height_bucket", st.height_bucket(F.col("block_height")))
        existing = self._touched(b)
        if policy == "first":
            new = b.join(existing.select(*st.KEY), st.KEY, "left_anti")
            self._record(new, of=b)
            (self._dealt(new.withColumn("version", F.lit(self._next_version())))
             .write.mode("append").option("compression", CODEC).partitionBy(*PARTITIONS).parquet(self.path))
            return
        hides, version = self._next_version(), self._next_version()
        new = b.join(existing.select(*st.KEY, "block"), [*st.KEY, "block"], "left_anti")
        self._record(new, of=b)
        (self._dealt(new.withColumn("version", F.lit(version)))
         .write.mode("append").option("compression", CODEC).partitionBy(*PARTITIONS).parquet(self.path))
        if policy == "last":  # the replaced rows are older than ``hides``, the new ones are not
            winner = b.select(*st.KEY, F.col("block").alias("_new"))
            self._hide(existing.join(winner, st.KEY).where("block <> _new").drop("_new"), hides)

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def compact(self) -> int:
        """Apply tombstones physically; returns the number of partitions
        touched.  The files of the partitions with tombstones are listed; their
        live rows are appended as new files, then exactly the listed data files
        and, last, the listed tombstone files are deleted.  What other writers
        add in the meantime stays.  Until the end a reader may see a live row
        twice, never too few; a failed call is made good by the next one.  A
        query that began before must be started anew when its files are gone.

        The lists are tables that scans give (files without a row are not in
        them and do no harm) and the files are deleted by tasks, so neither
        grows in the driver."""
        if not self._exists(self.tombstone_path):
            return 0
        ensure_checkpoint_dir(self.spark)
        tombs = _with_file(self.spark.read.schema(STORE_SCHEMA).parquet(self.tombstone_path))
        old_tombs = tombs.select(*PARTITIONS, "_file").distinct().checkpoint(eager=True)
        parts = old_tombs.select(*PARTITIONS).distinct()
        touched = parts.count()
        if not touched:
            return 0
        data = _with_file(self.spark.read.schema(STORE_SCHEMA).parquet(self.path))
        old_data = data.select(*PARTITIONS, "_file").join(parts, PARTITIONS, "left_semi").distinct().checkpoint(eager=True)
        live = self._visible(*(rows.join(files, [*PARTITIONS, "_file"], "left_semi").drop("_file")
                               for rows, files in ((data, old_data), (tombs, old_tombs))))
        live = (live.groupBy(*PARTITIONS, "block_height", "block")
                .agg(F.min("seq").alias("seq"), F.max("version").alias("version")))
        live = live.select(*[f.name for f in STORE_SCHEMA.fields]).checkpoint(eager=True)
        live.write.mode("append").partitionBy(*PARTITIONS).parquet(self.path)
        self._delete(old_data)
        self._delete(old_tombs)
        return touched

    def _delete(self, files: DataFrame) -> None:
        """Delete the listed ``_file``s in tasks; those that the tasks' client cannot reach go through the driver's."""
        tasks = self.spark.sparkContext.defaultParallelism
        left = files.select("_file").repartition(tasks, "_file").mapInArrow(_delete_in_task, "_file string").checkpoint(eager=True)
        jvm, fs = self._fs()
        for row in left.toLocalIterator():
            fs.delete(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["_file"])), False)

    def get_blocks(self, chain_id: str, start: int, end: int) -> DataFrame:
        return st.get_blocks(self.read(), chain_id, start, end)


def _with_file(rows: DataFrame) -> DataFrame:
    """``rows`` of a scan with the file that each one is in."""
    return rows.withColumn("_file", F.col("_metadata.file_path"))


def _delete_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Delete files by their addresses; gives back those that were not there or have no client here."""
    from pyarrow import fs

    for batch in batches:
        left = []
        for address in batch.column("_file").to_pylist():
            try:
                client, path = fs.FileSystem.from_uri(address)
                client.delete_file(path)
            except (OSError, ValueError):  # a task that ran again, an unknown store: the driver tries
                left.append(address)
        yield pa.RecordBatch.from_pydict({"_file": pa.array(left, pa.string())})


def tiered_latest(hot: BlockTable, cold: BlockTable, n: int) -> DataFrame:
    """Latest ``n`` of every chain over both tiers, from the newest partitions of each."""
    return st.tiered_latest_blocks(hot.latest(n), cold.latest(n), n)


def write_blocks_partitioned(blocks: DataFrame, path: str) -> None:
    """Bulk load (dynamic partition overwrite of the touched partitions)."""
    BlockTable(blocks.sparkSession, path)._record(BlockTable.prepare(blocks))
    (BlockTable.prepare(blocks).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PARTITIONS).parquet(path))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    import uuid
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
