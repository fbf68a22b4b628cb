"""Block sources: landed files through Spark's own file stream, anything else
through a Python streaming data source.

``landed_blocks`` reads landed Parquet files (``chain_id, block_height,
block``).  Spark tracks files, not heights, so a file that lands late with
lower heights (backfill, out-of-order landing) is read like any other, on any
file system that Spark reads.  Blocks that land twice are removed by the
idempotent ``BlockTable.put``.

``register(spark, make_fetcher)`` is the extension point for sources that
Spark cannot read, such as a live chain.  A fetcher fetches the blocks of a
height range (``fetch(chain_id, lo, hi)``, rows of ``SCHEMA``) and says which
heights can be had: ``ranges() -> {chain_id: [(lo, hi), ...]}``, or, where every
height up to the head is there once the head is, ``heads() -> {chain_id: height}``.

The offset of a chain is the set of heights handed out, as merged ranges; a
micro-batch holds what can be had and is not in it, below the head too.  So a
height that was missing (a failed request, a node that fills holes late) is fetched
when it appears, none twice, and the offset grows with the holes and not
with the chain.  Every batch is split into ``heights_per_partition`` heights
that are fetched on the executors (never on the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "chain_id string, block_height bigint, block string"


def landed_blocks(spark: SparkSession, path: str, chains: list[str] | None = None,
                  max_files_per_trigger: int = 100) -> DataFrame:
    """Stream of the block files under ``path`` (``<path>/chain_id=<id>/*.parquet``), of some chains or of all."""
    from chainlake.streaming.runners import ingest_stream
    blocks = ingest_stream(spark, path, T.StructType.fromDDL(SCHEMA), max_files_per_trigger)
    return blocks if chains is None else blocks.where(F.col("chain_id").isin(chains))


class HeightRange(InputPartition):
    def __init__(self, chain_id: str, lo: int, hi: int):
        self.chain_id, self.lo, self.hi = chain_id, lo, hi


Ranges = list[tuple[int, int]]


def merge_ranges(*sets: Ranges) -> Ranges:
    """Union of sets of heights: ascending ranges, both ends included, that neither overlap nor touch."""
    out: Ranges = []
    for lo, hi in sorted((int(a), int(b)) for ranges in sets for a, b in ranges):
        if lo > hi:
            continue
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def subtract_ranges(ranges: Ranges, taken: Ranges) -> Ranges:
    """Heights of ``ranges`` that are not in ``taken``; both as ``merge_ranges`` gives them."""
    out, k = [], 0
    for lo, hi in ranges:
        while k < len(taken) and taken[k][1] < lo:
            k += 1
        i = k
        while i < len(taken) and taken[i][0] <= hi:
            if lo < taken[i][0]:
                out.append((lo, taken[i][0] - 1))
            lo = max(lo, taken[i][1] + 1)
            i += 1
        if lo <= hi:
            out.append((lo, hi))
    return out


def _decoded(offset: dict | None) -> dict[str, Ranges]:
    """An offset as Spark keeps it; one last height (the earlier form) is every height up to it."""
    return {cid: merge_ranges([(0, v)] if isinstance(v, int) else v) for cid, v in (offset or {}).items()}


class BlockStreamReader(DataSourceStreamReader):
    """Offsets: ``{chain_id: [[lo, hi], ...]}``, the heights handed out."""

    def __init__(self, fetcher, options: dict):
        self.fetcher = fetcher
        self.per_partition = int(options.get("heights_per_partition", "10000"))
        self.seen: dict[str, Ranges] = {}

    def _note(self, offset: dict | None) -> None:
        for cid, ranges in _decoded(offset).items():
            self.seen[cid] = merge_ranges(self.seen.get(cid, []), ranges)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, start: dict = None, limit=None) -> dict:  # noqa: ARG002
        # a long catch-up becomes many partitions (executors), not many batches;
        # what was seen stays in the offset even if the fetcher no longer lists it
        self._note(start)
        if hasattr(self.fetcher, "ranges"):
            self._note({cid: list(r) for cid, r in self.fetcher.ranges().items()})
        else:
            self._note({cid: [(0, head)] for cid, head in self.fetcher.heads().items()})
        return {cid: [list(r) for r in ranges] for cid, ranges in sorted(self.seen.items())}

    def partitions(self, start: dict, end: dict):
        self._note(start)
        before = _decoded(start)
        return [HeightRange(cid, a, min(a + self.per_partition - 1, hi))
                for cid, ranges in sorted(_decoded(end).items())
                for lo, hi in subtract_ranges(ranges, before.get(cid, []))
                for a in range(lo, hi + 1, self.per_partition)]

    def read(self, partition: HeightRange):
        yield from self.fetcher.fetch(partition.chain_id, partition.lo, partition.hi)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession, make_fetcher) -> None:
    """``spark.readStream.format("chainlake_blocks")[.option("heights_per_partition", n)].load()``
    reads from ``make_fetcher(options)``, which is sent to the executors."""

    class BlockSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "chainlake_blocks"

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema):  # noqa: ARG002
            return BlockStreamReader(make_fetcher(self.options), self.options)

    spark.dataSource.register(BlockSource)
