"""Ordering and completeness checks over block streams and stores.

Neighbour comparisons (lag/lead) are computed inside bounded buckets of the
ordering key -- never one window partition per chain, which would put a
hot chain into a single task.  The row before a bucket's first row comes
from a small per-bucket summary (last value of every bucket, shifted by one
bucket), so the result equals an unbucketed window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlake.functions.columns import div_floor
from chainlake.operators.store import dedupe_blocks

DEFAULT_BUCKET = 1_000_000


def with_previous(df: DataFrame, part: str, order: str, value: str, out: str,
                  bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """``out`` = ``value`` of the previous row by ``order`` within ``part``."""
    b = div_floor(F.col(order), bucket)
    d = df.withColumn("_b", b)
    inner = F.lag(value).over(Window.partitionBy(part, "_b").orderBy(order))
    d = d.withColumn("_prev", inner)
    summary = (d.groupBy(part, "_b").agg(F.max_by(value, order).alias("_last"))
               .withColumn("_carry", F.lag("_last").over(Window.partitionBy(part).orderBy("_b")))
               .select(part, "_b", "_carry"))
    return (d.join(summary, [part, "_b"], "left")
            .withColumn(out, F.coalesce("_prev", "_carry"))
            .drop("_b", "_prev", "_carry"))


def with_next(df: DataFrame, part: str, order: str, value: str, out: str,
              bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """``out`` = ``value`` of the next row by ``order`` within ``part``."""
    b = div_floor(F.col(order), bucket)
    d = df.withColumn("_b", b)
    inner = F.lead(value).over(Window.partitionBy(part, "_b").orderBy(order))
    d = d.withColumn("_nxt", inner)
    summary = (d.groupBy(part, "_b").agg(F.min_by(value, order).alias("_first"))
               .withColumn("_carry", F.lead("_first").over(Window.partitionBy(part).orderBy("_b")))
               .select(part, "_b", "_carry"))
    return (d.join(summary, [part, "_b"], "left")
            .withColumn(out, F.coalesce("_nxt", "_carry"))
            .drop("_b", "_nxt", "_carry"))


def bucketed_row_number(df: DataFrame, part: list[str], order: list[str], bucket_col, out: str) -> DataFrame:
    """``row_number() over (partition by part order by order)`` without a
    single window partition per key: rows are ranked inside ``bucket_col``
    (a value monotone in the order), and the rank is offset by the number of
    rows of the same key in earlier buckets (a cumulative sum over a small
    per-bucket count summary)."""
    d = df.withColumn("_b", bucket_col)
    local = F.row_number().over(Window.partitionBy(*part, "_b").orderBy(*order))
    d = d.withColumn("_local", local)
    counts = d.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return (d.join(offsets, [*part, "_b"])
            .withColumn(out, (F.col("_local") + F.col("_off")).cast("int"))
            .drop("_b", "_local", "_off"))


def check_ascending(arrivals: DataFrame, bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """Arrivals whose height is not above the previous arrival of the same
    chain (``arrivals(chain_id, seq, block_height)``)."""
    d = with_previous(arrivals.select("chain_id", "seq", "block_height"), "chain_id", "seq", "block_height",
                      "prev_height", bucket)
    return d.where(F.col("block_height") <= F.col("prev_height"))


def height_gaps(store: DataFrame, bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """Missing height ranges inside each chain (gaps-and-islands)."""
    h = store.select("chain_id", "block_height").distinct()
    d = with_next(h, "chain_id", "block_height", "block_height", "next_height", bucket)
    return (d.where(F.col("next_height") > F.col("block_height") + 1)
            .select("chain_id", (F.col("block_height") + 1).alias("gap_start"),
                    (F.col("next_height") - 1).alias("gap_end"),
                    (F.col("next_height") - F.col("block_height") - 1).alias("n_missing")))


def dedupe_first(arrivals: DataFrame) -> DataFrame:
    """First arrival per (chain, height) -- an aggregation with map-side
    combine rather than a window, so duplicates collapse before the shuffle."""
    return dedupe_blocks(arrivals, "first")


def dedupe_last(arrivals: DataFrame) -> DataFrame:
    return dedupe_blocks(arrivals, "last")


def backfill_range(heads: DataFrame, starts: DataFrame, archive: DataFrame) -> DataFrame:
    """Every stored block in ``[start, head]`` of each chain (catch-up after
    a restart; the start itself is fetched again)."""
    r = (starts.join(heads.select("chain_id", "head"), "chain_id")
         .select("chain_id", F.col("start_height"), F.col("head").alias("end_height")))
    from chainlake.operators.store import get_block_ranges
    return get_block_ranges(archive, r).select("chain_id", "block_height", "block")


def refetch_failed(expected: DataFrame, received: DataFrame) -> DataFrame:
    """Heights that were expected but never received: fetch them again."""
    return expected.select("chain_id", "block_height").join(
        received.select("chain_id", "block_height"), ["chain_id", "block_height"], "left_anti")


def expected_heights(heads: DataFrame, bucket: int = 100_000) -> DataFrame:
    """Every height from the chain's lowest to its head.  Heights are made in
    two steps -- buckets first, spread over tasks, then heights inside each
    bucket -- so a long chain is not generated by a single task."""
    b = (heads.select("chain_id", "low", "head",
                      F.explode(F.sequence(div_floor(F.col("low"), bucket),
                                           div_floor(F.col("head"), bucket))).alias("_b"))
         .repartition("chain_id", "_b"))
    lo = F.greatest(F.col("low"), F.col("_b") * bucket)
    hi = F.least(F.col("head"), F.col("_b") * bucket + bucket - 1)
    return b.select("chain_id", F.explode(F.sequence(lo, hi)).alias("block_height"))
