"""Block store operators over ``(chain_id, block_height, block[, seq])`` DataFrames.

A store is any DataFrame with those columns -- a Parquet table partitioned by
``chain_id`` and ``height_bucket`` in production (see ``sources.store_io``),
or a derived view in tests.  Every operator works on all chains at once;
single-chain calls are a filter on top.

Duplicate policies (``policy``):

* ``first`` -- insert-ignore: an existing height wins, then the earliest
  arrival (smallest ``seq``) of the incoming batch.  Default.
* ``last``  -- upsert: the incoming batch wins, latest arrival first.
* ``exact`` -- set of members: the same height with different payloads is
  kept once per distinct payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlake.functions.columns import div_floor

KEY = ["chain_id", "block_height"]
STORE_COLUMNS = ["chain_id", "block_height", "block"]
HEIGHT_BUCKET = 10_000  # heights per storage partition


def height_bucket(height: Column) -> Column:
    return div_floor(height, HEIGHT_BUCKET)


def _height_between(df: DataFrame, start: Column, end: Column) -> Column:
    """Inclusive height range; adds the derived bucket predicate when the
    store is partitioned so that partition pruning applies (Catalyst cannot
    infer the bucket range from the height range by itself)."""
    cond = (F.col("block_height") >= start) & (F.col("block_height") <= end)
    if "height_bucket" in df.columns:
        cond = cond & F.col("height_bucket").between(height_bucket(start), height_bucket(end))
    return cond


def _with_seq(df: DataFrame) -> DataFrame:
    return df if "seq" in df.columns else df.withColumn("seq", F.lit(0).cast("bigint"))


def dedupe_blocks(incoming: DataFrame, policy: str = "first") -> DataFrame:
    """Collapse a batch to one row per height (``first``/``last``) or per
    member (``exact``).  Aggregation with ``min_by``/``max_by`` is partial:
    each task pre-aggregates before the shuffle on (chain, height).  Rows
    without a chain, a height or a document are no blocks (``payloads.split_blocks``
    lists them): putting them changes nothing."""
    incoming = _with_seq(incoming).dropna(subset=[*KEY, "block"])
    if policy == "exact":
        return (incoming.groupBy(*KEY, "block").agg(F.min("seq").alias("seq"))
                .select(*KEY, "block", "seq"))
    pick = F.min_by if policy == "first" else F.max_by
    return (incoming.groupBy(*KEY)
            .agg(pick(F.struct("seq", "block"), F.struct("seq", "block")).alias("r"))  # ties: by payload
            .select(*KEY, F.col("r.block").alias("block"), F.col("r.seq").alias("seq")))


def _split_by_batch_span(store: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store rows inside / outside each chain's height span of the batch.
    Only the inside part takes part in the key join, so a put never
    shuffles the rest of the store.  The span table has one row per chain."""
    span = F.broadcast(batch.groupBy("chain_id").agg(F.min("block_height").alias("_lo"),
                                                     F.max("block_height").alias("_hi")))
    tagged = store.join(span, "chain_id", "left")
    inside = F.coalesce((F.col("block_height") >= F.col("_lo")) & (F.col("block_height") <= F.col("_hi")), F.lit(False))
    cols = store.columns
    return tagged.where(inside).select(*cols), tagged.where(~inside).select(*cols)


def put_blocks(store: DataFrame, incoming: DataFrame, policy: str = "first") -> DataFrame:
    """Store after putting ``incoming``; idempotent (putting twice = once)."""
    if policy not in ("first", "last", "exact"):
        raise ValueError(f"unknown policy {policy!r}")
    store = _with_seq(store).select(*KEY, "block", "seq")
    batch = dedupe_blocks(incoming.select(*KEY, "block", *(["seq"] if "seq" in incoming.columns else [])), policy)
    near, far = _split_by_batch_span(store, batch)
    if policy == "first":
        # insert-ignore: only heights the store does not have yet
        new_rows = batch.join(near.select(*KEY), KEY, "left_anti")
        return store.unionByName(new_rows)
    if policy == "last":
        kept = near.join(batch.select(*KEY), KEY, "left_anti")
        return far.unionByName(kept).unionByName(batch)
    new_members = batch.join(near.select(*KEY, "block"), KEY + ["block"], "left_anti")
    return store.unionByName(new_members)


def delete_blocks(store: DataFrame, members: DataFrame) -> DataFrame:
    """Remove the listed members (exact rows); an empty list is a no-op.
    Only rows inside the members' height span are joined."""
    m = members.select(*KEY, "block")
    near, far = _split_by_batch_span(store, m)
    return far.unionByName(near.join(m, KEY + ["block"], "left_anti"))


def get_blocks(store: DataFrame, chain_id: str, start: int, end: int) -> DataFrame:
    """Inclusive range of one chain, ascending; empty when ``start > end``."""
    s, e = F.lit(start).cast("bigint"), F.lit(end).cast("bigint")
    return (store.where((F.col("chain_id") == chain_id) & _height_between(store, s, e))
            .orderBy("block_height"))


RANGE_BUCKET = 1024  # heights per join bucket of a range read


def get_block_ranges(store: DataFrame, ranges: DataFrame, range_bucket: int = RANGE_BUCKET) -> DataFrame:
    """Bulk range read: ``ranges(chain_id, start_height, end_height[, range_id])``.

    A range join done as an equi-join: every range is exploded into the
    ``range_bucket``-wide height buckets it covers and joined on ``(chain_id,
    bucket)``, then filtered to the exact bounds -- no nested loop, and the
    work per block is bounded by the ranges that overlap its bucket.  On a
    partitioned store the touched storage buckets are semi-joined first so
    dynamic partition pruning skips the rest.
    """
    r = ranges if "range_id" in ranges.columns else ranges.withColumn("range_id", F.lit(0).cast("bigint"))
    r = r.where(F.col("start_height") <= F.col("end_height"))
    rb = F.explode(F.sequence(div_floor(F.col("start_height"), range_bucket),
                              div_floor(F.col("end_height"), range_bucket))).alias("_rb")
    r = r.select("*", rb)
    s = store
    if "height_bucket" in store.columns:
        lo_part = div_floor(F.col("_rb") * range_bucket, HEIGHT_BUCKET)
        hi_part = div_floor(F.col("_rb") * range_bucket + range_bucket - 1, HEIGHT_BUCKET)
        parts = (r.select("chain_id", F.explode(F.array_distinct(F.array(lo_part, hi_part))).alias("height_bucket"))
                 .distinct())
        s = s.join(parts, ["chain_id", "height_bucket"], "left_semi")
    s = s.withColumn("_rb", div_floor(F.col("block_height"), range_bucket))
    joined = s.join(r, ["chain_id", "_rb"]).drop("_rb")
    return joined.where(_height_between(joined, F.col("start_height"), F.col("end_height")))


def latest_blocks(store: DataFrame, chain_id: str, n: int) -> DataFrame:
    """Top ``n`` of one chain by height, descending; ``n <= 0`` is empty."""
    return (store.where(F.col("chain_id") == chain_id)
            .orderBy(F.col("block_height").desc()).limit(max(n, 0)))


def earliest_blocks(store: DataFrame, chain_id: str, n: int) -> DataFrame:
    """Bottom ``n`` of one chain by height, ascending."""
    return (store.where(F.col("chain_id") == chain_id)
            .orderBy(F.col("block_height").asc()).limit(max(n, 0)))


def latest_n_per_chain(store: DataFrame, n: int, ascending: bool = False) -> DataFrame:
    """Latest (or earliest) ``n`` of every chain.  ``row_number <= n`` is
    planned as a WindowGroupLimit, so every task keeps only n rows per chain
    before the shuffle -- a hot chain does not pile up in one task."""
    order = F.col("block_height").asc() if ascending else F.col("block_height").desc()
    w = Window.partitionBy("chain_id").orderBy(order)
    return (store.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= F.lit(max(n, 0))))


def latest_block(store: DataFrame) -> DataFrame:
    """Block with the largest height of every chain."""
    return (store.groupBy("chain_id")
            .agg(F.max("block_height").alias("block_height"),
                 F.max_by("block", "block_height").alias("block")))


def batch_head(batch: DataFrame) -> DataFrame:
    """Largest height per chain in a batch."""
    return batch.groupBy("chain_id").agg(F.max("block_height").alias("head"))


def advance_head(previous: DataFrame, batch: DataFrame) -> DataFrame:
    """Monotone chain heads: ``greatest(old, batch max)`` so a replayed older
    batch never lowers the head."""
    new = batch_head(batch).withColumnRenamed("head", "batch_head")
    return (previous.join(new, "chain_id", "full")
            .select("chain_id", F.greatest("head", "batch_head").alias("head")))


def store_counts(store: DataFrame) -> DataFrame:
    return store.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_blocks"))


def resume_height(store: DataFrame) -> DataFrame:
    """Inclusive restart point of every chain: the stored maximum height
    (that block is ingested again; put is idempotent)."""
    return store.groupBy("chain_id").agg(F.max("block_height").alias("start_height"))


def range_completeness(store: DataFrame, ranges: DataFrame) -> DataFrame:
    """Whether a store holds every height of each requested range."""
    r = ranges if "range_id" in ranges.columns else ranges.withColumn("range_id", F.lit(0).cast("bigint"))
    found = (get_block_ranges(store, r)
             .groupBy("range_id").agg(F.countDistinct("block_height").alias("n_found")))
    return (r.join(found, "range_id", "left")
            .select("range_id", "chain_id", "start_height", "end_height",
                    F.coalesce("n_found", F.lit(0)).alias("n_found"),
                    (F.coalesce("n_found", F.lit(0)) ==
                     F.greatest(F.col("end_height") - F.col("start_height") + 1, F.lit(0))).alias("complete")))


# --------------------------------------------------------------------------
# Tiered reads: hot (recent, write-optimised) over cold (archive)
# --------------------------------------------------------------------------

def _prefer_hot(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Union where a height present in hot hides the cold copy."""
    hot = hot.select(*STORE_COLUMNS)
    cold_only = cold.select(*STORE_COLUMNS).join(hot.select(*KEY), KEY, "left_anti")
    return hot.unionByName(cold_only)


def tiered_get_blocks(hot: DataFrame, cold: DataFrame, ranges: DataFrame) -> DataFrame:
    """Range read over both tiers, ascending, hot copy preferred.  Only the
    requested ranges of each tier are read before the union."""
    h = get_block_ranges(hot, ranges).select(*STORE_COLUMNS)
    c = get_block_ranges(cold, ranges).select(*STORE_COLUMNS)
    return _prefer_hot(h, c)


def tiered_latest_blocks(hot: DataFrame, cold: DataFrame, n: int) -> DataFrame:
    """True latest ``n`` of every chain over both tiers (no underflow when
    the hot tier holds fewer than n).  Each tier contributes at most n rows
    per chain before the union, so the dedupe works on O(chains * n) rows."""
    h = latest_n_per_chain(hot.select(*STORE_COLUMNS), n).drop("rank")
    c = latest_n_per_chain(cold.select(*STORE_COLUMNS), n).drop("rank")
    return latest_n_per_chain(_prefer_hot(h, c), n)


def tiered_latest_block(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Latest block of each chain: from hot when hot has the chain, else cold."""
    h = latest_block(hot).withColumn("tier", F.lit("hot"))
    c = latest_block(cold).withColumn("tier", F.lit("cold"))
    return (h.unionByName(c).groupBy("chain_id")
            .agg(F.min_by(F.struct("block_height", "block", "tier"), F.col("tier") != "hot").alias("r"))
            .select("chain_id", "r.*"))


def flush_plan(hot: DataFrame, threshold: int) -> DataFrame:
    """Blocks one flush moves from hot to cold per chain: the earliest
    ``threshold`` blocks, and only when at least that many exist."""
    w = Window.partitionBy("chain_id")
    earliest = latest_n_per_chain(hot.select(*STORE_COLUMNS), threshold, ascending=True)
    return (earliest.withColumn("n", F.count(F.lit(1)).over(w))
            .where(F.col("n") >= F.lit(threshold)).drop("n"))


def flush_hot_to_cold(hot: DataFrame, cold: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """One flush tick: ``(new_hot, new_cold)``.  Write-then-delete order is
    kept by the streaming driver; put is idempotent so a replay is safe."""
    moved = flush_plan(hot, threshold).drop("rank")
    new_cold = put_blocks(cold, moved, "first").select(*STORE_COLUMNS)
    new_hot = delete_blocks(hot.select(*STORE_COLUMNS), moved)
    return new_hot, new_cold
