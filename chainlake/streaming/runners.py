"""Structured Streaming forms of the batch operators.

Each micro-batch runs the same DataFrame functions as the batch path inside
``foreachBatch``; the streaming checkpoint is the acknowledgement (a batch
that fails is replayed from its offsets), and every write is keyed so that a
replay leaves the same result:

* blocks go through ``BlockTable.put`` (insert-ignore by chain and height);
* chain heads are written as one snapshot per ``batch_id`` (overwriting the
  same snapshot on replay); the head is the max over snapshots, so it only
  moves forward even if an older batch is replayed;
* billing outcomes are written per ``batch_id`` partition, overwritten on
  replay.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.operators import billing as bl
from chainlake.operators import store as st
from chainlake.session import ensure_checkpoint_dir, shuffle_files_dropped
from chainlake.sources.store_io import CODEC, BlockTable, fresh_path
from chainlake.streaming import snapshots

ARRIVAL_SCHEMA = T.StructType([
    T.StructField("chain_id", T.StringType()),
    T.StructField("block_height", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("block", T.StringType()),
])

BILLING_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("payload", T.StringType()),
])


def ingest_stream(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int = 1,
                  fmt: str = "parquet", start_at=None) -> DataFrame:
    """Streaming source over landed files; ``max_files_per_trigger`` is the
    batch size.  Block streams start at the beginning.  A consumer that must
    start "now" passes ``start_at``, a fixed timestamp (keep it over
    restarts): files landed before it are listed but none of their rows pass."""
    df = (spark.readStream.format(fmt).schema(schema)
          .option("maxFilesPerTrigger", max_files_per_trigger).load(path))
    if start_at is None:
        return df
    return df.where(F.col("_metadata.file_modification_time") >= F.lit(start_at))


def dedupe_stream(arrivals: DataFrame, delay: str) -> DataFrame:
    """Drop redelivered blocks: one row per (chain, height) seen within the
    watermark ``delay`` of event time (must cover how late a copy can come)."""
    return (arrivals.withColumn("event_ts", F.col("ts").cast("timestamp"))
            .withWatermark("event_ts", delay)
            .dropDuplicatesWithinWatermark(["chain_id", "block_height"]))


HEIGHT_SPAN = 1 << 20  # heights of one state row; a hot chain spreads over its spans


def _add(starts: np.ndarray, ends: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, non-touching ranges [start, end] with ``heights`` (ascending, none inside) added."""
    s, e = np.concatenate((starts, heights)), np.concatenate((ends, heights))
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    first = np.concatenate(([True], s[1:] > e[:-1] + 1))  # the ranges are disjoint: only neighbours can touch
    last = np.concatenate((first[1:], [True]))
    return s[first], e[last]


def dedupe_stream_exact(arrivals: DataFrame, span: int = HEIGHT_SPAN) -> DataFrame:
    """Drop every redelivered block, however late: one row per (chain, height).

    The state of a chain's span of heights is the set of heights seen, as
    merged ranges, so it grows with the gaps and not with the blocks; no
    watermark and no time-out.  Rows without a chain or a height are left out.
    """
    out = T.StructType([*arrivals.schema.fields])
    names = out.fieldNames()

    def run(key, frames, state):
        starts, ends = (np.array(x, np.int64) for x in (state.get if state.exists else ([], [])))
        for frame in frames:
            frame = frame.drop_duplicates("block_height", keep="first")
            heights = frame["block_height"].to_numpy(np.int64)
            at = np.searchsorted(starts, heights, "right") - 1
            seen = (at >= 0) & (heights <= np.concatenate((ends, [0]))[at])
            if not seen.all():
                starts, ends = _add(starts, ends, np.sort(heights[~seen]))
                yield frame.loc[~seen, names]
        state.update((starts.tolist(), ends.tolist()))

    known = arrivals.where(F.col("chain_id").isNotNull() & F.col("block_height").isNotNull())
    return (known.withColumn("_span", F.floor(F.col("block_height") / span))
            .groupBy("chain_id", "_span")
            .applyInPandasWithState(run, out, "starts array<bigint>, ends array<bigint>", "append", "NoTimeout"))


def run_available_now(stream: DataFrame, batch_fn, checkpoint: str) -> None:
    """Process everything available, in micro-batches, then stop."""
    q = (stream.writeStream.foreachBatch(batch_fn)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def route_blocks_batch(store: BlockTable, heads_path: str, cursors_path: str | None = None,
                       ready_path: str | None = None, normalize=None, fold_every: int = 50):
    """``foreachBatch`` body of the block router: (normalise,) put blocks,
    record the batch head, and -- when a cursor table is given -- write the
    jobs that became due under the new heads (one snapshot per batch).

    Every ``fold_every`` batches the head snapshots become one, and ready
    snapshots but those of the last two batches, whose jobs they list anew, are dropped."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        if normalize is None:
            return route(batch, batch_id)
        spark, path = batch.sparkSession, fresh_path(batch.sparkSession, "batch")
        rows = normalize(batch)
        try:
            with shuffle_files_dropped(spark):
                rows.write.option("compression", CODEC).parquet(path)  # read several times, parsed once
                route(spark.read.schema(rows.schema).parquet(path), batch_id)
        finally:
            snapshots.drop(spark, path)

    def route(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        store.put(rows, "first")
        span = (rows.groupBy("chain_id").agg(F.max("block_height").alias("head"), F.min("block_height").alias("low"))
                .withColumn("batch_id", F.lit(batch_id).cast("bigint")))
        (span.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(heads_path))
        if cursors_path and ready_path:
            from chainlake.operators.delivery import due_jobs
            from chainlake.streaming.rounds import current_cursors
            ready = (due_jobs(current_cursors(spark, cursors_path), current_heads(spark, heads_path))
                     .where(F.col("state") == "ready")
                     .select("webhook_id", "chain_id", "next_height", "is_new",
                             F.lit(batch_id).cast("bigint").alias("batch_id")))
            (ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(ready_path))
        if batch_id and batch_id % fold_every == 0:
            snapshots.fold(spark, heads_path, batch_id, _bounds_of)
            if ready_path:
                snapshots.drop_before(spark, ready_path, batch_id - 1)

    return handle


def _bounds_of(spans: DataFrame) -> DataFrame:
    return spans.groupBy("chain_id").agg(F.max("head").alias("head"), F.min("low").alias("low"))


def current_heads(spark: SparkSession, heads_path: str) -> DataFrame:
    """Monotone chain heads: max over all batch snapshots."""
    return spark.read.parquet(heads_path).groupBy("chain_id").agg(F.max("head").alias("head"))


def _write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """One partition per batch id, overwritten when the batch is replayed."""
    (df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def current_bounds(spark: SparkSession, heads_path: str) -> DataFrame:
    """``(chain_id, head, low)`` as the relay needs them, over all batch snapshots."""
    return _bounds_of(spark.read.parquet(heads_path))


def consume_billing_batch(subscriptions, out_path: str, signals_path: str | None = None,
                          deletions_path: str | None = None):
    """``foreachBatch`` body of the billing consumer: every event gets an
    outcome row (errors included) -- all of them are acknowledged.

    ``subscriptions`` is a DataFrame or a function that reads them anew for
    each batch.  The side effects are rows too: ``signals_path`` receives
    the cache invalidations of ``entitlement_signals``, ``deletions_path`` the
    users whose checkout session is to be removed (``customer_id``)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        subs = subscriptions() if callable(subscriptions) else subscriptions
        out = bl.event_outcomes(batch, subs)
        _write_batch(out, batch_id, out_path)
        schema = T.StructType([*out.schema.fields, T.StructField("batch_id", T.LongType())])
        done = (batch.sparkSession.read.schema(schema).parquet(out_path).where((F.col("batch_id") == batch_id) & (F.col("status") == "ok")
                                                   & F.col("user_id").isNotNull()))
        if signals_path:
            _write_batch(done.where(F.col("action").isin("invalidate", "delete_sessions"))
                         .select("user_id", "ts", F.lit("invalidate").alias("kind")), batch_id, signals_path)
        if deletions_path:
            _write_batch(done.where(F.col("action") == "delete_sessions")
                         .select(F.col("user_id").alias("customer_id")).distinct(), batch_id, deletions_path)

    return handle


def land_files(df: DataFrame, path: str, n_files: int) -> None:
    """Write a DataFrame as ``n_files`` files (a landing folder for a stream)."""
    df.repartition(n_files).write.mode("append").parquet(path)


def stream_dir(base: str, name: str) -> str:
    return os.path.join(base, name)


def flush_tick(hot: BlockTable, cold: BlockTable, threshold: int, compact: bool = False) -> int:
    """One flush: copy the earliest ``threshold`` hot blocks of every chain
    that has that many into cold (idempotent put), then hide them in hot
    with tombstones.  Nothing is overwritten: a failure between the two
    steps leaves the blocks in both tiers, which tiered reads resolve by
    preferring hot, and the next tick finishes the move."""
    ensure_checkpoint_dir(hot.spark)
    moved = st.flush_plan(hot.read(), threshold).drop("rank").checkpoint(eager=True)
    n = moved.count()
    if n == 0:
        return 0
    cold.put(moved, "first")
    hot.delete(moved)
    if compact:
        hot.compact()
    return n


SIGNAL_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("kind", T.StringType()),   # 'fill' (read-through) or 'invalidate' (billing event)
])


def entitlement_signals(stream: DataFrame) -> DataFrame:
    """Keyed streaming state of the cached entitlement: per user the latest
    fill and the latest invalidation (a streaming aggregation: the state
    store keeps two timestamps per user, nothing else)."""
    return (stream.groupBy("user_id")
            .agg(F.max(F.when(F.col("kind") == "fill", F.col("ts"))).alias("last_fill"),
                 F.max(F.when(F.col("kind") == "invalidate", F.col("ts"))).alias("last_invalidation")))


def entitlement_state_batch(out_path: str, fold_every: int = 50):
    """``foreachBatch`` body: users whose state changed in this batch, keyed
    by batch id (the newest row per user is the current state).  Every
    ``fold_every`` batches the earlier snapshots become one row per user."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, batch_id, out_path)
        if batch_id and batch_id % fold_every == 0:
            snapshots.fold(batch.sparkSession, out_path, batch_id, _latest_signals)

    return handle


def _latest_signals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.max("last_fill").alias("last_fill"),
                                       F.max("last_invalidation").alias("last_invalidation"))


def current_signals(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, last_fill, last_invalidation) over all snapshots; both times only move forward."""
    return _latest_signals(spark.read.parquet(path))


def run_available_now_update(stream: DataFrame, batch_fn, checkpoint: str) -> None:
    q = (stream.writeStream.outputMode("update").foreachBatch(batch_fn)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def flush_stream(spark: SparkSession, hot: BlockTable, cold: BlockTable, threshold: int,
                 interval: str, checkpoint: str, compact_every: int = 10):
    """Run ``flush_tick`` on a ``processingTime`` trigger (a rate source only
    paces it); every ``compact_every``-th tick also compacts the hot tier.  Spark never overlaps micro-batches, so the next flush starts
    a full interval after the previous one finished its work."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (ticks.writeStream.trigger(processingTime=interval)
            .foreachBatch(lambda _df, bid: flush_tick(hot, cold, threshold,
                                                      compact=(bid % compact_every == compact_every - 1)))
            .option("checkpointLocation", checkpoint).start())


def write_messages(messages: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append stream messages ``(chain_id, msg_id, data)`` as JSON lines."""
    w = (messages.writeStream.format("json").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint))
    return w.trigger(availableNow=True).start() if available_now else w.start()


def send_outbox(outbox: DataFrame, send) -> None:
    """Hand every outbox row to ``send(rows)`` per partition, on the
    executors.  ``send`` is the pluggable delivery client (an HTTP POST in
    production); rows carry ``(webhook_id, first_height, batch_id)`` so a
    receiver can drop a resend after a retried task."""
    outbox.foreachPartition(send)


def ordered_sender(send_one):
    """A ``send`` for delivery rounds that keeps the order of each webhook.

    The requests are dealt by shard and webhook, so that a hot shard spreads
    over as many tasks as it has webhooks, and sorted by ``seq`` inside a
    task: a webhook gets one request at a time and nothing behind its first
    failure, which later rounds ask again.  ``send_one(row) -> bool`` delivers
    one outbox row (a dict) on an executor; an exception in it (a transport
    error) is a failure.  A task that Spark runs again sends again: rows carry
    ``(webhook_id, first_height)`` for the receiver to recognise repeats.
    """
    def run(batches):
        stopped = None
        for batch in batches:
            out = {"webhook_id": [], "seq": [], "delivered": []}
            for row in batch.to_pylist():
                if row["webhook_id"] == stopped:
                    continue
                try:
                    delivered = bool(send_one(row))
                except Exception:  # noqa: BLE001  whatever the client raises, the request was not delivered
                    delivered = False
                if not delivered:
                    stopped = row["webhook_id"]
                out["webhook_id"].append(row["webhook_id"])
                out["seq"].append(row["seq"])
                out["delivered"].append(delivered)
            yield pa.RecordBatch.from_pydict(out, schema=_ANSWER)

    def send(outbox: DataFrame) -> DataFrame:
        keys = [c for c in ("shard_id", "webhook_id") if c in outbox.columns]
        return (outbox.repartition(*keys).sortWithinPartitions("webhook_id", "seq")
                .mapInArrow(run, "webhook_id string, seq int, delivered boolean"))

    return send


_ANSWER = pa.schema([("webhook_id", pa.string()), ("seq", pa.int32()), ("delivered", pa.bool_())])
