"""Streaming and storage queries (§2.1 sinks/sources, §2.9): each runs a real
micro-batch pipeline (``availableNow``) or a real table write over data
derived from the driver tables, then returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chainlake import fixtures as fx
from chainlake.fixtures import SQL_VIEWS
from chainlake.operators import billing as bl
from chainlake.operators import delivery as dv
from chainlake.operators import store as st
from chainlake.plans.catalog import query
from chainlake.plans.q_billing import NOW, TTL_SECONDS
from chainlake.plans.q_delivery import _PLAN_SQL
from chainlake.plans.q_quality import REPLAY_OFFSET
from chainlake.session import shuffle_files_dropped
from chainlake.sources.store_io import BlockTable, fresh_path, tiered_latest, write_blocks_partitioned
from chainlake.streaming import admission, timers
from chainlake.streaming import runners as sp

OUT = ["chain_id", "block_height", "block"]


def _arrival_files(spark, sf_dir, base):
    """Land originals first, then the replayed hot tier, as separate files."""
    cols = [f.name for f in sp.ARRIVAL_SCHEMA.fields]
    b = fx.blocks(spark, sf_dir).select(*cols)
    replay = (fx.hot_tier(spark, sf_dir).select(*cols)
              .withColumn("seq", F.col("seq") + F.lit(REPLAY_OFFSET))
              .withColumn("block", F.expr("regexp_replace(block, '}$', ',\"v\":2}')")))
    src = f"{base}/src"
    sp.land_files(b, src, 4)
    sp.land_files(replay, src, 2)
    return src


@query("ingest_stream", "SELECT chain_id, block_height, block FROM block", ("block",))
def q_ingest_stream(spark, sf_dir):
    base = fresh_path(spark, "ingest")
    cols = [f.name for f in sp.ARRIVAL_SCHEMA.fields]
    src = f"{base}/src"
    sp.land_files(fx.blocks(spark, sf_dir).select(*cols), src, 4)
    sink = f"{base}/sink"
    stream = sp.ingest_stream(spark, src, sp.ARRIVAL_SCHEMA, max_files_per_trigger=1)
    sp.run_available_now(stream, lambda df, bid: df.write.mode("append").parquet(sink), f"{base}/ckpt")
    return spark.read.parquet(sink).select(*OUT)


@query("route_blocks", "SELECT chain_id, block_height, block FROM block", ("block",))
def q_route_blocks(spark, sf_dir):
    base = fresh_path(spark, "route")
    src = _arrival_files(spark, sf_dir, base)
    store = BlockTable(spark, f"{base}/store").init()
    stream = sp.ingest_stream(spark, src, sp.ARRIVAL_SCHEMA, max_files_per_trigger=2)
    sp.run_available_now(stream, sp.route_blocks_batch(store, f"{base}/heads"), f"{base}/ckpt")
    return store.read().select(*OUT)


@query("route_blocks_heads", "SELECT chain_id, head FROM chain_head", ("chain_head",))
def q_route_blocks_heads(spark, sf_dir):
    base = fresh_path(spark, "route-heads")
    src = _arrival_files(spark, sf_dir, base)
    store = BlockTable(spark, f"{base}/store").init()
    stream = sp.ingest_stream(spark, src, sp.ARRIVAL_SCHEMA, max_files_per_trigger=2)
    sp.run_available_now(stream, sp.route_blocks_batch(store, f"{base}/heads"), f"{base}/ckpt")
    return sp.current_heads(spark, f"{base}/heads")


@query("dedupe_stream", "SELECT chain_id, block_height, block FROM block", ("block",))
def q_dedupe_stream(spark, sf_dir):
    base = fresh_path(spark, "dedupe")
    src = _arrival_files(spark, sf_dir, base)
    sink = f"{base}/sink"
    stream = sp.dedupe_stream_exact(sp.ingest_stream(spark, src, sp.ARRIVAL_SCHEMA, max_files_per_trigger=2))
    sp.run_available_now(stream, lambda df, bid: df.write.mode("append").parquet(sink), f"{base}/ckpt")
    return spark.read.parquet(sink).select(*OUT)


@query("consume_billing_stream", "SELECT *, CAST(NULL AS BIGINT) AS batch_id FROM billing_outcome",
       ("billing_outcome",))
def q_consume_billing_stream(spark, sf_dir):
    base = fresh_path(spark, "billing")
    src = f"{base}/src"
    sp.land_files(fx.billing_events(spark, sf_dir), src, 4)
    subs = bl.subscriptions_from_sessions(fx.sessions(spark, sf_dir))
    stream = sp.ingest_stream(spark, src, sp.BILLING_SCHEMA, max_files_per_trigger=1)
    out = f"{base}/outcomes"
    sp.run_available_now(stream, sp.consume_billing_batch(subs, out), f"{base}/ckpt")
    # batch ids depend on file grouping, not on data: reported as null
    return spark.read.parquet(out).withColumn("batch_id", F.lit(None).cast("bigint"))


@query("init_store", "SELECT chain_id, count(*) AS n_blocks FROM block GROUP BY chain_id", ("block",))
def q_init_store(spark, sf_dir):
    t = BlockTable(spark, fresh_path(spark, "store"))
    t.init()
    t.init()  # idempotent
    b = fx.blocks(spark, sf_dir)
    t.put(b)
    t.put(b)  # idempotent
    return st.store_counts(t.read())


@query("write_blocks_partitioned", """
    SELECT b.chain_id, b.block_height, b.block FROM block b JOIN chain_head h USING (chain_id)
    WHERE b.block_height BETWEEN h.head // 2 - 50 AND h.head // 2 + 49""", ("block", "chain_head"))
def q_write_blocks_partitioned(spark, sf_dir):
    path = fresh_path(spark, "blocks")
    write_blocks_partitioned(fx.blocks(spark, sf_dir), path)
    t = BlockTable(spark, path)
    ranges = fx.chain_heads(spark, sf_dir).select(
        "chain_id", F.expr("head div 2 - 50").alias("start_height"), F.expr("head div 2 + 49").alias("end_height"))
    return st.get_block_ranges(t.read(), ranges).select(*OUT)


def _stored_tiers(spark, sf_dir):
    """Hot and cold tables; every 7th cold height and the hot head of each chain are deleted again."""
    base = fresh_path(spark, "zones")
    hot, cold = BlockTable(spark, f"{base}/hot"), BlockTable(spark, f"{base}/cold")
    cold.put(fx.cold_tier(spark, sf_dir))
    hot.put(fx.hot_tier(spark, sf_dir))
    cold.delete(cold.read().where(F.col("block_height") % 7 == 0))
    hot.delete(hot.read().join(fx.chain_heads(spark, sf_dir).selectExpr("chain_id", "head AS block_height"),
                               ["chain_id", "block_height"], "left_semi"))
    return hot, cold


SQL_VIEWS["kept_hot"] = (("hot", "chain_head"), """
    SELECT h.* FROM hot h JOIN chain_head c USING (chain_id) WHERE h.block_height <> c.head""")
SQL_VIEWS["kept_cold"] = (("cold",), "SELECT * FROM cold WHERE block_height % 7 <> 0")


@query("zone_latest_blocks", """
    SELECT chain_id, block_height, block FROM kept_cold
    QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY block_height DESC) <= 25""", ("kept_cold",))
def q_zone_latest_blocks(spark, sf_dir):
    """Latest 25 of every chain of a stored table, read from the newest partitions that its zones name."""
    return _stored_tiers(spark, sf_dir)[1].latest(25).select(*OUT)


@query("zone_tiered_latest", """
    SELECT chain_id, block_height, block FROM (
      SELECT chain_id, block_height, block FROM kept_hot UNION ALL
      SELECT chain_id, block_height, block FROM kept_cold c WHERE NOT EXISTS (
        SELECT 1 FROM kept_hot h WHERE h.chain_id = c.chain_id AND h.block_height = c.block_height))
    QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY block_height DESC) <= 10""", ("kept_hot", "kept_cold"))
def q_zone_tiered_latest(spark, sf_dir):
    """Latest 10 over both stored tiers, and so resume points and heads, without a full scan."""
    return tiered_latest(*_stored_tiers(spark, sf_dir), 10).select(*OUT)


@query("zone_resume_height", "SELECT chain_id, max(block_height) AS start_height FROM kept_hot GROUP BY chain_id", ("kept_hot",))
def q_zone_resume_height(spark, sf_dir):
    return _stored_tiers(spark, sf_dir)[0].heads().withColumnRenamed("head", "start_height")


@query("flush_tick", """
    WITH moved AS (
      SELECT chain_id, block_height, block FROM (
        SELECT chain_id, block_height, block,
               row_number() OVER (PARTITION BY chain_id ORDER BY block_height) AS rn,
               count(*) OVER (PARTITION BY chain_id) AS n
        FROM hot) WHERE rn <= 100 AND n >= 100)
    SELECT chain_id, block_height, block, 'hot' AS tier FROM hot h
    WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.chain_id = h.chain_id AND m.block_height = h.block_height)
    UNION ALL
    SELECT chain_id, block_height, block, 'cold' FROM cold
    UNION ALL
    SELECT chain_id, block_height, block, 'cold' FROM moved m
    WHERE NOT EXISTS (SELECT 1 FROM cold c WHERE m.chain_id = c.chain_id AND m.block_height = c.block_height)""",
       ("hot", "cold"))
def q_flush_tick(spark, sf_dir):
    base = fresh_path(spark, "tiers")
    hot = BlockTable(spark, f"{base}/hot")
    cold = BlockTable(spark, f"{base}/cold")
    hot.put(fx.hot_tier(spark, sf_dir))
    cold.put(fx.cold_tier(spark, sf_dir))
    sp.flush_tick(hot, cold, 100)
    return (hot.read().select(*OUT).withColumn("tier", F.lit("hot"))
            .unionByName(cold.read().select(*OUT).withColumn("tier", F.lit("cold"))))


@query("read_backlog", """
    SELECT a.webhook_id, a.msg_id, count(*) AS delivery_count, max(a.ts) AS last_delivery
    FROM attempt a WHERE NOT EXISTS (
      SELECT 1 FROM attempt k WHERE NOT k.failed AND k.webhook_id = a.webhook_id AND k.msg_id = a.msg_id)
    GROUP BY a.webhook_id, a.msg_id""", ("attempt",))
def q_read_backlog(spark, sf_dir):
    # backlog is read before new messages, oldest message id first
    return dv.pending_entries(fx.attempts(spark, sf_dir)).orderBy("webhook_id", "msg_id")


@query("delivery_rounds", f"""
    SELECT webhook_id, CAST(request_no AS BIGINT) AS round_id, first_height, last_height, n_blocks
    FROM ({_PLAN_SQL.format(cursor="first_lo + 1")}) p WHERE request_no < 3""", ("job", "webhook", "block", "chain_head"))
def q_delivery_rounds(spark, sf_dir):
    """Three relay rounds over every due job equal the first three requests
    of the closed-form plan."""
    from chainlake.streaming import rounds as rd
    base = fresh_path(spark, "rounds")
    rd.init_cursors(fx.jobs(spark, sf_dir), f"{base}/cursors")
    rd.run_rounds(spark, 3, f"{base}/cursors", f"{base}/outbox", fx.webhooks(spark, sf_dir),
                  fx.blocks(spark, sf_dir), fx.chain_heads(spark, sf_dir))
    return spark.read.parquet(f"{base}/outbox").select("webhook_id", F.col("round_id").cast("bigint").alias("round_id"),
                                                       "first_height", "last_height", "n_blocks")


@query("delivery_rounds_feedback", f"""
    WITH p AS (SELECT p.*, CAST(p.webhook_id AS BIGINT) % 3 = 0 AS fails, w.max_retries
               FROM ({_PLAN_SQL.format(cursor="first_lo + 1")}) p JOIN webhook w ON w.id = p.webhook_id)
    SELECT webhook_id, CAST(request_no AS BIGINT) AS round_id, first_height, last_height, n_blocks
    FROM p WHERE request_no < 2 AND NOT fails
    UNION ALL
    SELECT webhook_id, r.i, first_height, last_height, n_blocks FROM p, range(2) r(i)
    WHERE request_no = 0 AND fails AND (r.i = 0 OR max_retries > 2)""", ("job", "webhook", "block", "chain_head"))
def q_delivery_rounds_feedback(spark, sf_dir):
    """Two rounds with a sender that fails for every third webhook: its
    cursor stays and the request is repeated, or skipped (no request in that
    round) once its attempts are used up."""
    from chainlake.streaming import rounds as rd
    base = fresh_path(spark, "feedback")
    rd.init_cursors(fx.jobs(spark, sf_dir), f"{base}/cursors")

    def send(outbox):
        return outbox.select("webhook_id", (F.pmod(F.col("webhook_id").cast("bigint"), F.lit(3)) != 0).alias("delivered"))

    rd.run_rounds(spark, 2, f"{base}/cursors", f"{base}/outbox", fx.webhooks(spark, sf_dir),
                  fx.blocks(spark, sf_dir), fx.chain_heads(spark, sf_dir), send=send)
    return spark.read.parquet(f"{base}/outbox").select("webhook_id", F.col("round_id").cast("bigint").alias("round_id"),
                                                       "first_height", "last_height", "n_blocks")


RELAY_WINDOW = 64  # ordered requests of a job in one round


def relay_until_idle(spark, jobs, webhooks, blocks, heads, compact_every=25, window=RELAY_WINDOW, send=None):
    """Rounds over ``jobs`` until nothing is due; the requests of all rounds
    in the order of each webhook.  The inputs are stored once, since every
    round reads them anew."""
    from chainlake.streaming import rounds as rd
    base = fresh_path(spark, "until-idle")

    def stored(df, name):
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    rd.init_cursors(jobs, f"{base}/cursors")
    rd.run_until_idle(spark, f"{base}/cursors", f"{base}/outbox", stored(webhooks, "webhooks"), stored(blocks, "blocks"),
                      stored(heads, "heads"), compact_every=compact_every, window=window, send=send)
    sent = spark.read.parquet(f"{base}/outbox").select("webhook_id", "round_id", "seq", "first_height", "last_height", "n_blocks")
    order = Window.partitionBy("webhook_id").orderBy("round_id", "seq")
    return sent.select("webhook_id", (F.row_number().over(order) - 1).cast("bigint").alias("round_id"),
                       "first_height", "last_height", "n_blocks")


@query("delivery_rounds_until_idle", f"""
    SELECT webhook_id, CAST(request_no AS BIGINT) AS round_id, first_height, last_height, n_blocks
    FROM ({_PLAN_SQL.format(cursor="first_lo + 1")}) p""", ("job", "webhook", "block", "chain_head"))
def q_delivery_rounds_until_idle(spark, sf_dir):
    """The relay loop until nothing is due equals the whole closed-form plan:
    ``round_id`` is the place of a request among those of its webhook."""
    return relay_until_idle(spark, fx.jobs(spark, sf_dir), fx.webhooks(spark, sf_dir), fx.blocks(spark, sf_dir),
                            fx.chain_heads(spark, sf_dir))


@query("entitlement_state_stream", f"""
    WITH f AS (SELECT CAST(user_id AS VARCHAR) AS user_id, max(ts) AS last_fill FROM events
               WHERE event_type = 'click' GROUP BY 1),
    i AS (SELECT user_id, max(ts) AS last_invalidation FROM billing_outcome
          WHERE action = 'invalidate' AND user_id IS NOT NULL AND error IS NULL GROUP BY user_id)
    SELECT f.user_id, f.last_fill, i.last_invalidation,
           CASE WHEN i.last_invalidation >= f.last_fill THEN 'invalidated'
                WHEN f.last_fill + INTERVAL {TTL_SECONDS} SECOND <= TIMESTAMP '{NOW}' THEN 'expired'
                ELSE 'cached' END AS state
    FROM f LEFT JOIN i USING (user_id)""", ("billing_outcome",))
def q_entitlement_state_stream(spark, sf_dir):
    """Fills and invalidations arrive as a stream; the keyed state is kept
    by a streaming aggregation and read back as the newest row per user."""
    base = fresh_path(spark, "entitlement")
    e = fx.table(spark, sf_dir, "events")
    fills = e.where(F.col("event_type") == "click").select(F.col("user_id").cast("string").alias("user_id"), "ts",
                                                           F.lit("fill").alias("kind"))
    outcomes = bl.event_outcomes(fx.billing_events(spark, sf_dir),
                                 bl.subscriptions_from_sessions(fx.sessions(spark, sf_dir)))
    inv = (outcomes.where((F.col("action") == "invalidate") & F.col("user_id").isNotNull() & F.col("error").isNull())
           .select("user_id", "ts", F.lit("invalidate").alias("kind")))
    src = f"{base}/src"
    sp.land_files(fills.unionByName(inv), src, 4)
    stream = sp.entitlement_signals(sp.ingest_stream(spark, src, sp.SIGNAL_SCHEMA, max_files_per_trigger=1))
    sp.run_available_now_update(stream, sp.entitlement_state_batch(f"{base}/state"), f"{base}/ckpt")
    rows = spark.read.parquet(f"{base}/state")
    latest = (rows.groupBy("user_id")
              .agg(F.max_by(F.struct("last_fill", "last_invalidation"), "batch_id").alias("s"))
              .select("user_id", "s.*").where(F.col("last_fill").isNotNull()))
    ttl_end = F.col("last_fill") + F.expr(f"INTERVAL {TTL_SECONDS} SECONDS")
    state = (F.when(F.col("last_invalidation") >= F.col("last_fill"), "invalidated")
              .when(ttl_end <= F.lit(NOW).cast("timestamp_ntz"), "expired").otherwise("cached"))
    return latest.select("user_id", "last_fill", "last_invalidation", state.alias("state"))


@query("route_blocks_due", """
    SELECT j.webhook_id, j.chain_id, j.next_height, j.is_new FROM job j JOIN chain_head h USING (chain_id)
    WHERE j.next_height < h.head""", ("job", "chain_head"))
def q_route_blocks_due(spark, sf_dir):
    """The router's last batch lists every job that is due under the final heads."""
    from chainlake.streaming import rounds as rd
    base = fresh_path(spark, "route-due")
    src = _arrival_files(spark, sf_dir, base)
    store = BlockTable(spark, f"{base}/store").init()
    rd.init_cursors(fx.jobs(spark, sf_dir), f"{base}/cursors")
    stream = sp.ingest_stream(spark, src, sp.ARRIVAL_SCHEMA, max_files_per_trigger=2)
    handle = sp.route_blocks_batch(store, f"{base}/heads", f"{base}/cursors", f"{base}/ready")
    sp.run_available_now(stream, handle, f"{base}/ckpt")
    ready = spark.read.parquet(f"{base}/ready")
    last = ready.agg(F.max("batch_id").alias("batch_id"))
    return ready.join(F.broadcast(last), "batch_id").select("webhook_id", "chain_id", "next_height", "is_new")


EVM_RAW_SCHEMA = "chain_id string, seq bigint, raw string"
EVM_FILE_ROWS = 50_000  # payloads in a landed file, at most; a compressed file is read by one task
EVM_BATCH_FILES = 64    # landed files in a micro-batch, at most: its shuffles and scratch rows bound the disk it takes


def land_payloads(raw, n_rows, path):
    """Land ``n_rows`` payloads as compressed JSON lines, as they come, in four files at least (if there are four rows).
    Returns the files of a micro-batch: half of them, and never more than ``EVM_BATCH_FILES``."""
    spark, per_file = raw.sparkSession, max(1, min(EVM_FILE_ROWS, -(-n_rows // 4)))
    with shuffle_files_dropped(spark):
        raw.write.mode("append").option("maxRecordsPerFile", per_file).option("compression", "gzip").json(path)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    landed = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    n_files = sum(f.getPath().getName().startswith("part-") for f in landed)
    return max(1, min(EVM_BATCH_FILES, -(-n_files // 2)))


@query("ingest_evm_stream", "SELECT chain_id, block_height, block FROM evm_block", ("evm_block",))
def q_ingest_evm_stream(spark, sf_dir):
    """Raw node payloads land as JSON lines; the stream normalises them and
    stores blocks idempotently (the forwarder + router path)."""
    from chainlake.sources import payloads as pl
    base = fresh_path(spark, "evm")
    src = f"{base}/src"
    files = land_payloads(fx.raw_evm(spark, sf_dir), fx.table(spark, sf_dir, "orders").count(), src)
    store = BlockTable(spark, f"{base}/store").init()
    stream = sp.ingest_stream(spark, src, T.StructType.fromDDL(EVM_RAW_SCHEMA), max_files_per_trigger=files, fmt="json")
    norm = lambda df: pl.normalize_evm_blocks(df).select("chain_id", "block_height", "block", F.col("block_height").alias("seq"))
    sp.run_available_now(stream, sp.route_blocks_batch(store, f"{base}/heads", normalize=norm), f"{base}/ckpt")
    return store.read().select(*OUT)


@query("block_source_stream", "SELECT chain_id, block_height, block FROM block", ("block",))
def q_block_source_stream(spark, sf_dir):
    """Landed block files as a stream into the store.  The heights from
    500 land first and are read; the lower ones land late, with some repeats."""
    from chainlake.sources.block_source import landed_blocks
    base = fresh_path(spark, "source")
    store = BlockTable(spark, f"{base}/store").init()
    blocks = fx.blocks(spark, sf_dir).select(*OUT)
    late = F.col("block_height") < 500
    for part in (blocks.where(~late), blocks.where(late | (F.col("block_height") < 600))):
        part.write.mode("append").partitionBy("chain_id").parquet(f"{base}/landed")
        sp.run_available_now(landed_blocks(spark, f"{base}/landed"), lambda df, bid: store.put(df, "first"), f"{base}/ckpt")
    return store.read().select(*OUT)


@query("append_message_stream", """
    SELECT chain_id, seq AS msg_id, CAST(to_json({'Height': block_height, 'Block': block}) AS VARCHAR) AS data
    FROM block""", ("block",))
def q_append_message_stream(spark, sf_dir):
    """Blocks flow through a stream and are appended as JSON messages."""
    from chainlake.sources import payloads as pl
    base = fresh_path(spark, "messages")
    cols = [f.name for f in sp.ARRIVAL_SCHEMA.fields]
    sp.land_files(fx.blocks(spark, sf_dir).select(*cols), f"{base}/src", 4)
    stream = pl.append_message(sp.ingest_stream(spark, f"{base}/src", sp.ARRIVAL_SCHEMA, 2))
    sp.write_messages(stream, f"{base}/out", f"{base}/ckpt").awaitTermination()
    return spark.read.schema("chain_id string, msg_id bigint, data string").json(f"{base}/out")


@query("ingest_stream_bounded", "SELECT chain_id, block_height, block FROM block", ("block",))
def q_ingest_stream_bounded(spark, sf_dir):
    """All blocks through batches of a twelfth of the messages, cut inside files and over them."""
    base = fresh_path(spark, "bounded")
    cols = [f.name for f in sp.ARRIVAL_SCHEMA.fields]
    sp.land_files(fx.blocks(spark, sf_dir).select(*cols), f"{base}/src", 4)
    stream = admission.landed_messages(spark, f"{base}/src", sp.ARRIVAL_SCHEMA, max_files_per_trigger=3)
    size = fx.blocks(spark, sf_dir).count() // 12 + 1
    put = admission.bounded_batches(lambda df, n: df.write.mode("append").parquet(f"{base}/sink"), size, f"{base}/log")
    sp.run_available_now(stream, put, f"{base}/ckpt")
    return spark.read.parquet(f"{base}/sink").select(*OUT)


SLICE_DAYS, LATE = 6, "12 days"


def _land_in_time(df, path, id_col, ticks_at):
    """Rows land in slices of six days, every tenth one a slice late; two ticks move the clock at the end."""
    day = F.datediff(F.col("ts"), F.lit("2024-01-01"))
    at = F.floor(day / SLICE_DAYS) + F.when(F.pmod(F.xxhash64(id_col), F.lit(10)) == 0, 1).otherwise(0)
    df.withColumn("_slice", at).write.partitionBy("_slice").parquet(f"{path}-cut")  # made once, not for every slice
    cut = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_slice", T.LongType())])).parquet(f"{path}-cut")
    for k in range(6):
        sp.land_files(cut.where(F.col("_slice") == k).drop("_slice"), path, 1)
    for _ in range(2):  # the watermark of one batch counts in the next
        timers.clock_tick(df, F.lit(ticks_at)).write.mode("append").parquet(path)


WAIT_MS, MAX_WAIT_MS = 3_600_000, 3 * 86_400_000
SQL_VIEWS["redelivery"] = (("attempt", "webhook"), f"""
    WITH e AS (
      SELECT a.webhook_id, a.msg_id, a.attempt_id, a.ts, a.failed, greatest(1, w.max_retries - 1) AS allowed,
             count(*) FILTER (NOT a.failed) OVER m AS successes, lead(a.ts) OVER m AS next_ts
      FROM attempt a JOIN webhook w ON w.id = a.webhook_id
      WINDOW m AS (PARTITION BY a.webhook_id, a.msg_id ORDER BY a.ts, a.attempt_id)),
    f AS (SELECT *, (row_number() OVER (PARTITION BY webhook_id, msg_id, successes ORDER BY ts, attempt_id) - 1)
                    % allowed + 1 AS n FROM e WHERE failed)
    SELECT webhook_id, msg_id, CASE WHEN n = allowed THEN 'skip' ELSE 'redeliver' END AS kind,
           CAST(n AS INTEGER) AS attempt,
           CASE WHEN n = allowed THEN ts
                ELSE ts + to_milliseconds(CASE n WHEN 1 THEN {WAIT_MS} ELSE {MAX_WAIT_MS} END) END AS due_at,
           next_ts
    FROM f""")


@query("redelivery_stream", """
    SELECT webhook_id, msg_id, kind, attempt, due_at FROM redelivery
    WHERE kind = 'skip' OR next_ts IS NULL OR due_at < next_ts""", ("redelivery",))
def q_redelivery_stream(spark, sf_dir):
    """Failed messages come back when their backoff has passed and nothing else happened before:
    keyed state with event-time timers equals a replay in SQL, though attempts arrive late."""
    base = fresh_path(spark, "redelivery")
    events = fx.attempts(spark, sf_dir).select("webhook_id", "msg_id", "attempt_id", "ts", "failed",
                                               F.lit("attempt").alias("kind"))
    _land_in_time(events, f"{base}/src", "attempt_id", "2024-04-01")
    waits = timers.waits_of(fx.webhooks(spark, sf_dir), WAIT_MS, 1, MAX_WAIT_MS)
    stream = sp.ingest_stream(spark, f"{base}/src", T.StructType.fromDDL(timers.EVENT), max_files_per_trigger=1)
    sp.run_available_now(timers.redelivery_stream(stream, waits, LATE),
                         lambda df, bid: df.write.mode("append").parquet(f"{base}/out"), f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")


@query("entitlement_ttl_stream", f"""
    WITH f AS (SELECT CAST(user_id AS VARCHAR) AS user_id, max(ts) AS last_fill FROM events
               WHERE event_type = 'click' GROUP BY 1),
    i AS (SELECT f.user_id, min(b.ts) AS ended FROM f JOIN billing_outcome b ON b.user_id = f.user_id
          AND b.action = 'invalidate' AND b.error IS NULL AND b.ts >= f.last_fill
          AND b.ts < f.last_fill + INTERVAL {TTL_SECONDS} SECOND GROUP BY f.user_id),
    s AS (SELECT f.user_id, f.last_fill, i.ended, f.last_fill + INTERVAL {TTL_SECONDS} SECOND AS ttl_end
          FROM f LEFT JOIN i USING (user_id))
    SELECT user_id, last_fill,
           CASE WHEN ended IS NOT NULL THEN 'invalidated'
                WHEN ttl_end <= TIMESTAMP '{NOW}' THEN 'expired' ELSE 'cached' END AS state,
           CASE WHEN ended IS NOT NULL THEN ended
                WHEN ttl_end <= TIMESTAMP '{NOW}' THEN ttl_end END AS ended_at
    FROM s""", ("billing_outcome",))
def q_entitlement_ttl_stream(spark, sf_dir):
    """Cached entitlements with expiry by event time: the state holds live users alone, rows arrive late."""
    base = fresh_path(spark, "entitlement-ttl")
    e = fx.table(spark, sf_dir, "events")
    fills = e.where(F.col("event_type") == "click").select(F.col("user_id").cast("string").alias("user_id"), "ts",
                                                           F.lit("fill").alias("kind"))
    outcomes = bl.event_outcomes(fx.billing_events(spark, sf_dir),
                                 bl.subscriptions_from_sessions(fx.sessions(spark, sf_dir)))
    drops = (outcomes.where((F.col("action") == "invalidate") & F.col("user_id").isNotNull() & F.col("error").isNull())
             .select("user_id", "ts", F.lit("invalidate").alias("kind")))
    # the watermark ends one millisecond behind NOW, so that what ends at NOW has ended
    _land_in_time(fills.unionByName(drops), f"{base}/src", "ts",
                  F.lit(NOW).cast("timestamp_ntz") + F.expr(f"INTERVAL {LATE} 1 MILLISECOND"))
    stream = sp.ingest_stream(spark, f"{base}/src", sp.SIGNAL_SCHEMA, max_files_per_trigger=1)
    changes = timers.entitlement_ttl_stream(stream, TTL_SECONDS, LATE)
    sp.run_available_now(changes, lambda df, bid: sp._write_batch(df, bid, f"{base}/out"), f"{base}/ckpt")
    return timers.current_entitlements(spark.read.parquet(f"{base}/out"))
