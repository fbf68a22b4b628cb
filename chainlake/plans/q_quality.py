"""Ordering, completeness and dedupe queries (§2.5) and stated-intent extras (§2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake import fixtures as fx
from chainlake.fixtures import SQL_VIEWS
from chainlake.operators import delivery as dv
from chainlake.operators import quality as qa
from chainlake.plans.catalog import query

REPLAY_OFFSET = 10**12  # replayed blocks arrive after every original block

SQL_VIEWS["arrival"] = (("block", "hot"), f"""
    SELECT chain_id, block_height, seq, block FROM block
    UNION ALL
    SELECT chain_id, block_height, seq + {REPLAY_OFFSET} AS seq, regexp_replace(block, '}}$', ',"v":2}}') AS block
    FROM hot""")


def arrivals(spark, sf_dir):
    """Block stream with the hot tier delivered a second time (newer payload)."""
    b = fx.blocks(spark, sf_dir).select("chain_id", "block_height", "seq", "block")
    replay = (fx.hot_tier(spark, sf_dir).select("chain_id", "block_height", "seq", "block")
              .withColumn("seq", F.col("seq") + F.lit(REPLAY_OFFSET))
              .withColumn("block", F.expr("regexp_replace(block, '}$', ',\"v\":2}')")))
    return b.unionByName(replay)


@query("check_ascending", """
    SELECT chain_id, seq, block_height, prev_height FROM (
      SELECT chain_id, seq, block_height, lag(block_height) OVER (PARTITION BY chain_id ORDER BY seq) AS prev_height
      FROM arrival) WHERE block_height <= prev_height""", ("arrival",))
def q_check_ascending(spark, sf_dir):
    return qa.check_ascending(arrivals(spark, sf_dir))


@query("height_gaps", """
    SELECT chain_id, block_height + 1 AS gap_start, next_height - 1 AS gap_end, next_height - block_height - 1 AS n_missing
    FROM (SELECT chain_id, block_height, lead(block_height) OVER (PARTITION BY chain_id ORDER BY block_height) AS next_height
          FROM received) WHERE next_height > block_height + 1""", ("received",))
def q_height_gaps(spark, sf_dir):
    received = fx.blocks(spark, sf_dir).where(~F.col("block").contains('"status":"P"'))
    return qa.height_gaps(received)


@query("dedupe_first", """
    SELECT chain_id, block_height, block, seq FROM (
      SELECT *, row_number() OVER (PARTITION BY chain_id, block_height ORDER BY seq) AS rn FROM arrival) WHERE rn = 1""",
       ("arrival",))
def q_dedupe_first(spark, sf_dir):
    return qa.dedupe_first(arrivals(spark, sf_dir))


@query("dedupe_last", """
    SELECT chain_id, block_height, block, seq FROM (
      SELECT *, row_number() OVER (PARTITION BY chain_id, block_height ORDER BY seq DESC) AS rn FROM arrival) WHERE rn = 1""",
       ("arrival",))
def q_dedupe_last(spark, sf_dir):
    return qa.dedupe_last(arrivals(spark, sf_dir))


# --- stated intent ------------------------------------------------------------------

@query("metering", """
    SELECT w.customer_id, date_trunc('month', a.ts) AS month, count(*) AS n_requests,
           count(CASE WHEN a.failed THEN 1 END) AS n_failed
    FROM attempt a JOIN webhook w ON w.id = a.webhook_id GROUP BY w.customer_id, date_trunc('month', a.ts)""",
       ("attempt", "webhook"))
def q_metering(spark, sf_dir):
    a = fx.attempts(spark, sf_dir)
    w = fx.webhooks(spark, sf_dir).select(F.col("id").alias("webhook_id"), "customer_id")
    return (a.join(w, "webhook_id")
            .groupBy("customer_id", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"))
            .agg(F.count(F.lit(1)).alias("n_requests"), F.count(F.when(F.col("failed"), 1)).alias("n_failed")))


@query("delivery_latency", """
    SELECT w.blockchain_id AS chain_id, count(*) AS n_deliveries,
           CAST(sum(CAST(floor(epoch(a.ts)) AS BIGINT) - CAST(floor(epoch(b.ts)) AS BIGINT)) AS BIGINT) AS total_latency_s
    FROM attempt a JOIN webhook w ON w.id = a.webhook_id
    JOIN block b ON b.chain_id = w.blockchain_id AND b.block_height = a.msg_id
    WHERE NOT a.failed GROUP BY w.blockchain_id""", ("attempt", "webhook", "block"))
def q_delivery_latency(spark, sf_dir):
    # message k of a webhook carries block k of its chain; latency = delivery - block time
    a = fx.attempts(spark, sf_dir).where(~F.col("failed"))
    w = fx.webhooks(spark, sf_dir).select(F.col("id").alias("webhook_id"), F.col("blockchain_id").alias("chain_id"))
    b = fx.blocks(spark, sf_dir).select("chain_id", F.col("block_height").alias("msg_id"), F.col("ts").alias("block_ts"))
    epoch = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    secs = (F.expr(f"timestampdiff(SECOND, {epoch}, ts)") - F.expr(f"timestampdiff(SECOND, {epoch}, block_ts)"))
    return (a.join(w, "webhook_id").join(b, ["chain_id", "msg_id"])
            .groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_deliveries"), F.sum(secs).alias("total_latency_s")))


SQL_VIEWS["hot_head"] = (("hot",), """
    SELECT chain_id, max(block_height) AS head, min(block_height) AS low, count(*) AS n_blocks FROM hot GROUP BY chain_id""")
SQL_VIEWS["hot_top10"] = (("hot",), """
    SELECT chain_id, block_height, block,
           CAST(row_number() OVER (PARTITION BY chain_id ORDER BY block_height DESC) AS INTEGER) AS rank
    FROM hot QUALIFY rank <= 10""")


@query("skip_evicted", """
    WITH pre AS (
      SELECT j.webhook_id, j.chain_id, j.next_height, j.is_new, w.max_blocks FROM job j
      JOIN webhook_live w ON w.id = j.webhook_id),
    r AS (
      SELECT p.webhook_id, count(*) AS n FROM pre p JOIN hot b ON b.chain_id = p.chain_id
        AND b.block_height BETWEEN p.next_height AND p.next_height + p.max_blocks - 1 WHERE NOT p.is_new GROUP BY 1
      UNION ALL
      SELECT p.webhook_id, count(*) FROM pre p JOIN hot_top10 t ON t.chain_id = p.chain_id AND t.rank <= p.max_blocks
      WHERE p.is_new GROUP BY 1)
    SELECT p.webhook_id, p.next_height,
           CASE WHEN r.n IS NOT NULL THEN 'deliver' WHEN NOT p.is_new AND p.next_height + p.max_blocks - 1 < h.low
                THEN 'evicted' ELSE 'waiting' END AS outcome,
           CASE WHEN r.n IS NOT NULL THEN NULL WHEN NOT p.is_new AND p.next_height + p.max_blocks - 1 < h.low
                THEN h.low ELSE p.next_height END AS new_next_height
    FROM pre p LEFT JOIN r USING (webhook_id) LEFT JOIN hot_head h ON h.chain_id = p.chain_id""",
       ("job", "webhook_live", "hot", "hot_top10", "hot_head"))
def q_skip_evicted(spark, sf_dir):
    # the store only keeps the hot tier: older cursors jump to its oldest height
    from chainlake.plans.q_delivery import _live_webhooks
    hot = fx.hot_tier(spark, sf_dir)
    heads = hot.groupBy("chain_id").agg(F.max("block_height").alias("head"), F.min("block_height").alias("low"))
    jobs = fx.jobs(spark, sf_dir).join(_live_webhooks(spark, sf_dir).select(F.col("id").alias("webhook_id")), "webhook_id")
    step = dv.relay_step(jobs, _live_webhooks(spark, sf_dir), hot, heads, None, skip_evicted=True)
    return step.select("webhook_id", "next_height", "outcome",
                       F.when(F.col("outcome") == "deliver", F.lit(None).cast("bigint"))
                       .otherwise(F.col("new_next_height")).alias("new_next_height"))
