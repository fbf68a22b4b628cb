"""Scheduling and delivery queries (§2.2 due/route, §2.3 job joins, §2.4
payload, §2.5 attempt windows, §2.9 relay round and plan)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake import fixtures as fx
from chainlake.fixtures import SQL_VIEWS
from chainlake.functions.columns import job_json
from chainlake.operators import delivery as dv
from chainlake.plans.catalog import query

# Webhooks still registered: inactive automobile hooks were removed, so their
# jobs must be dropped by the relay.
SQL_VIEWS["webhook_live"] = (("webhook",), """
    SELECT * FROM webhook WHERE NOT (is_active = 0 AND url LIKE 'https://automobile%')""")
SQL_VIEWS["failure"] = (("attempt",), """
    SELECT a.webhook_id, CAST(count(*) AS INTEGER) AS failures
    FROM attempt a LEFT JOIN (SELECT webhook_id, max(attempt_id) AS last_ok FROM attempt WHERE NOT failed
                              GROUP BY webhook_id) o USING (webhook_id)
    WHERE a.failed AND (o.last_ok IS NULL OR a.attempt_id > o.last_ok)
    GROUP BY a.webhook_id""")
SQL_VIEWS["top10"] = (("block",), """
    SELECT chain_id, block_height, block,
           CAST(row_number() OVER (PARTITION BY chain_id ORDER BY block_height DESC) AS INTEGER) AS rank
    FROM block QUALIFY rank <= 10""")
SQL_VIEWS["round_rows"] = (("job", "webhook_live", "block", "top10"), """
    SELECT j.webhook_id, j.is_new, b.block_height, b.block FROM job j JOIN webhook_live w ON w.id = j.webhook_id
    JOIN block b ON b.chain_id = j.chain_id AND b.block_height BETWEEN j.next_height AND j.next_height + w.max_blocks - 1
    WHERE NOT j.is_new
    UNION ALL
    SELECT j.webhook_id, j.is_new, t.block_height, t.block FROM job j JOIN webhook_live w ON w.id = j.webhook_id
    JOIN top10 t ON t.chain_id = j.chain_id AND t.rank <= w.max_blocks
    WHERE j.is_new""")
SQL_VIEWS["relay"] = (("job", "webhook_live", "failure", "block", "top10", "chain_head"), """
    WITH pre AS (
      SELECT j.webhook_id, j.chain_id, j.next_height, j.is_new, w.max_blocks, w.max_retries,
             CASE WHEN w.id IS NULL THEN 'dropped'
                  WHEN coalesce(f.failures, 0) >= 1 AND coalesce(f.failures, 0) >= greatest(1, w.max_retries - 1)
                  THEN 'skip' END AS o0
      FROM job j LEFT JOIN webhook_live w ON w.id = j.webhook_id LEFT JOIN failure f ON f.webhook_id = j.webhook_id),
    r AS (
      SELECT p.webhook_id, p.is_new, b.block_height, b.block FROM pre p
      JOIN block b ON b.chain_id = p.chain_id AND b.block_height BETWEEN p.next_height AND p.next_height + p.max_blocks - 1
      WHERE p.o0 IS NULL AND NOT p.is_new
      UNION ALL
      SELECT p.webhook_id, p.is_new, t.block_height, t.block FROM pre p
      JOIN top10 t ON t.chain_id = p.chain_id AND t.rank <= p.max_blocks
      WHERE p.o0 IS NULL AND p.is_new),
    pay AS (
      SELECT webhook_id, min(block_height) AS lo, max(block_height) AS hi, count(*) AS n,
             CAST(to_json(list(block ORDER BY CASE WHEN is_new THEN -block_height ELSE block_height END)) AS VARCHAR) AS body
      FROM r GROUP BY webhook_id),
    o AS (
      SELECT p.*, pay.lo, pay.hi, pay.n, pay.body, h.low,
             CASE WHEN p.o0 IS NOT NULL THEN p.o0 WHEN pay.n IS NOT NULL THEN 'deliver'
                  WHEN NOT p.is_new AND p.next_height + p.max_blocks - 1 < h.low THEN 'evicted'
                  ELSE 'waiting' END AS outcome
      FROM pre p LEFT JOIN pay USING (webhook_id) LEFT JOIN chain_head h ON h.chain_id = p.chain_id)
    SELECT webhook_id, chain_id, next_height, is_new, outcome,
           CASE WHEN outcome = 'deliver' THEN lo END AS first_height,
           CASE WHEN outcome = 'deliver' THEN hi END AS last_height,
           CASE WHEN outcome = 'deliver' THEN n END AS n_blocks,
           CASE WHEN outcome = 'deliver' THEN body END AS body,
           CASE WHEN outcome = 'dropped' THEN NULL
                WHEN outcome = 'deliver' THEN (CASE WHEN is_new THEN lo ELSE hi END) + 1
                WHEN outcome = 'skip' THEN next_height + 1 ELSE next_height END AS new_next_height,
           CASE WHEN outcome = 'dropped' THEN NULL WHEN outcome = 'deliver' THEN false ELSE is_new END AS new_is_new
    FROM o""")


def _live_webhooks(spark, sf_dir):
    w = fx.webhooks(spark, sf_dir)
    return w.where(~((F.col("is_active") == 0) & F.col("url").startswith("https://automobile")))


def _heads(spark, sf_dir):
    return fx.chain_heads(spark, sf_dir)


def _relay(spark, sf_dir, mode="reference"):
    failures = dv.current_failures(fx.attempts(spark, sf_dir))
    return dv.relay_step(fx.jobs(spark, sf_dir), _live_webhooks(spark, sf_dir), fx.blocks(spark, sf_dir),
                         _heads(spark, sf_dir), failures, mode=mode)


@query("due_jobs", """
    SELECT j.webhook_id, j.chain_id, j.next_height, j.is_new, h.head,
           CASE WHEN h.head IS NOT NULL AND j.next_height < h.head THEN 'ready' ELSE 'pending' END AS state
    FROM job j LEFT JOIN chain_head h USING (chain_id)""", ("job", "chain_head"))
def q_due_jobs(spark, sf_dir):
    return (dv.due_jobs(fx.jobs(spark, sf_dir), _heads(spark, sf_dir))
            .select("webhook_id", "chain_id", "next_height", "is_new", "head", "state"))


@query("requeue", """
    SELECT j.webhook_id, j.next_height,
           CASE WHEN j.is_new OR (h.head IS NOT NULL AND j.next_height < h.head) THEN 'ready' ELSE 'pending' END AS state
    FROM job j LEFT JOIN chain_head h USING (chain_id)""", ("job", "chain_head"))
def q_requeue(spark, sf_dir):
    # new jobs were activated straight into the stream; the rest wait pending
    j = fx.jobs(spark, sf_dir).withColumn("state", F.when(F.col("is_new"), "ready").otherwise("pending"))
    return dv.requeue(j, _heads(spark, sf_dir)).select("webhook_id", "next_height", "state")


@query("route_after_ack", """
    SELECT j.webhook_id, j.next_height + w.max_blocks AS next_height,
           CASE WHEN h.head IS NULL OR j.next_height + w.max_blocks >= h.head THEN 'pending' ELSE 'ready' END AS route
    FROM job j JOIN webhook w ON w.id = j.webhook_id LEFT JOIN chain_head h USING (chain_id)""",
       ("job", "webhook", "chain_head"))
def q_route_after_ack(spark, sf_dir):
    # every job acknowledged a full batch: cursor moves by max_blocks
    w = fx.webhooks(spark, sf_dir).select(F.col("id").alias("webhook_id"), "max_blocks")
    acked = (fx.jobs(spark, sf_dir).join(w, "webhook_id")
             .withColumn("next_height", F.col("next_height") + F.col("max_blocks")))
    return dv.route_after_ack(acked, _heads(spark, sf_dir)).select("webhook_id", "next_height", "route")


@query("pending_order", """
    SELECT j.shard_id, j.webhook_id, j.next_height, j.is_new,
           '{"WebhookID":"' || j.webhook_id || '","BlockHeight":' || CAST(j.next_height AS VARCHAR)
           || ',"IsNew":' || CASE WHEN j.is_new THEN 'true' ELSE 'false' END || '}' AS job_json
    FROM job j JOIN chain_head h USING (chain_id) WHERE NOT j.is_new AND j.next_height >= h.head""",
       ("job", "chain_head"))
def q_pending_order(spark, sf_dir):
    pend = (dv.due_jobs(fx.jobs(spark, sf_dir).where(~F.col("is_new")), _heads(spark, sf_dir))
            .where(F.col("state") == "pending"))
    return dv.pending_order(pend).select("shard_id", "webhook_id", "next_height", "is_new", "job_json")


@query("jobs_with_webhook", """
    SELECT j.webhook_id, j.next_height, j.is_new, w.max_blocks, w.max_retries, w.url, w.timeout_ms,
           w.id IS NULL AS dropped
    FROM job j LEFT JOIN webhook_live w ON w.id = j.webhook_id""", ("job", "webhook_live"))
def q_jobs_with_webhook(spark, sf_dir):
    return (dv.jobs_with_webhook(fx.jobs(spark, sf_dir), _live_webhooks(spark, sf_dir))
            .select("webhook_id", "next_height", "is_new", "max_blocks", "max_retries", "url", "timeout_ms",
                    "dropped"))


@query("jobs_with_blocks", """
    SELECT webhook_id, block_height, block FROM round_rows WHERE NOT is_new""", ("round_rows",))
def q_jobs_with_blocks(spark, sf_dir):
    j = dv.jobs_with_webhook(fx.jobs(spark, sf_dir).where(~F.col("is_new")), _live_webhooks(spark, sf_dir))
    return dv.jobs_with_blocks(j.where(~F.col("dropped")), fx.blocks(spark, sf_dir)).select(
        "webhook_id", "block_height", "block")


@query("new_jobs_with_latest", """
    SELECT webhook_id, block_height, block FROM round_rows WHERE is_new""", ("round_rows",))
def q_new_jobs_with_latest(spark, sf_dir):
    j = dv.jobs_with_webhook(fx.jobs(spark, sf_dir).where(F.col("is_new")), _live_webhooks(spark, sf_dir))
    return dv.new_jobs_with_latest(j.where(~F.col("dropped")), fx.blocks(spark, sf_dir)).select(
        "webhook_id", "block_height", "block")


@query("build_payload", """
    SELECT webhook_id, min(block_height) AS first_height, max(block_height) AS last_height, count(*) AS n_blocks,
           CAST(to_json(list(block ORDER BY block_height)) AS VARCHAR) AS body
    FROM round_rows GROUP BY webhook_id""", ("round_rows",))
def q_build_payload(spark, sf_dir):
    j = dv.jobs_with_webhook(fx.jobs(spark, sf_dir), _live_webhooks(spark, sf_dir)).where(~F.col("dropped"))
    return dv.payloads(j, fx.blocks(spark, sf_dir), _heads(spark, sf_dir), mode="ordered")


@query("relay_step", "SELECT * FROM relay", ("relay",))
def q_relay_step(spark, sf_dir):
    return _relay(spark, sf_dir)


@query("retry_skip", """
    SELECT j.webhook_id, j.next_height, j.is_new, f.failures, w.max_retries,
           CASE WHEN f.failures >= greatest(1, w.max_retries - 1) THEN 'skip' ELSE 'retry' END AS decision,
           CASE WHEN f.failures >= greatest(1, w.max_retries - 1) THEN j.next_height + 1 ELSE j.next_height END
             AS new_next_height
    FROM job j JOIN webhook_live w ON w.id = j.webhook_id JOIN failure f ON f.webhook_id = j.webhook_id
    WHERE f.failures >= 1""", ("job", "webhook_live", "failure"))
def q_retry_skip(spark, sf_dir):
    return dv.retry_skip(fx.jobs(spark, sf_dir), _live_webhooks(spark, sf_dir),
                         dv.current_failures(fx.attempts(spark, sf_dir)))


_PENDING_SQL = """
    SELECT a.webhook_id, a.msg_id, count(*) AS delivery_count, max(a.ts) AS last_delivery
    FROM attempt a WHERE NOT EXISTS (
      SELECT 1 FROM attempt k WHERE NOT k.failed AND k.webhook_id = a.webhook_id AND k.msg_id = a.msg_id)
    GROUP BY a.webhook_id, a.msg_id"""
SQL_VIEWS["pending_entry"] = (("attempt",), _PENDING_SQL)


@query("pending_entries", _PENDING_SQL, ("attempt",))
def q_pending_entries(spark, sf_dir):
    return dv.pending_entries(fx.attempts(spark, sf_dir))


@query("not_retryable", """
    SELECT p.webhook_id, p.msg_id, p.delivery_count, p.last_delivery, w.max_retries
    FROM pending_entry p JOIN webhook w ON w.id = p.webhook_id WHERE p.delivery_count >= w.max_retries""",
       ("pending_entry", "webhook"))
def q_not_retryable(spark, sf_dir):
    return dv.not_retryable(dv.pending_entries(fx.attempts(spark, sf_dir)), fx.webhooks(spark, sf_dir))


@query("ack_delete", """
    SELECT a.* FROM attempt a WHERE NOT EXISTS (
      SELECT 1 FROM attempt k WHERE NOT k.failed AND k.webhook_id = a.webhook_id AND k.msg_id = a.msg_id)""",
       ("attempt",))
def q_ack_delete(spark, sf_dir):
    a = fx.attempts(spark, sf_dir)
    acks = a.where(~F.col("failed")).select("webhook_id", "msg_id").distinct()
    return dv.ack_delete(a, acks).select("attempt_id", "ts", "webhook_id", "msg_id", "failed")


@query("attempt_number", """
    SELECT attempt_id, ts, webhook_id, msg_id, failed,
           CAST(row_number() OVER (PARTITION BY webhook_id, msg_id ORDER BY ts, attempt_id) AS INTEGER) AS attempt_no
    FROM attempt""", ("attempt",))
def q_attempt_number(spark, sf_dir):
    return dv.attempt_number(fx.attempts(spark, sf_dir))


_PLAN_SQL = """
    WITH jw AS (
      SELECT j.webhook_id, j.chain_id, j.next_height, j.is_new, CAST(w.max_blocks AS BIGINT) AS m, h.head, h.low,
             greatest(h.low, h.head - w.max_blocks + 1) AS first_lo
      FROM job j JOIN webhook w ON w.id = j.webhook_id JOIN chain_head h USING (chain_id)),
    st AS (
      SELECT webhook_id, chain_id, m, head, CASE WHEN is_new THEN {cursor} ELSE next_height END AS s,
             CASE WHEN is_new THEN 1 ELSE 0 END AS k0
      FROM jw)
    SELECT webhook_id, CAST(0 AS BIGINT) AS request_no, min(b.block_height) AS first_height,
           max(b.block_height) AS last_height, count(*) AS n_blocks
    FROM jw JOIN block b USING (chain_id) WHERE jw.is_new AND b.block_height >= jw.first_lo
    GROUP BY webhook_id
    UNION ALL
    SELECT st.webhook_id, CAST(st.k0 + (b.block_height - st.s) // st.m AS BIGINT) AS request_no,
           min(b.block_height), max(b.block_height), count(*)
    FROM st JOIN block b ON b.chain_id = st.chain_id AND b.block_height >= st.s
    GROUP BY st.webhook_id, st.k0 + (b.block_height - st.s) // st.m
    HAVING min(b.block_height) < max(st.head)"""


@query("delivery_plan", _PLAN_SQL.format(cursor="first_lo + 1"), ("job", "webhook", "block", "chain_head"))
def q_delivery_plan(spark, sf_dir):
    return dv.delivery_plan(fx.jobs(spark, sf_dir), fx.webhooks(spark, sf_dir), _heads(spark, sf_dir))


@query("delivery_plan_ordered", _PLAN_SQL.format(cursor="head + 1"), ("job", "webhook", "block", "chain_head"))
def q_delivery_plan_ordered(spark, sf_dir):
    return dv.delivery_plan(fx.jobs(spark, sf_dir), fx.webhooks(spark, sf_dir), _heads(spark, sf_dir),
                            mode="ordered")


SQL_VIEWS["outbox"] = (("relay", "webhook_live"), """
    SELECT r.webhook_id, r.first_height, CAST(0 AS BIGINT) AS batch_id, w.url, w.timeout_ms, r.n_blocks, r.body
    FROM relay r JOIN webhook_live w ON w.id = r.webhook_id WHERE r.outcome = 'deliver'""")


@query("delivery_outbox", "SELECT * FROM outbox", ("outbox",))
def q_delivery_outbox(spark, sf_dir):
    return dv.delivery_outbox(_relay(spark, sf_dir), _live_webhooks(spark, sf_dir), 0)


@query("delivery_summary", """
    WITH items AS (
      SELECT o.webhook_id, CAST(json_extract_string(x.b, '$.height') AS BIGINT) AS h,
             json_extract_string(x.b, '$.timestamp') AS t
      FROM outbox o, unnest(CAST(o.body AS VARCHAR[])) AS x(b))
    SELECT r.webhook_id, r.n_requests, i.n_blocks, i.min_height, i.max_height, i.first_ts, i.last_ts,
           i.n_missing_fields
    FROM (SELECT webhook_id, count(*) AS n_requests FROM outbox GROUP BY webhook_id) r
    JOIN (SELECT webhook_id, count(*) AS n_blocks, min(h) AS min_height, max(h) AS max_height,
                 min(t) AS first_ts, max(t) AS last_ts,
                 count(CASE WHEN h IS NULL OR t IS NULL THEN 1 END) AS n_missing_fields
          FROM items GROUP BY webhook_id) i USING (webhook_id)""", ("outbox",))
def q_delivery_summary(spark, sf_dir):
    return dv.delivery_summary(dv.delivery_outbox(_relay(spark, sf_dir), _live_webhooks(spark, sf_dir), 0))


@query("current_failures", "SELECT * FROM failure", ("failure",))
def q_current_failures(spark, sf_dir):
    return dv.current_failures(fx.attempts(spark, sf_dir))


__all__ = ["job_json"]



_GAPPED_SQL = """
    WITH RECURSIVE
    hd AS (SELECT chain_id, max(block_height) AS head FROM received GROUP BY chain_id),
    jw AS (SELECT j.webhook_id, j.chain_id, j.next_height, j.is_new, CAST(w.max_blocks AS BIGINT) AS m, hd.head
           FROM job j JOIN webhook w ON w.id = j.webhook_id JOIN hd USING (chain_id)),
    top AS (SELECT chain_id, block_height, row_number() OVER (PARTITION BY chain_id ORDER BY block_height DESC) AS rk
            FROM received),
    firstreq AS (SELECT jw.webhook_id, min(t.block_height) AS lo, max(t.block_height) AS hi, count(*) AS n
                 FROM jw JOIN top t ON t.chain_id = jw.chain_id AND t.rk <= jw.m WHERE jw.is_new GROUP BY jw.webhook_id),
    starts AS (SELECT jw.webhook_id, jw.chain_id, jw.m, jw.head,
                      CASE WHEN jw.is_new THEN f.lo + 1 ELSE jw.next_height END AS s,
                      CASE WHEN jw.is_new THEN 1 ELSE 0 END AS k
               FROM jw LEFT JOIN firstreq f USING (webhook_id) WHERE NOT jw.is_new OR f.lo IS NOT NULL),
    walk AS (
      SELECT webhook_id, chain_id, m, head, s, k FROM starts
      UNION ALL
      SELECT w.webhook_id, w.chain_id, w.m, w.head,
             (SELECT max(r.block_height) FROM received r
              WHERE r.chain_id = w.chain_id AND r.block_height BETWEEN w.s AND w.s + w.m - 1) + 1, w.k + 1
      FROM walk w
      WHERE w.s < w.head AND EXISTS (SELECT 1 FROM received r
              WHERE r.chain_id = w.chain_id AND r.block_height BETWEEN w.s AND w.s + w.m - 1))
    SELECT webhook_id, CAST(0 AS BIGINT) AS request_no, lo AS first_height, hi AS last_height, n AS n_blocks
    FROM firstreq
    UNION ALL
    SELECT w.webhook_id, CAST(w.k AS BIGINT), min(r.block_height), max(r.block_height), count(*)
    FROM walk w JOIN received r ON r.chain_id = w.chain_id AND r.block_height BETWEEN w.s AND w.s + w.m - 1
    WHERE w.s < w.head GROUP BY w.webhook_id, w.k"""


@query("delivery_plan_gapped", _GAPPED_SQL, ("job", "webhook", "received"))
def q_delivery_plan_gapped(spark, sf_dir):
    """Plan over a store that lost every block whose payload was still
    pending: gaps everywhere, so requests span gaps shorter than m."""
    from chainlake.operators.gapped import delivery_plan_gapped
    received = fx.blocks(spark, sf_dir).where(~F.col("block").contains('"status":"P"'))
    return delivery_plan_gapped(fx.jobs(spark, sf_dir), fx.webhooks(spark, sf_dir), received)


SQL_VIEWS["mixed_store"] = (("block",), """
    SELECT * FROM block WHERE chain_id <> 'ASIA' OR block NOT LIKE '%"status":"P"%'""")
SQL_VIEWS["gapped_plan"] = (("job", "webhook", "mixed_store"),
                            "SELECT * FROM (" + _GAPPED_SQL.replace("received", "mixed_store") + ") g")


@query("plan_deliveries", """
    SELECT * FROM (""" + _PLAN_SQL.format(cursor="first_lo + 1") + """) p
    WHERE webhook_id IN (SELECT webhook_id FROM job WHERE chain_id <> 'ASIA')
    UNION ALL
    SELECT * FROM gapped_plan WHERE webhook_id IN (SELECT webhook_id FROM job WHERE chain_id = 'ASIA')""",
       ("job", "webhook", "block", "chain_head", "gapped_plan"))
def q_plan_deliveries(spark, sf_dir):
    """One chain lost its pending blocks (gaps), the others are whole: each
    chain gets the method its heights allow."""
    from chainlake.operators.gapped import plan_deliveries
    b = fx.blocks(spark, sf_dir)
    store = b.where((F.col("chain_id") != "ASIA") | ~F.col("block").contains('"status":"P"'))
    return plan_deliveries(fx.jobs(spark, sf_dir), fx.webhooks(spark, sf_dir), store)
