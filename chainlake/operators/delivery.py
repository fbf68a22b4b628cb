"""Cursor scheduling and delivery: every webhook at once, one plan per round.

Inputs are DataFrames:

* ``jobs``     ``(webhook_id, next_height, is_new[, chain_id, shard_id])``
* ``webhooks`` registry rows ``(id, blockchain_id, max_blocks, max_retries, url, timeout_ms, ...)``
* ``blocks``   store rows ``(chain_id, block_height, block)``
* ``heads``    ``(chain_id, head[, low])`` -- one row per chain

``heads`` has one row per chain, so it is broadcast by construction.  The
only large join is jobs x blocks; it is an equi-join on (chain, height)
after exploding each job into at most ``max_blocks`` (<= 10) heights.  A
direct range predicate would plan as a nested-loop join.

``mode``:

* ``reference`` -- a new job gets the latest ``m`` blocks newest-first and its
  cursor becomes the lowest of them + 1 (so up to m-1 blocks are sent again).
* ``ordered``   -- the same blocks oldest-first, cursor = highest + 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlake.functions.columns import attempts_allowed, div_floor, job_json
from chainlake.operators.store import HEIGHT_BUCKET

PLAN_CHUNK = 8192  # requests of a job that one row of the plan's first step stands for


def _heads_b(heads: DataFrame) -> DataFrame:
    return F.broadcast(heads)  # one row per chain


def due_jobs(jobs: DataFrame, heads: DataFrame, inclusive: bool = False) -> DataFrame:
    """Mark each job ``ready`` when blocks past its cursor exist: strictly
    ``next_height < head`` by default, so the head block waits for one more."""
    j = jobs.join(_heads_b(heads.select("chain_id", "head")), "chain_id", "left")
    due = (F.col("next_height") <= F.col("head")) if inclusive else (F.col("next_height") < F.col("head"))
    return j.withColumn("state", F.when(F.col("head").isNotNull() & due, "ready").otherwise("pending"))


def requeue(jobs: DataFrame, heads: DataFrame) -> DataFrame:
    """Flush of the pending set: due pending jobs join the ready ones."""
    j = jobs.join(_heads_b(heads.select("chain_id", "head")), "chain_id", "left")
    moved = (F.col("state") == "pending") & F.col("head").isNotNull() & (F.col("next_height") < F.col("head"))
    return j.withColumn("state", F.when((F.col("state") == "ready") | moved, "ready").otherwise("pending"))


def route_after_ack(jobs: DataFrame, heads: DataFrame) -> DataFrame:
    """Where a re-queued job goes: unknown head or ``next >= head`` -> pending."""
    j = jobs.join(_heads_b(heads.select("chain_id", "head")), "chain_id", "left")
    return j.withColumn(
        "route", F.when(F.col("head").isNull() | (F.col("next_height") >= F.col("head")), "pending")
                  .otherwise("ready"))


def pending_order(jobs: DataFrame) -> DataFrame:
    """Order of a pending set: lowest height first, ties by the job's wire
    text.  A distributed (range-partitioned) sort, never a single task."""
    return (jobs.withColumn("job_json", job_json("webhook_id", "next_height", "is_new"))
            .orderBy("shard_id", "next_height", "job_json"))


def jobs_with_webhook(jobs: DataFrame, webhooks: DataFrame) -> DataFrame:
    """Left join of jobs to their webhook; a missing webhook marks the job
    ``dropped`` (it is acknowledged and leaves the active set)."""
    w = webhooks.select(F.col("id").alias("webhook_id"), F.col("blockchain_id"), "max_blocks",
                        "max_retries", "url", "timeout_ms")
    return (jobs.join(w, "webhook_id", "left")
            .withColumn("dropped", F.col("max_blocks").isNull()))


ATTEMPT_BUCKET = 1_000_000  # attempt ids per pre-aggregation bucket


def current_failures(attempts: DataFrame, bucket: int = ATTEMPT_BUCKET) -> DataFrame:
    """Failed deliveries of each webhook's current message: failures after
    its last success (``attempts(attempt_id, webhook_id, failed)``).

    Pre-aggregated before any shuffle of raw rows: per (webhook, id bucket)
    the last success, the failures after it and all failures; then per
    webhook the buckets after the last successful one are summed.  A webhook
    with a third of all attempts costs one small row per bucket."""
    from pyspark.sql.window import Window
    b = attempts.withColumn("_b", div_floor(F.col("attempt_id"), bucket))
    # last success inside the bucket (a window bounded by the bucket size)
    b = b.withColumn("_okb", F.max(F.when(~F.col("failed"), F.col("attempt_id")))
                     .over(Window.partitionBy("webhook_id", "_b")))
    per = (b.groupBy("webhook_id", "_b")
           .agg(F.max("_okb").alias("_ok"),
                F.count(F.when(F.col("failed"), 1)).alias("_fail"),
                # failures after the bucket's own last success (all if it has none)
                F.count(F.when(F.col("failed") & (F.col("attempt_id") > F.coalesce(F.col("_okb"), F.lit(-1))), 1))
                .alias("_after")))
    w = (per.groupBy("webhook_id")
         .agg(F.max(F.when(F.col("_ok").isNotNull(), F.col("_b"))).alias("_last_ok_b"),
              F.collect_list(F.struct("_b", "_fail", "_after")).alias("_bs")))
    total = F.aggregate(
        "_bs", F.lit(0).cast("bigint"),
        lambda acc, x: acc + F.when(F.col("_last_ok_b").isNull() | (x["_b"] > F.col("_last_ok_b")), x["_fail"])
                          .when(x["_b"] == F.col("_last_ok_b"), x["_after"]).otherwise(F.lit(0)).cast("bigint"))
    return w.select("webhook_id", total.cast("int").alias("failures")).where(F.col("failures") > 0)


def retry_skip(jobs: DataFrame, webhooks: DataFrame, failures: DataFrame) -> DataFrame:
    """Decide ``retry`` or ``skip`` for jobs whose current message failed:
    after ``attempts_allowed(max_retries)`` failures the cursor moves one up
    and ``is_new`` is kept."""
    j = (jobs_with_webhook(jobs, webhooks).where(~F.col("dropped"))
         .join(failures, "webhook_id", "left")
         .withColumn("failures", F.coalesce("failures", F.lit(0))))
    skip = (F.col("failures") >= 1) & (F.col("failures") >= attempts_allowed("max_retries"))
    return (j.where(F.col("failures") >= 1)
            .withColumn("decision", F.when(skip, "skip").otherwise("retry"))
            .withColumn("new_next_height", F.when(skip, F.col("next_height") + 1).otherwise(F.col("next_height")))
            .select("webhook_id", "next_height", "is_new", "failures", "max_retries", "decision", "new_next_height"))


def not_retryable(pending: DataFrame, webhooks: DataFrame) -> DataFrame:
    """Pending entries whose delivery count reached the webhook's limit."""
    w = webhooks.select(F.col("id").alias("webhook_id"), "max_retries")
    return pending.join(w, "webhook_id").where(F.col("delivery_count") >= F.col("max_retries"))


def prune_to_requests(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Restrict a partitioned store to the buckets that requests touch, so
    dynamic partition pruning skips the rest of the archive."""
    if "height_bucket" not in blocks.columns:
        return blocks
    buckets = (wanted.select("chain_id", div_floor(F.col("block_height"), HEIGHT_BUCKET)
                             .alias("height_bucket")).distinct())
    return blocks.join(buckets, ["chain_id", "height_bucket"], "left_semi")


HOT_KEY_ROWS = 1_000_000  # a (chain, height) wanted by this many jobs is salted
SALT_WAYS = 16


def jobs_with_blocks(jobs: DataFrame, blocks: DataFrame, hot_rows: int = HOT_KEY_ROWS,
                     salt: int = SALT_WAYS) -> DataFrame:
    """Blocks ``[next_height, next_height + max_blocks - 1]`` of every
    (non-new) job, as an equi-join after exploding the range.

    Many webhooks wait on the same newest heights, so a single (chain,
    height) may be wanted by a third of all jobs.  Keys wanted at least
    ``hot_rows`` times are found by a pre-aggregated count.  Their number is
    at most ``|wanted| / hot_rows``, which is what makes broadcasting them
    safe.  Their job rows are spread over ``salt`` sub-keys, and their block
    rows are copied once per sub-key; all other keys join normally.
    """
    keys = ["chain_id", "block_height"]
    wanted = (jobs.select("webhook_id", "chain_id",
                          F.explode(F.sequence(F.col("next_height"),
                                               F.col("next_height") + F.col("max_blocks") - 1)).alias("block_height")))
    b = prune_to_requests(blocks.select("chain_id", "block_height", "block",
                                         *(["height_bucket"] if "height_bucket" in blocks.columns else [])), wanted)
    b = b.select("chain_id", "block_height", "block")
    if salt <= 1:
        return wanted.join(b, keys)
    hot = (wanted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") >= hot_rows).select(*keys, F.lit(True).alias("_hot")))
    hot_b = F.broadcast(hot)  # at most |wanted| / hot_rows keys
    tagged = wanted.join(hot_b, keys, "left")
    cold_part = tagged.where(F.col("_hot").isNull()).drop("_hot").join(b, keys)
    hot_jobs = (tagged.where(F.col("_hot")).drop("_hot")
                .withColumn("_salt", F.pmod(F.xxhash64("webhook_id"), F.lit(salt))))
    hot_blocks = (b.join(hot_b, keys).drop("_hot")
                  .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint")))))
    hot_part = hot_jobs.join(hot_blocks, keys + ["_salt"]).drop("_salt")
    return cold_part.unionByName(hot_part)


def batch_bounds(jobs: DataFrame) -> DataFrame:
    """``(chain_id, n)``: the largest batch size of the jobs on each chain."""
    return jobs.groupBy("chain_id").agg(F.max("max_blocks").cast("bigint").alias("n"))


def _latest(blocks: DataFrame, bounds: DataFrame) -> DataFrame:
    """Latest ``n`` blocks per chain, ``n`` from ``bounds(chain_id, n)``."""
    ranked = blocks.select("chain_id", "block_height", "block").withColumn(
        "rank", F.row_number().over(Window.partitionBy("chain_id").orderBy(F.col("block_height").desc())))
    return ranked.join(bounds, "chain_id").where(F.col("rank") <= F.col("n")).drop("n")


def latest_needed(blocks: DataFrame, heads: DataFrame, bounds: DataFrame,
                  lookback: int = HEIGHT_BUCKET) -> DataFrame:
    """Latest ``n`` blocks of every chain in ``bounds(chain_id, n)`` without
    ranking the whole store.

    Only heights in ``(head - lookback, head]`` are ranked; on a partitioned
    store the window is a semi-join on the partition columns, so dynamic
    partition pruning reads just the newest buckets.  Chains with fewer than
    ``n`` blocks in the window (gaps, short chains, a batch size above the
    window) fall back to ranking their whole chain -- a semi-join on
    ``chain_id`` that prunes to those chains only -- so the result is exact.
    """
    h = heads.select("chain_id", "head").join(bounds, "chain_id")
    # one sample height per bucket step of the window, plus the head itself
    samples = F.array_union(F.sequence(F.greatest(F.col("head") - lookback + 1, F.lit(0)), F.col("head"),
                                       F.lit(max(HEIGHT_BUCKET // 2, 1)).cast("bigint")), F.array(F.col("head")))
    wanted = h.select("chain_id", F.explode(samples).alias("block_height"))
    recent = prune_to_requests(blocks, wanted).join(F.broadcast(h), "chain_id")  # one row per chain
    recent = recent.where(F.col("block_height") > F.col("head") - lookback)
    top = _latest(recent, bounds)
    found = top.groupBy("chain_id").agg(F.count(F.lit(1)).alias("k"))
    short = (h.join(found, "chain_id", "left").where(F.coalesce("k", F.lit(0)) < F.col("n")).select("chain_id"))
    full = _latest(blocks.join(short, "chain_id", "left_semi"), bounds)
    return top.join(short, "chain_id", "left_anti").unionByName(full)


def recent_top_blocks(blocks: DataFrame, heads: DataFrame, n: int, lookback: int = HEIGHT_BUCKET) -> DataFrame:
    """``latest_needed`` with the same ``n`` for every chain."""
    return latest_needed(blocks, heads, heads.select("chain_id", F.lit(n).cast("bigint").alias("n")), lookback)


def new_jobs_with_latest(jobs: DataFrame, blocks: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Latest ``max_blocks`` blocks of the chain for every new job.  As many
    blocks per chain are ranked as its largest batch asks for; the planner
    broadcasts them only if their payloads are small."""
    bounds = batch_bounds(jobs)
    top = _latest(blocks, bounds) if heads is None else latest_needed(blocks, heads, bounds)
    return (jobs.join(top, "chain_id")
            .where(F.col("rank") <= F.col("max_blocks"))
            .select("webhook_id", "chain_id", "block_height", "block"))


def build_payload(rows: DataFrame, descending=False, keys=("webhook_id",)) -> DataFrame:
    """One request per ``keys``: ordered JSON array of block strings.  A
    group holds the blocks of one request, at most ``max_blocks`` rows.
    ``descending`` may be a bool or a boolean column of ``rows``."""
    desc = descending if not isinstance(descending, bool) else F.lit(descending)
    g = (rows.withColumn("_desc", desc).groupBy(*keys)
         .agg(F.sort_array(F.collect_list(F.struct("block_height", "block"))).alias("items"),
              F.first("_desc").alias("_desc")))
    items = F.when(F.col("_desc"), F.reverse("items")).otherwise(F.col("items"))
    return g.select(
        *keys,
        F.col("items")[0]["block_height"].alias("first_height"),
        F.element_at("items", -1)["block_height"].alias("last_height"),
        F.size("items").cast("bigint").alias("n_blocks"),
        F.to_json(F.transform(items, lambda x: x["block"])).alias("body"),
    )


#: What a request asks for.  ``[lo, hi]`` are heights; for a new job, ``hi`` is the number of newest blocks.
RANGE = ["chain_id", "is_new", "lo", "hi"]


def with_range(jobs: DataFrame) -> DataFrame:
    """Jobs (with ``max_blocks``) and the range that each one asks for next."""
    m = F.col("max_blocks").cast("bigint")
    return (jobs.withColumn("lo", F.when(F.col("is_new"), F.lit(0).cast("bigint")).otherwise(F.col("next_height")))
            .withColumn("hi", F.when(F.col("is_new"), m).otherwise(F.col("next_height") + m - 1)))


def range_bodies(ranges: DataFrame, blocks: DataFrame, heads: DataFrame | None = None,
                 mode: str = "reference", new_jobs: bool = True) -> DataFrame:
    """``RANGE`` with ``first_height, last_height, n_blocks, body``: one body per distinct range.

    Most webhooks of a chain ask for the same newest ranges.  Each range is
    built once, so payloads are shuffled per distinct range (a height lies in
    at most m (m + 1) / 2 ranges of up to m blocks) and not per webhook.
    Ranges without a stored block have no row.  A caller that has no new jobs
    passes ``new_jobs`` False, which makes the plan smaller.
    """
    keys = ranges.select(*RANGE).distinct()
    old = keys.where(~F.col("is_new")).select("*", F.explode(F.sequence("lo", "hi")).alias("block_height"))
    stored = prune_to_requests(blocks, old).select("chain_id", "block_height", "block")
    rows = old.join(stored, ["chain_id", "block_height"]).select(*RANGE, "block_height", "block")
    if not new_jobs:
        return build_payload(rows, False, RANGE)
    new = keys.where(F.col("is_new"))
    bounds = new.groupBy("chain_id").agg(F.max("hi").alias("n"))
    top = (_latest(blocks, bounds) if heads is None else latest_needed(blocks, heads, bounds))
    newest = new.join(top, "chain_id").where(F.col("rank") <= F.col("hi"))
    rows = rows.unionByName(newest.select(*RANGE, "block_height", "block"))
    return build_payload(rows, F.col("is_new") & F.lit(mode == "reference"), RANGE)


def join_bodies(requests: DataFrame, bodies: DataFrame, how: str = "inner", hot_rows: int | None = None,
                salt: int = SALT_WAYS) -> DataFrame:
    """``requests`` (with ``RANGE``) and the body of each.

    A range wanted at least ``hot_rows`` times (a count that combines before
    the shuffle finds at most |requests| / hot_rows of them, so broadcasting
    the keys is safe) is spread over ``salt`` tasks with a copy of its body.
    """
    limit = HOT_KEY_ROWS if hot_rows is None else hot_rows
    hot = F.broadcast(requests.groupBy(*RANGE).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= limit)
                      .select(*RANGE, F.lit(True).alias("_hot")))
    ways = F.when(F.col("_hot"), F.lit(salt)).otherwise(F.lit(1))
    left = (requests.join(hot, RANGE, "left")
            .withColumn("_salt", F.pmod(F.xxhash64("webhook_id"), ways).cast("int")).drop("_hot"))
    right = (bodies.join(hot, RANGE, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), ways - 1))).drop("_hot"))
    return left.join(right, [*RANGE, "_salt"], how).drop("_salt")


def payloads(jobs: DataFrame, blocks: DataFrame, heads: DataFrame | None = None, mode: str = "reference") -> DataFrame:
    """``(webhook_id, first_height, last_height, n_blocks, body)`` of every job (with ``max_blocks``) that finds blocks."""
    asked = with_range(jobs).select("webhook_id", *RANGE)
    return (join_bodies(asked, range_bodies(asked, blocks, heads, mode))
            .select("webhook_id", "first_height", "last_height", "n_blocks", "body"))


def relay_step(jobs: DataFrame, webhooks: DataFrame, blocks: DataFrame, heads: DataFrame,
               failures: DataFrame | None = None, mode: str = "reference",
               skip_evicted: bool = False) -> DataFrame:
    """One delivery round over all jobs.

    ``outcome``: ``dropped`` (webhook gone), ``skip`` (retries used up),
    ``deliver`` (a request with ``body``), ``waiting`` (range above the head)
    or ``evicted`` (range below the oldest stored block).  The new cursor is
    ``new_next_height``/``new_is_new``.  With ``skip_evicted`` an evicted
    cursor jumps to the oldest stored height.
    """
    if mode not in ("reference", "ordered"):
        raise ValueError(f"unknown mode {mode!r}")
    j = jobs_with_webhook(jobs, webhooks)
    if failures is not None:
        j = j.join(failures, "webhook_id", "left")
    else:
        j = j.withColumn("failures", F.lit(None).cast("int"))
    j = j.withColumn("failures", F.coalesce("failures", F.lit(0)))
    skip = (F.col("failures") >= 1) & (F.col("failures") >= attempts_allowed("max_retries"))
    j = j.withColumn("outcome", F.when(F.col("dropped"), "dropped").when(skip, "skip"))

    live = with_range(j.where(F.col("outcome").isNull()))
    found = join_bodies(live, range_bodies(live, blocks, heads, mode), "left")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in
               (("first_height", "bigint"), ("last_height", "bigint"), ("n_blocks", "bigint"), ("body", "string"))]
    still = with_range(j.where(F.col("outcome").isNotNull())).select("*", *nothing)

    h = _heads_b(heads.select("chain_id", "head", "low"))
    out = found.unionByName(still).join(h, "chain_id", "left")
    delivered = F.col("n_blocks").isNotNull()
    evicted = (F.col("next_height") + F.col("max_blocks") - 1) < F.col("low")
    outcome = (F.when(F.col("outcome").isNotNull(), F.col("outcome"))
                .when(delivered, "deliver")
                .when(~F.col("is_new") & evicted, "evicted")
                .otherwise("waiting"))
    # last element of the payload + 1 (reference: the lowest height for a new job)
    last_sent = F.when(F.col("is_new") & F.lit(mode == "reference"), F.col("first_height")).otherwise(F.col("last_height"))
    new_next = (F.when(F.col("_o") == "deliver", last_sent + 1)
                 .when(F.col("_o") == "skip", F.col("next_height") + 1)
                 .when((F.col("_o") == "evicted") & F.lit(skip_evicted), F.col("low"))
                 .otherwise(F.col("next_height")))
    new_is_new = F.when(F.col("_o") == "deliver", F.lit(False)).otherwise(F.col("is_new"))
    return (out.withColumn("_o", outcome)
            .select("webhook_id", "chain_id", "next_height", "is_new", F.col("_o").alias("outcome"),
                    F.when(F.col("_o") == "deliver", F.col("first_height")).alias("first_height"),
                    F.when(F.col("_o") == "deliver", F.col("last_height")).alias("last_height"),
                    F.when(F.col("_o") == "deliver", F.col("n_blocks")).alias("n_blocks"),
                    F.when(F.col("_o") == "deliver", F.col("body")).alias("body"),
                    F.when(F.col("_o") == "dropped", F.lit(None).cast("bigint")).otherwise(new_next).alias("new_next_height"),
                    F.when(F.col("_o") == "dropped", F.lit(None).cast("boolean")).otherwise(new_is_new).alias("new_is_new")))


def delivery_plan(jobs: DataFrame, webhooks: DataFrame, heads: DataFrame, mode: str = "reference",
                  inclusive: bool = False) -> DataFrame:
    """All requests until nothing is due, for every webhook, without
    touching block payloads: ``(webhook_id, request_no, first_height,
    last_height, n_blocks)``.

    Closed form for chains with contiguous heights (check ``height_gaps``):
    a job at ``s`` with head ``L`` and batch ``m`` gets requests
    ``lo = s + k*m`` for every ``lo < L`` (``<= L`` if inclusive), each
    ``[lo, least(lo+m-1, L)]``.  A first range that begins below the oldest
    stored block is clipped to it; one that ends below it finds nothing, so
    the job is evicted and has no request.  A new job first gets the latest
    ``m`` blocks and continues from the cursor its ``mode`` gives.  Rows are
    made in two steps of bounded arrays, so a far-behind job is neither one
    huge row nor one task's work; no shuffle beyond the webhook lookup.
    """
    j = (jobs.join(webhooks.select(F.col("id").alias("webhook_id"), "max_blocks"), "webhook_id")
         .join(_heads_b(heads.select("chain_id", "head", "low")), "chain_id"))
    m, L = F.col("max_blocks").cast("bigint"), F.col("head")
    first_lo = F.greatest(F.col("low"), L - m + 1)
    cursor_after_first = (first_lo + 1) if mode == "reference" else (L + 1)
    start = F.when(F.col("is_new"), cursor_after_first).otherwise(F.col("next_height"))
    span = L - start + (1 if inclusive else 0)
    n_req = F.when(span > 0, F.ceil(span / m)).otherwise(F.lit(0)).cast("bigint")
    # one pass: k = -1 is a new job's first request (latest m), k >= 0 the rest
    k_min = F.when(F.col("is_new"), F.lit(-1)).otherwise(F.lit(0)).cast("bigint")
    g = (j.select("webhook_id", "is_new", m.alias("m"), L.alias("L"), F.col("low"), first_lo.alias("first_lo"),
                  start.alias("s"), n_req.alias("n"), k_min.alias("k_min"))
         .where(F.col("is_new") | ((F.col("n") > 0) & (F.col("s") + F.col("m") > F.col("low"))))
         .select("*", F.explode(F.sequence(F.col("k_min"), F.col("n") - 1, F.lit(PLAN_CHUNK).cast("bigint"))).alias("c"))
         .repartition("webhook_id", "c")
         .select("*", F.explode(F.sequence(F.col("c"), F.least(F.col("c") + PLAN_CHUNK, F.col("n")) - 1)).alias("k")))
    is_first = F.col("k") < 0
    lo = F.when(is_first, F.col("first_lo")).otherwise(F.greatest(F.col("s") + F.col("k") * F.col("m"), F.col("low")))
    hi = F.when(is_first, F.col("L")).otherwise(F.least(F.col("s") + F.col("k") * F.col("m") + F.col("m") - 1, F.col("L")))
    k0 = F.when(F.col("is_new"), F.lit(1)).otherwise(F.lit(0))
    return g.select("webhook_id",
                    F.when(is_first, F.lit(0)).otherwise(F.col("k") + k0).cast("bigint").alias("request_no"),
                    lo.alias("first_height"), hi.alias("last_height"), (hi - lo + 1).alias("n_blocks"))


def pending_entries(attempts: DataFrame) -> DataFrame:
    """Delivered but never acknowledged messages with their delivery count.
    One partial aggregation per (webhook, message) -- no join of raw rows:
    a message is pending when none of its deliveries succeeded."""
    return (attempts.groupBy("webhook_id", "msg_id")
            .agg(F.count(F.lit(1)).alias("delivery_count"), F.max("ts").alias("last_delivery"),
                 F.max((~F.col("failed")).cast("int")).alias("_acked"))
            .where(F.col("_acked") == 0).drop("_acked"))


def ack_delete(attempts: DataFrame, acks: DataFrame) -> DataFrame:
    """Stream after acknowledging and deleting ``acks(webhook_id, msg_id)``."""
    return attempts.join(acks.select("webhook_id", "msg_id"), ["webhook_id", "msg_id"], "left_anti")


def attempt_number(attempts: DataFrame, bucket_hours: int = 24) -> DataFrame:
    """n-th delivery of each message, ranked by time.  Ranked inside time
    buckets with offsets from earlier buckets, so a message with a huge
    number of attempts is not one window partition."""
    from chainlake.operators.quality import bucketed_row_number
    hours = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return bucketed_row_number(attempts, ["webhook_id", "msg_id"], ["ts", "attempt_id"],
                               F.floor(hours / F.lit(bucket_hours)).cast("bigint"), "attempt_no")


def delivery_outbox(step: DataFrame, webhooks: DataFrame, batch_id: int) -> DataFrame:
    """Rows to send, keyed ``(webhook_id, first_height, batch_id)`` so that a
    replayed batch overwrites the same keys (exactly-once records)."""
    w = webhooks.select(F.col("id").alias("webhook_id"), "url", "timeout_ms")
    return (step.where(F.col("outcome") == "deliver").join(w, "webhook_id")
            .select("webhook_id", "first_height", F.lit(batch_id).cast("bigint").alias("batch_id"),
                    "url", "timeout_ms", "n_blocks", "body"))


def delivery_summary(outbox: DataFrame) -> DataFrame:
    """Requests and blocks per webhook, heights and timestamps read back
    from the request bodies.  A body is parsed once and summed up in its own
    row; one aggregation per webhook follows."""
    read = F.transform(F.from_json("body", "array<string>"),
                       lambda b: F.from_json(b, "height bigint, timestamp string"))
    per = (outbox.select("webhook_id", read.alias("r"))
           .select("webhook_id", F.size("r").alias("n"), F.col("r.height").alias("h"), F.col("r.timestamp").alias("t"),
                   F.size(F.filter("r", lambda x: x["height"].isNull() | x["timestamp"].isNull())).alias("bad")))
    return per.groupBy("webhook_id").agg(
        F.count(F.lit(1)).alias("n_requests"), F.sum("n").cast("bigint").alias("n_blocks"),
        F.min(F.array_min("h")).alias("min_height"), F.max(F.array_max("h")).alias("max_height"),
        F.min(F.array_min("t")).alias("first_ts"), F.max(F.array_max("t")).alias("last_ts"),
        F.sum("bad").cast("bigint").alias("n_missing_fields")).where(F.col("n_blocks") > 0)
