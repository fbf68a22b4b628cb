"""Several ordered requests of a job in one round.

``request_window`` lists the next requests of every due job, at most
``window`` each, in the order in which they must be sent.  It gives the same
requests as running ``relay_step`` again and again, but without payloads; the
bodies of a round are built once per distinct range (``delivery.range_bodies``)
and meet the requests only when they are written.

On a chain whose stored heights are contiguous a job's requests are
arithmetic.  On a chain with gaps the next cursor is the last *stored* height
of a request + 1: the stored heights of ``[next, next + window * m - 1]`` (at
most ``window * m`` per job, an equi-join without payloads) are folded into
requests.  A cursor advances by at most ``m`` per request, so the first
``window`` requests lie inside that range.

``advance`` is a prefix scan over the sender's answers: the cursor moves
behind the last success before the first failure, and only that first failure
counts as an attempt, since nothing behind it may be sent before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.functions.columns import attempts_allowed
from chainlake.operators import delivery as dv

MESSAGE = ["webhook_id", "next_height", "is_new"]
_REQUEST = "struct<c: bigint, first: bigint, last: bigint, n: bigint>"


def chain_bounds(blocks: DataFrame) -> DataFrame:
    """``(chain_id, head, low, n_blocks)``: bounds and number of stored heights."""
    return blocks.groupBy("chain_id").agg(
        F.max("block_height").alias("head"), F.min("block_height").alias("low"),
        F.count(F.lit(1)).alias("n_blocks"))


def _fold(heights: Column, start: Column, m: Column, head: Column) -> Column:
    """Requests (c, first, last, n) of a cursor at ``start`` over ascending heights.

    Ends where the next cursor is not due (``>= head``) or a gap of ``m`` or more leaves a request empty.
    """
    none = F.lit(0).cast("bigint")

    def state(c, first, last, n, stop, done):
        return F.struct(c.cast("bigint").alias("c"), first.cast("bigint").alias("first"), last.cast("bigint").alias("last"),
                        n.cast("bigint").alias("n"), stop.alias("stop"), done.cast(f"array<{_REQUEST}>").alias("done"))

    def request(acc):
        return F.array(F.struct(acc["c"], acc["first"], acc["last"], acc["n"]).cast(_REQUEST))

    def step(acc, h):
        closed = F.concat(acc["done"], request(acc))
        following = acc["last"] + 1
        one = F.lit(1).cast("bigint")
        return (F.when(acc["stop"], acc)
                .when(acc["n"] == 0, F.when(h <= acc["c"] + m - 1, state(acc["c"], h, h, one, F.lit(False), acc["done"]))
                      .otherwise(state(acc["c"], none, none, none, F.lit(True), acc["done"])))
                .when(h <= acc["c"] + m - 1, state(acc["c"], acc["first"], h, acc["n"] + 1, F.lit(False), acc["done"]))
                .when((following < head) & (h <= following + m - 1), state(following, h, h, one, F.lit(False), closed))
                .otherwise(state(following, none, none, none, F.lit(True), closed)))

    first = state(start, none, none, none, F.lit(False), F.array())
    return F.aggregate(heights, first, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], request(acc)))
                       .otherwise(acc["done"]))


def _contiguous_requests(live: DataFrame, window: int, mode: str) -> DataFrame:
    """``live`` with ``requests``: arithmetic, for chains without gaps."""
    m, head, low = F.col("max_blocks").cast("bigint"), F.col("head"), F.col("low")
    first_lo = F.greatest(low, head - m + 1)
    newest = F.struct(F.col("next_height").alias("c"), first_lo.alias("first"), head.alias("last"),
                      (head - first_lo + 1).alias("n")).cast(_REQUEST)
    start = F.when(F.col("is_new"), first_lo + 1 if mode == "reference" else head + 1).otherwise(F.col("next_height"))
    room = window - F.col("is_new").cast("int")
    count = F.least(F.ceil((head - start) / m), room).cast("bigint")

    def request(k):
        c = start + k * m
        first, last = F.greatest(c, low), F.least(c + m - 1, head)
        return F.struct(c.alias("c"), first.alias("first"), last.alias("last"), (last - first + 1).alias("n")).cast(_REQUEST)

    # a range that ends below the oldest stored block finds nothing
    found = (count > 0) & (start + m > low)
    rest = F.when(found, F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(count - 1, F.lit(0))), request)
                  ).otherwise(F.array().cast(f"array<{_REQUEST}>"))
    return live.withColumn("requests", F.when(F.col("is_new"), F.concat(F.array(newest), rest)).otherwise(rest))


def _gapped_requests(live: DataFrame, blocks: DataFrame, heads: DataFrame, window: int, mode: str) -> DataFrame:
    """``live`` with ``requests``: folded over the stored heights each job may reach."""
    m, head = F.col("max_blocks").cast("bigint"), F.col("head")
    keys = ["chain_id", "block_height"]
    old = live.where(~F.col("is_new"))
    wanted = old.select("webhook_id", "chain_id", F.explode(F.sequence(
        F.col("next_height"), F.least(F.col("next_height") + window * m - 1, head))).alias("block_height"))
    stored = dv.prune_to_requests(blocks, wanted).select(*keys)
    seen = wanted.join(stored, keys).groupBy("webhook_id").agg(F.array_sort(F.collect_set("block_height")).alias("heights"))
    old = old.join(seen, "webhook_id", "left").withColumn(
        "requests", F.slice(_fold(F.coalesce("heights", F.array().cast("array<bigint>")), F.col("next_height"), m, head),
                            1, window)).drop("heights")
    fresh = live.where(F.col("is_new"))
    top = dv.latest_needed(blocks, heads, dv.batch_bounds(fresh)).groupBy("chain_id").agg(  # one row per chain
        F.array_sort(F.collect_list(F.struct("rank", "block_height"))).alias("newest"))
    heights = F.reverse(F.transform(F.slice("newest", 1, F.col("max_blocks")), lambda r: r["block_height"]))
    fresh = fresh.join(F.broadcast(top), "chain_id", "left").withColumn("heights", heights)
    lowest, highest = F.col("heights")[0], F.element_at("heights", -1)
    first = F.array(F.struct(F.col("next_height"), lowest, highest, F.size("heights").cast("bigint")).cast(_REQUEST))
    start = lowest + 1 if mode == "reference" else highest + 1
    rest = F.when(start < head, _fold(F.filter("heights", lambda h: h >= start), start, m, head)
                  ).otherwise(F.array().cast(f"array<{_REQUEST}>"))
    fresh = fresh.withColumn("requests", F.when(F.size("heights") > 0, F.slice(F.concat(first, rest), 1, window))
                             .otherwise(F.array().cast(f"array<{_REQUEST}>"))).drop("heights", "newest")
    return old.unionByName(fresh)


def request_window(jobs: DataFrame, webhooks: DataFrame, blocks: DataFrame, heads: DataFrame,
                   failures: DataFrame | None = None, window: int = 1, mode: str = "reference",
                   skip_evicted: bool = False, gaps: bool = True) -> DataFrame:
    """The next steps of every job, in order: ``(webhook_id, chain_id, seq, next_height, is_new, outcome,
    first_height, last_height, n_blocks, batch, new_next_height, new_is_new)``.

    ``(webhook_id, next_height, is_new)`` is the message of a step and
    ``new_*`` its cursor if it succeeds; ``seq`` counts a job's steps from 0.
    Outcomes are those of ``relay_step``; only ``deliver`` has further steps.
    ``jobs`` must be due; ``failures`` are those of their current messages.
    A caller that knows all chains to be contiguous passes ``gaps`` False, which makes the plan smaller.
    """
    if mode not in ("reference", "ordered"):
        raise ValueError(f"unknown mode {mode!r}")
    if window < 1:
        raise ValueError("a window holds at least one request")
    bounds = heads if "n_blocks" in heads.columns else heads.join(F.broadcast(
        blocks.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_blocks"))), "chain_id", "left")
    j = dv.jobs_with_webhook(jobs, webhooks).join(
        F.broadcast(bounds.select("chain_id", "head", "low", "n_blocks")), "chain_id", "left")  # one row per chain
    if failures is not None:
        j = j.join(failures, "webhook_id", "left")
    else:
        j = j.withColumn("failures", F.lit(0))
    failed = F.coalesce("failures", F.lit(0))
    skip = (failed >= 1) & (failed >= attempts_allowed("max_retries"))
    j = j.withColumn("outcome", F.when(F.col("dropped"), "dropped").when(skip, "skip"))
    whole = F.coalesce(F.col("n_blocks") == F.col("head") - F.col("low") + 1, F.lit(False))
    live = j.where("outcome is null")
    if gaps:
        planned = _contiguous_requests(live.where(whole), window, mode).unionByName(
            _gapped_requests(live.where(~whole), blocks, heads, window, mode))
    else:
        planned = _contiguous_requests(live, window, mode)
    evicted = ~F.col("is_new") & (F.col("next_height") + F.col("max_blocks") - 1 < F.col("low"))
    still = j.where("outcome is not null").withColumn("requests", F.lit(None).cast(f"array<{_REQUEST}>"))
    steps = (planned.withColumn("outcome", F.when(F.size("requests") > 0, "deliver").when(evicted, "evicted").otherwise("waiting"))
             .unionByName(still)
             .select("webhook_id", "chain_id", "outcome", "low", F.col("next_height").alias("cursor"),
                     F.col("is_new").alias("fresh"), F.col("max_blocks").cast("bigint").alias("batch"),
                     F.posexplode_outer("requests").alias("pos", "r")))
    seq = F.coalesce("pos", F.lit(0))
    is_new = F.col("fresh") & (F.col("seq") == 0)
    deliver = F.col("outcome") == "deliver"
    sent = F.col("r.first") if mode == "reference" else F.col("r.last")
    moved = (F.when(deliver, F.when(is_new, sent).otherwise(F.col("r.last")) + 1)
             .when(F.col("outcome") == "skip", F.col("cursor") + 1)
             .when((F.col("outcome") == "evicted") & F.lit(skip_evicted), F.col("low"))
             .when(F.col("outcome") == "dropped", F.lit(None).cast("bigint")).otherwise(F.col("cursor")))
    return steps.withColumn("seq", seq).select(
        "webhook_id", "chain_id", "seq", F.coalesce("r.c", "cursor").alias("next_height"), is_new.alias("is_new"), "outcome",
        F.col("r.first").alias("first_height"), F.col("r.last").alias("last_height"), F.col("r.n").alias("n_blocks"),
        "batch", moved.alias("new_next_height"),
        F.when(F.col("outcome") == "dropped", F.lit(None).cast("boolean")).when(deliver, F.lit(False))
        .otherwise(is_new).alias("new_is_new"))


def advance(steps: DataFrame, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(moves, failed)`` of a round from the sender's ``answers(webhook_id, seq, delivered)``.

    ``moves`` (webhook_id, chain_id, next_height, is_new): the cursor behind
    each job's last success before its first failure, or behind a skip, a drop
    or an evicted range.  ``failed`` (message, failures = 1): the first failed
    message of each job.  A request without an answer counts as failed, an
    answer behind a failure as not given; without ``answers`` all succeed.
    """
    if answers is None:
        judged = steps.withColumn("delivered", F.lit(True))
    else:
        told = answers.groupBy("webhook_id", "seq").agg(F.max("delivered").alias("delivered"))
        judged = steps.join(told, ["webhook_id", "seq"], "left")
    asked = F.col("outcome") == "deliver"
    fails = asked & ~F.coalesce("delivered", F.lit(False))
    # two aggregates per job, combined before the shuffle, take the place of a running scan
    stop = judged.groupBy("webhook_id").agg(F.min(F.when(fails, F.col("seq"))).alias("stop"))
    if answers is not None:
        judged = judged.join(stop, "webhook_id")
    else:
        judged = judged.withColumn("stop", F.lit(None).cast("int"))
    before = F.col("stop").isNull() | (F.col("seq") < F.col("stop"))
    moved = before & (asked | F.col("outcome").isin("skip", "evicted", "dropped"))
    last = judged.where(moved).groupBy("webhook_id").agg(
        F.max_by(F.struct("chain_id", F.col("new_next_height").alias("next_height"), F.col("new_is_new").alias("is_new")),
                 "seq").alias("c"))
    failed = judged.where(F.col("seq") == F.col("stop")).select(*MESSAGE, F.lit(1).cast("bigint").alias("failures"))
    return last.select("webhook_id", "c.*"), failed
