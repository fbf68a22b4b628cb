"""Exact delivery plan for chains whose stored heights have gaps.

A request from cursor ``s`` returns the stored heights in ``[s, s+m-1]``
and the next cursor is the largest of them + 1.  After the first request the
cursor is therefore always ``h + 1`` for a stored height ``h``: the walk is a
path in a forest over stored heights, ``h -> p(h) = max(H ∩ (h, h+m])``,
which ends when ``h + 1`` is no longer below the head or ``(h, h+m]`` holds
no block.

* ``p(h)`` for every m needs only the next ``m <= 10`` heights by rank: one
  bounded equi-join on ``(chain, rank + k)``.
* Depths (how many requests a state still yields) come from pointer jumping:
  ``log2(longest path)`` rounds of one self-join each, every round
  checkpointed into ``spark.checkpoint.dir``; the round tables are kept as
  jump tables.
* Only heights at or above the lowest cursor of a (chain, m) can be on a path,
  so states below it are never built.
* Jobs that stand at the same height with the same m share their path: it is
  split top-down once with the jump tables and meets the jobs at the end, so
  the work is ``distinct paths x log + output`` and no chain or webhook is
  ever a single task.

The driver loop runs over *rounds* (a logarithmic number), never over jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlake.functions.columns import div_floor
from chainlake.operators.delivery import latest_needed
from chainlake.operators.quality import bucketed_row_number
from chainlake.session import ensure_checkpoint_dir

KEYS = ["chain_id", "m", "h"]


def _from_lowest(blocks: DataFrame, lowest: DataFrame) -> DataFrame:
    """Distinct ``(chain_id, block_height)`` at or above ``lowest(chain_id, low)``, one row per chain."""
    return (blocks.select("chain_id", "block_height").join(F.broadcast(lowest), "chain_id")
            .where(F.col("block_height") >= F.col("low")).select("chain_id", "block_height").distinct())


def _states(blocks: DataFrame, needed_m: DataFrame, heads: DataFrame, inclusive: bool, bucket: int) -> DataFrame:
    """``(chain_id, m, h, r, succ, p, rp, terminal)`` for every stored height from
    ``low`` on and every batch size of ``needed_m(chain_id, m, low)``."""
    h = _from_lowest(blocks, needed_m.groupBy("chain_id").agg(F.min("low").alias("low"))).withColumnRenamed("block_height", "h")
    h = bucketed_row_number(h, ["chain_id"], ["h"], div_floor(F.col("h"), bucket), "r")
    # at most m distinct heights lie in (h, h + m], so the m-th successor bounds the search
    most = F.broadcast(needed_m.groupBy("chain_id").agg(F.max("m").alias("most")))  # one row per chain
    nxt = (h.join(most, "chain_id")
           .select("chain_id", "h", "r", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("most"))).alias("k"))
           .withColumn("rk", F.col("r") + F.col("k"))
           .join(h.select("chain_id", F.col("r").alias("rk"), F.col("h").alias("hk")), ["chain_id", "rk"]))
    succ = nxt.where("k = 1").select("chain_id", "h", F.col("hk").alias("succ"))
    asked = (F.col("h") >= F.col("low")) & (F.col("hk") <= F.col("h") + F.col("m"))
    reach = (nxt.join(F.broadcast(needed_m), "chain_id").where(asked)
             .groupBy("chain_id", "m", "h").agg(F.max(F.struct("hk", "rk")).alias("pp")))
    # heights without any successor (the head) still are states
    st = (h.join(F.broadcast(needed_m), "chain_id").where(F.col("h") >= F.col("low")).join(reach, ["chain_id", "m", "h"], "left")
          .join(succ, ["chain_id", "h"], "left")
          .join(F.broadcast(heads.select("chain_id", "head")), "chain_id"))  # one row per chain
    last_ok = (F.col("h") + 1 <= F.col("head")) if inclusive else (F.col("h") + 1 < F.col("head"))
    return st.select("chain_id", "m", "h", "r", "succ", F.col("pp.hk").alias("p"), F.col("pp.rk").alias("rp"),
                     (~last_ok | F.col("pp").isNull()).alias("terminal"))


def _checkpoint(df: DataFrame) -> DataFrame:
    return df.checkpoint(eager=True)


def delivery_plan_gapped(jobs: DataFrame, webhooks: DataFrame, blocks: DataFrame, mode: str = "reference",
                         inclusive: bool = False, bucket: int = 1_000_000) -> DataFrame:
    """``(webhook_id, request_no, first_height, last_height, n_blocks)`` of
    every request until nothing is due -- exact for any set of heights."""
    if mode not in ("reference", "ordered"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = jobs.sparkSession
    ensure_checkpoint_dir(spark)
    heads = _checkpoint(blocks.groupBy("chain_id").agg(F.max("block_height").alias("head")))
    j = (jobs.join(webhooks.select(F.col("id").alias("webhook_id"), F.col("max_blocks").cast("bigint").alias("m")),
                   "webhook_id")
         .join(F.broadcast(heads), "chain_id"))
    due = (F.col("s") <= F.col("head")) if inclusive else (F.col("s") < F.col("head"))

    # new jobs: the latest m stored blocks first, then the cursor of the mode
    new = j.where(F.col("is_new"))
    stored = blocks if "block" in blocks.columns else blocks.withColumn("block", F.lit(None).cast("string"))
    top = latest_needed(stored, heads, new.groupBy("chain_id").agg(F.max("m").alias("n")))
    first = (new.join(top.select("chain_id", "block_height", "rank"), "chain_id")
             .where(F.col("rank") <= F.col("m"))
             .groupBy("webhook_id").agg(F.min("block_height").alias("first_height"),
                                        F.max("block_height").alias("last_height"),
                                        F.count(F.lit(1)).alias("n_blocks")))
    after = (F.col("first_height") + 1) if mode == "reference" else (F.col("last_height") + 1)
    first = _checkpoint(first)
    starts = (j.join(first, "webhook_id", "left").where(~F.col("is_new") | F.col("first_height").isNotNull())
              .select("webhook_id", "chain_id", "m", "head",
                      F.when(F.col("is_new"), after).otherwise(F.col("next_height")).alias("s"),
                      F.when(F.col("is_new"), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("k0"))
              .where(due))
    starts = _checkpoint(starts.select("webhook_id", "chain_id", "m", "s", "k0"))
    # first step from an arbitrary cursor: at most m heights, equi-join
    near = _from_lowest(blocks, starts.groupBy("chain_id").agg(F.min("s").alias("low")))
    rng = (starts.select("chain_id", "m", "s").distinct()
           .select("*", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("m") - 1)).alias("block_height"))
           .join(near, ["chain_id", "block_height"])
           .groupBy("chain_id", "m", "s")
           .agg(F.min("block_height").alias("first_height"), F.max("block_height").alias("last_height"),
                F.count(F.lit(1)).alias("n_blocks")))
    step1 = (starts.join(rng, ["chain_id", "m", "s"]).groupBy("webhook_id", "chain_id", "m", "k0")
             .agg(F.min("first_height").alias("first_height"), F.max("last_height").alias("last_height"),
                  F.sum("n_blocks").alias("n_blocks")))
    step1 = _checkpoint(step1)

    # paths begin at the last heights of the first steps: one per distinct (chain, m, height)
    begins = _checkpoint(step1.select("chain_id", "m", F.col("last_height").alias("node")).distinct())
    needed_m = _checkpoint(begins.groupBy("chain_id", "m").agg(F.min("node").alias("low")))
    states = _checkpoint(_states(blocks, needed_m, heads, inclusive, bucket))
    # pointer jumping: level 0 = one step; level k = 2^k steps (or up to the end)
    level = _checkpoint(states.select(*KEYS, F.when(F.col("terminal"), F.col("h")).otherwise(F.col("p")).alias("anc"),
                                      F.when(F.col("terminal"), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("d")))
    levels = [level]
    # level k holds d = min(2^k, depth); once the largest d is below 2^k every
    # depth is complete (one aggregate per round, no comparison join)
    while (levels[-1].agg(F.max("d")).first()[0] or 0) >= (1 << (len(levels) - 1)):
        nxt = (level.alias("a").join(level.alias("b"),
                                     (F.col("a.chain_id") == F.col("b.chain_id")) & (F.col("a.m") == F.col("b.m")) &
                                     (F.col("a.anc") == F.col("b.h")))
               .select(F.col("a.chain_id").alias("chain_id"), F.col("a.m").alias("m"), F.col("a.h").alias("h"),
                       F.col("b.anc").alias("anc"), (F.col("a.d") + F.col("b.d")).alias("d")))
        level = _checkpoint(nxt)
        levels.append(level)
    depth = level.select(*KEYS, F.col("d").alias("depth"))

    # paths: from the state after the first step, split top-down by the jump tables
    seg = (begins.join(depth.withColumnRenamed("h", "node"), ["chain_id", "m", "node"])
           .select("chain_id", "m", F.col("node").alias("begin"), "node", F.lit(0).cast("bigint").alias("off"),
                   F.col("depth").alias("len"))
           .where(F.col("len") > 0))
    for k in range(len(levels) - 1, 0, -1):
        size = 1 << (k - 1)  # pieces longer than this are split with the 2^(k-1) jump table
        jump = levels[k - 1].select(F.col("chain_id"), F.col("m"), F.col("h").alias("node"), F.col("anc").alias("to"))
        whole = F.array(F.struct("node", "off", "len"))
        halves = F.array(F.struct("node", "off", F.lit(size).cast("bigint").alias("len")),
                         F.struct(F.col("to").alias("node"), (F.col("off") + size).alias("off"),
                                  (F.col("len") - size).alias("len")))
        # one pass over the pieces: a union of parts would double the partitions in every round
        seg = _checkpoint(seg.join(jump, ["chain_id", "m", "node"])
                          .select("chain_id", "m", "begin",
                                  F.explode(F.when(F.col("len") > size, halves).otherwise(whole)).alias("piece"))
                          .select("chain_id", "m", "begin", "piece.*"))
    edges = (seg.join(states.select("chain_id", "m", F.col("h").alias("node"), "r", "succ", "p", "rp"),
                      ["chain_id", "m", "node"])
             .select("chain_id", "m", F.col("begin").alias("last_height"), "off", F.col("succ").alias("succ_height"),
                     "p", (F.col("rp") - F.col("r")).alias("n")))
    path_reqs = (step1.select("webhook_id", "chain_id", "m", "k0", "last_height").join(edges, ["chain_id", "m", "last_height"])
                 .select("webhook_id", (F.col("k0") + 1 + F.col("off")).alias("request_no"),
                         F.col("succ_height").alias("first_height"), F.col("p").alias("last_height"),
                         F.col("n").alias("n_blocks")))
    step_reqs = step1.select("webhook_id", F.col("k0").alias("request_no"), "first_height", "last_height", "n_blocks")
    first_reqs = first.select("webhook_id", F.lit(0).cast("bigint").alias("request_no"), "first_height",
                              "last_height", "n_blocks")
    return first_reqs.unionByName(step_reqs).unionByName(path_reqs)


def plan_deliveries(jobs: DataFrame, webhooks: DataFrame, blocks: DataFrame, mode: str = "reference",
                    inclusive: bool = False) -> DataFrame:
    """Delivery plan for any store: chains whose heights are contiguous
    (``count == head - low + 1``, one aggregate per chain) use the closed
    form, the others the exact gapped plan."""
    from chainlake.operators.delivery import delivery_plan
    stats = (blocks.groupBy("chain_id")
             .agg(F.max("block_height").alias("head"), F.min("block_height").alias("low"),
                  F.countDistinct("block_height").alias("n")))
    ensure_checkpoint_dir(jobs.sparkSession)
    contiguous = _checkpoint(stats.where(F.col("n") == F.col("head") - F.col("low") + 1))  # many scans read these few rows
    chains = F.broadcast(contiguous.select("chain_id"))  # one row per chain
    closed = delivery_plan(jobs.join(chains, "chain_id", "left_semi"), webhooks,
                           contiguous.select("chain_id", "head", "low"), mode=mode, inclusive=inclusive)
    gappy_jobs = jobs.join(chains, "chain_id", "left_anti")
    gappy_blocks = blocks.join(chains, "chain_id", "left_anti")
    return closed.unionByName(delivery_plan_gapped(gappy_jobs, webhooks, gappy_blocks, mode=mode,
                                                   inclusive=inclusive))
