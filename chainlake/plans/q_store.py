"""Block store queries (§2.1 store, §2.2 reads, §2.3 put/delete, §2.6-2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake import fixtures as fx
from chainlake.operators import store as st
from chainlake.plans.catalog import query

OUT = ["chain_id", "block_height", "block"]


def _ranges(spark, sf_dir, lo_expr: str, hi_expr: str, src=None):
    heads = src if src is not None else fx.chain_heads(spark, sf_dir)
    return heads.select("chain_id", F.expr(lo_expr).alias("start_height"), F.expr(hi_expr).alias("end_height"))


@query("get_blocks", """
    SELECT b.chain_id, b.block_height, b.block FROM block b JOIN chain_head h USING (chain_id)
    WHERE b.block_height BETWEEN h.head // 2 - 50 AND h.head // 2 + 49""", ("block", "chain_head"))
def q_get_blocks(spark, sf_dir):
    ranges = _ranges(spark, sf_dir, "head div 2 - 50", "head div 2 + 49")
    return st.get_block_ranges(fx.blocks(spark, sf_dir), ranges).select(*OUT)


@query("latest_blocks", """
    SELECT chain_id, block_height, block FROM block WHERE chain_id = 'ASIA'
    ORDER BY block_height DESC LIMIT 10""", ("block",))
def q_latest_blocks(spark, sf_dir):
    return st.latest_blocks(fx.blocks(spark, sf_dir), "ASIA", 10).select(*OUT)


@query("earliest_blocks", """
    SELECT chain_id, block_height, block FROM block WHERE chain_id = 'ASIA'
    ORDER BY block_height ASC LIMIT 10""", ("block",))
def q_earliest_blocks(spark, sf_dir):
    return st.earliest_blocks(fx.blocks(spark, sf_dir), "ASIA", 10).select(*OUT)


@query("latest_n_per_chain", """
    SELECT chain_id, block_height, block, rank FROM (
      SELECT chain_id, block_height, block,
             CAST(row_number() OVER (PARTITION BY chain_id ORDER BY block_height DESC) AS INTEGER) AS rank
      FROM block) WHERE rank <= 5""", ("block",))
def q_latest_n_per_chain(spark, sf_dir):
    return st.latest_n_per_chain(fx.blocks(spark, sf_dir), 5).select(*OUT, "rank")


@query("latest_block", """
    SELECT chain_id, max(block_height) AS block_height, arg_max(block, block_height) AS block
    FROM block GROUP BY chain_id""", ("block",))
def q_latest_block(spark, sf_dir):
    return st.latest_block(fx.blocks(spark, sf_dir))


@query("batch_head", """
    SELECT chain_id, max(block_height) AS head FROM hot GROUP BY chain_id""", ("hot",))
def q_batch_head(spark, sf_dir):
    return st.batch_head(fx.hot_tier(spark, sf_dir))


@query("advance_head", """
    SELECT coalesce(c.chain_id, h.chain_id) AS chain_id, greatest(c.head, h.head) AS head
    FROM (SELECT chain_id, max(block_height) AS head FROM hot GROUP BY chain_id) h
    FULL JOIN (SELECT chain_id, max(block_height) AS head FROM cold GROUP BY chain_id) c USING (chain_id)""",
       ("hot", "cold"))
def q_advance_head(spark, sf_dir):
    # previous heads come from the newer tier, the replayed batch is older
    previous = st.batch_head(fx.hot_tier(spark, sf_dir))
    return st.advance_head(previous, fx.cold_tier(spark, sf_dir))


@query("store_counts", "SELECT chain_id, count(*) AS n_blocks FROM block GROUP BY chain_id", ("block",))
def q_store_counts(spark, sf_dir):
    return st.store_counts(fx.blocks(spark, sf_dir))


@query("resume_height", "SELECT chain_id, max(block_height) AS start_height FROM cold GROUP BY chain_id", ("cold",))
def q_resume_height(spark, sf_dir):
    return st.resume_height(fx.cold_tier(spark, sf_dir))


@query("put_blocks", """
    SELECT chain_id, block_height, block FROM cold
    UNION ALL
    SELECT h.chain_id, h.block_height, h.block FROM hot h
    WHERE NOT EXISTS (SELECT 1 FROM cold c WHERE c.chain_id = h.chain_id AND c.block_height = h.block_height)""",
       ("hot", "cold"))
def q_put_blocks(spark, sf_dir):
    hot = fx.hot_tier(spark, sf_dir)
    # the batch is delivered twice: put must be idempotent
    return st.put_blocks(fx.cold_tier(spark, sf_dir), hot.unionByName(hot), "first").select(*OUT)


_V2 = "regexp_replace(block, '}$', ',\"v\":2}')"


@query("put_blocks_last", f"""
    SELECT c.chain_id, c.block_height, c.block FROM cold c
    WHERE NOT EXISTS (SELECT 1 FROM hot h WHERE c.chain_id = h.chain_id AND c.block_height = h.block_height)
    UNION ALL
    SELECT chain_id, block_height, {_V2} AS block FROM hot""", ("hot", "cold"))
def q_put_blocks_last(spark, sf_dir):
    hot = fx.hot_tier(spark, sf_dir).withColumn("block", F.expr(_V2))
    return st.put_blocks(fx.cold_tier(spark, sf_dir), hot.unionByName(hot), "last").select(*OUT)


@query("put_blocks_exact", f"""
    SELECT chain_id, block_height, block FROM cold
    UNION ALL
    SELECT chain_id, block_height, {_V2} AS block FROM hot""", ("hot", "cold"))
def q_put_blocks_exact(spark, sf_dir):
    hot = fx.hot_tier(spark, sf_dir).withColumn("block", F.expr(_V2))
    return st.put_blocks(fx.cold_tier(spark, sf_dir), hot.unionByName(hot), "exact").select(*OUT)


@query("delete_blocks", """
    SELECT b.chain_id, b.block_height, b.block FROM block b
    WHERE NOT EXISTS (SELECT 1 FROM hot h WHERE h.chain_id = b.chain_id AND h.block_height = b.block_height
                      AND h.block = b.block)""", ("block", "hot"))
def q_delete_blocks(spark, sf_dir):
    return st.delete_blocks(fx.blocks(spark, sf_dir), fx.hot_tier(spark, sf_dir)).select(*OUT)


_TIER_RANGE_SQL = """
    WITH rng AS (SELECT chain_id, (head * 3) // 4 AS lo, head - 5 AS hi FROM chain_head),
    h AS (SELECT x.chain_id, x.block_height, x.block FROM hot x JOIN rng USING (chain_id)
          WHERE x.block_height BETWEEN rng.lo AND rng.hi),
    c AS (SELECT x.chain_id, x.block_height, x.block FROM cold x JOIN rng USING (chain_id)
          WHERE x.block_height BETWEEN rng.lo AND rng.hi)
    SELECT * FROM h UNION ALL
    SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.chain_id = c.chain_id AND h.block_height = c.block_height)"""


@query("tiered_get_blocks", _TIER_RANGE_SQL, ("hot", "cold", "chain_head"))
def q_tiered_get_blocks(spark, sf_dir):
    ranges = _ranges(spark, sf_dir, "(head * 3) div 4", "head - 5")
    return st.tiered_get_blocks(fx.hot_tier(spark, sf_dir), fx.cold_tier(spark, sf_dir), ranges).select(*OUT)


@query("tiered_latest_blocks", """
    SELECT chain_id, block_height, block, rank FROM (
      SELECT chain_id, block_height, block,
             CAST(row_number() OVER (PARTITION BY chain_id ORDER BY block_height DESC) AS INTEGER) AS rank
      FROM (SELECT chain_id, block_height, block FROM hot
            UNION ALL
            SELECT c.chain_id, c.block_height, c.block FROM cold c WHERE NOT EXISTS (
              SELECT 1 FROM hot h WHERE h.chain_id = c.chain_id AND h.block_height = c.block_height)))
    WHERE rank <= 7""", ("hot", "cold"))
def q_tiered_latest_blocks(spark, sf_dir):
    return st.tiered_latest_blocks(fx.hot_tier(spark, sf_dir), fx.cold_tier(spark, sf_dir), 7).select(*OUT, "rank")


@query("tiered_latest_block", """
    SELECT chain_id, block_height, block, tier FROM (
      SELECT chain_id, max(block_height) AS block_height, arg_max(block, block_height) AS block, 'hot' AS tier
      FROM hot GROUP BY chain_id
      UNION ALL
      SELECT chain_id, max(block_height), arg_max(block, block_height), 'cold' FROM cold c
      WHERE NOT EXISTS (SELECT 1 FROM hot h WHERE h.chain_id = c.chain_id) GROUP BY chain_id)""",
       ("hot", "cold"))
def q_tiered_latest_block(spark, sf_dir):
    return st.tiered_latest_block(fx.hot_tier(spark, sf_dir), fx.cold_tier(spark, sf_dir))


@query("flush_hot_to_cold", """
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
def q_flush_hot_to_cold(spark, sf_dir):
    new_hot, new_cold = st.flush_hot_to_cold(fx.hot_tier(spark, sf_dir), fx.cold_tier(spark, sf_dir), 100)
    return (new_hot.withColumn("tier", F.lit("hot"))
            .unionByName(new_cold.withColumn("tier", F.lit("cold"))))


@query("range_completeness", """
    WITH r AS (
      SELECT chain_id, (head * 4) // 5 AS start_height, head AS end_height, 0 AS i FROM chain_head
      UNION ALL
      SELECT chain_id, (head * 3) // 4, head, 1 FROM chain_head)
    SELECT r.chain_id, r.start_height, r.end_height, count(DISTINCT x.block_height) AS n_found,
           count(DISTINCT x.block_height) = greatest(r.end_height - r.start_height + 1, 0) AS complete
    FROM r LEFT JOIN hot x ON x.chain_id = r.chain_id AND x.block_height BETWEEN r.start_height AND r.end_height
    GROUP BY r.chain_id, r.start_height, r.end_height, r.i""", ("hot", "chain_head"))
def q_range_completeness(spark, sf_dir):
    heads = fx.chain_heads(spark, sf_dir)
    r0 = heads.select("chain_id", F.expr("(head * 4) div 5").alias("start_height"), F.col("head").alias("end_height"),
                      F.lit(0).alias("i"))
    r1 = heads.select("chain_id", F.expr("(head * 3) div 4").alias("start_height"), F.col("head").alias("end_height"),
                      F.lit(1).alias("i"))
    ranges = r0.unionByName(r1).withColumn("range_id", F.xxhash64("chain_id", "i"))
    return (st.range_completeness(fx.hot_tier(spark, sf_dir), ranges.drop("i"))
            .select("chain_id", "start_height", "end_height", "n_found", "complete"))
