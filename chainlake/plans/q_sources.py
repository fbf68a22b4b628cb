"""Source, sink and format queries (§2.1) and scalar keys (§2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake import fixtures as fx
from chainlake.fixtures import SQL_VIEWS
from chainlake.functions import columns as C
from chainlake.operators import quality as qa
from chainlake.plans.catalog import query
from chainlake.sources import payloads as pl


def _evm_document_sql() -> str:
    """The whole block document, each key from the raw payload."""
    text = lambda k: f"json_extract_string(raw, '$.{k}')"
    parts = []
    for f in pl.EVM_KEYS.fields:
        kind = f.dataType.simpleString()
        parts.append(f"'{f.name}': " + (text(f.name) if kind == "string" else f"CAST({text(f.name)} AS "
                     + ("BIGINT" if kind == "bigint" else "UBIGINT") + ")"))
    parts += [f"'{k}': json_extract(raw, '$.{k}')" for k in pl.EVM_RAW_KEYS]
    return f"CAST(to_json({{{', '.join(parts)}}}) AS VARCHAR)"


SQL_VIEWS["evm_block"] = (("raw_evm",), f"""
    SELECT chain_id, CAST(json_extract(raw, '$.number') AS BIGINT) AS block_height, raw,
           {_evm_document_sql()} AS block FROM raw_evm""")


@query("normalize_evm_blocks", """
    SELECT chain_id, block_height,
           json_extract_string(raw, '$.hash') AS hash, json_extract_string(raw, '$.parentHash') AS parent_hash,
           CAST(json_extract(raw, '$.time') AS BIGINT) AS time, CAST(json_extract(raw, '$.gasUsed') AS BIGINT) AS gas_used,
           CAST(json_extract(raw, '$.gasLimit') AS BIGINT) AS gas_limit, json_extract_string(raw, '$.coinbase') AS coinbase,
           CAST(json_array_length(json_extract(raw, '$.transactions')) AS BIGINT) AS n_transactions, block
    FROM evm_block""", ("evm_block",))
def q_normalize_evm_blocks(spark, sf_dir):
    return pl.normalize_evm_blocks(fx.raw_evm(spark, sf_dir))


@query("normalize_flow_blocks", """
    SELECT chain_id, CAST(json_extract(raw, '$.height') AS BIGINT) AS block_height, json_extract_string(raw, '$.id') AS id,
           json_extract_string(raw, '$.parent_id') AS parent_id,
           CAST(strptime(json_extract_string(raw, '$.timestamp'), '%Y-%m-%dT%H:%M:%SZ') AS TIMESTAMP) AS ts,
           CAST(json_extract(raw, '$.status') AS INTEGER) AS status,
           array_to_string(CAST(json_extract_string(raw, '$.collection_ids[*].collection_id') AS VARCHAR[]), ',') AS collection_ids,
           CAST(json_array_length(json_extract(raw, '$.seals')) AS BIGINT) AS n_seals, raw AS block
    FROM raw_flow""", ("raw_flow",))  # the fixture's payload has every key in document order
def q_normalize_flow_blocks(spark, sf_dir):
    return pl.normalize_flow_blocks(fx.raw_flow(spark, sf_dir))


@query("explode_transactions", """
    SELECT chain_id, CAST(json_extract(raw, '$.number') AS BIGINT) AS block_height, CAST(r.i AS BIGINT) AS tx_index,
           json_extract_string(raw, '$.transactions[' || r.i || '].to') AS to_address,
           json_extract_string(raw, '$.transactions[' || r.i || '].from') AS from_address,
           json_extract_string(raw, '$.transactions[' || r.i || '].nonce') AS nonce,
           json_extract_string(raw, '$.transactions[' || r.i || '].value') AS value
    FROM raw_evm, range(CAST(json_array_length(json_extract(raw, '$.transactions')) AS BIGINT)) r(i)""",
       ("raw_evm",))
def q_explode_transactions(spark, sf_dir):
    return pl.explode_transactions(fx.raw_evm(spark, sf_dir))


SQL_VIEWS["message"] = (("block",), """
    SELECT chain_id, seq AS msg_id,
           CASE WHEN seq % 97 = 0 THEN '{"Height":' || CAST(block_height AS VARCHAR)
                WHEN seq % 89 = 0 THEN CAST(to_json({'Height': block_height}) AS VARCHAR)
                ELSE CAST(to_json({'Height': block_height, 'Block': block}) AS VARCHAR) END AS data
    FROM block""")


def _messages(spark, sf_dir):
    m = pl.append_message(fx.blocks(spark, sf_dir))
    seq = F.col("msg_id")
    broken = F.concat(F.lit('{"Height":'), F.get_json_object("data", "$.Height"))
    no_block = F.to_json(F.struct(F.get_json_object("data", "$.Height").cast("bigint").alias("Height")))
    return m.withColumn("data", F.when(F.pmod(seq, F.lit(97)) == 0, broken)
                        .when(F.pmod(seq, F.lit(89)) == 0, no_block).otherwise(F.col("data")))


@query("append_message", """
    SELECT chain_id, seq AS msg_id, CAST(to_json({'Height': block_height, 'Block': block}) AS VARCHAR) AS data FROM block""",
       ("block",))
def q_append_message(spark, sf_dir):
    return pl.append_message(fx.blocks(spark, sf_dir))


@query("parse_message", """
    SELECT chain_id, msg_id, CAST(try(json_extract(data, '$.Height')) AS BIGINT) AS Height,
           try(json_extract_string(data, '$.Block')) AS Block,
           CASE WHEN try(json_extract(data, '$.Block')) IS NULL OR try(json_extract(data, '$.Height')) IS NULL
                THEN data END AS _corrupt
    FROM message""", ("message",))
def q_parse_message(spark, sf_dir):
    return pl.parse_message(_messages(spark, sf_dir))


SQL_VIEWS["doc"] = (("block",), """
    SELECT seq,
      CASE WHEN seq % 11 = 0 THEN '{"chain_id":"' || chain_id || '","block_height":"x' || CAST(block_height AS VARCHAR)
                                  || '","block":' || to_json(block) || '}'
           WHEN seq % 13 = 0 THEN '{"chain_id":"' || chain_id || '","block_height":' || CAST(block_height AS VARCHAR)
                                  || ',"block":' || to_json(block) || ',"extra":1}'
           WHEN seq % 17 = 0 THEN '{"chain_id":"' || chain_id || '","block_height":' || CAST(block_height AS VARCHAR) || '}'
           WHEN seq % 19 = 0 THEN '{"chain_id":"' || chain_id || '","block_height":"' || CAST(block_height AS VARCHAR)
                                  || '","block":' || to_json(block) || '}'
           WHEN seq % 23 = 0 THEN '{"chain_id":5,"block_height":' || CAST(block_height AS VARCHAR)
                                  || ',"block":' || to_json(block) || '}'
           ELSE '{"chain_id":"' || chain_id || '","block_height":' || CAST(block_height AS VARCHAR)
                || ',"block":' || to_json(block) || '}' END AS doc
    FROM block""")


def _docs(spark, sf_dir):
    b = fx.blocks(spark, sf_dir)
    s = F.col("seq")
    head = F.concat(F.lit('{"chain_id":"'), F.col("chain_id"), F.lit('","block_height":'))
    h = F.col("block_height").cast("string")
    blk = F.to_json(F.array("block")).substr(F.lit(2), F.length(F.to_json(F.array("block"))) - 2)
    doc = (F.when(F.pmod(s, F.lit(11)) == 0, F.concat(head, F.lit('"x'), h, F.lit('","block":'), blk, F.lit("}")))
            .when(F.pmod(s, F.lit(13)) == 0, F.concat(head, h, F.lit(',"block":'), blk, F.lit(',"extra":1}')))
            .when(F.pmod(s, F.lit(17)) == 0, F.concat(head, h, F.lit("}")))
            .when(F.pmod(s, F.lit(19)) == 0, F.concat(head, F.lit('"'), h, F.lit('","block":'), blk, F.lit("}")))
            .when(F.pmod(s, F.lit(23)) == 0, F.concat(F.lit('{"chain_id":5,"block_height":'), h, F.lit(',"block":'), blk,
                                                      F.lit("}")))
            .otherwise(F.concat(head, h, F.lit(',"block":'), blk, F.lit("}"))))
    return b.select("seq", doc.alias("doc"))


@query("enforce_schema", """
    SELECT seq, CASE WHEN json_type(doc, '$.chain_id') = 'VARCHAR' THEN json_extract_string(doc, '$.chain_id') END AS chain_id,
           CASE WHEN json_type(doc, '$.block_height') IN ('BIGINT', 'UBIGINT')
                THEN TRY_CAST(json_extract_string(doc, '$.block_height') AS BIGINT) END AS block_height,
           json_extract_string(doc, '$.block') AS block,
           CASE WHEN seq % 11 = 0 THEN 'bad type for block_height'
                WHEN seq % 13 = 0 THEN 'extra properties: extra'
                WHEN seq % 17 = 0 THEN 'missing field block'
                WHEN seq % 19 = 0 THEN 'bad type for block_height'
                WHEN seq % 23 = 0 THEN 'bad type for chain_id' END AS reason
    FROM doc""", ("doc",))
def q_enforce_schema(spark, sf_dir):
    return pl.enforce_schema(_docs(spark, sf_dir))


@query("list_blockchains", "SELECT * FROM chain", ("chain",))
def q_list_blockchains(spark, sf_dir):
    return fx.chains(spark, sf_dir)


@query("backfill_range", """
    SELECT b.chain_id, b.block_height, b.block FROM block b
    JOIN (SELECT chain_id, max(block_height) AS s FROM cold GROUP BY chain_id) r USING (chain_id)
    JOIN chain_head h USING (chain_id) WHERE b.block_height BETWEEN r.s AND h.head""",
       ("block", "cold", "chain_head"))
def q_backfill_range(spark, sf_dir):
    from chainlake.operators.store import resume_height
    starts = resume_height(fx.cold_tier(spark, sf_dir))
    return qa.backfill_range(fx.chain_heads(spark, sf_dir), starts, fx.blocks(spark, sf_dir))


SQL_VIEWS["received"] = (("block",), "SELECT * FROM block WHERE block NOT LIKE '%\"status\":\"P\"%'")


def _received(spark, sf_dir):
    return fx.blocks(spark, sf_dir).where(~F.col("block").contains('"status":"P"'))


@query("refetch_failed", """
    SELECT h.chain_id, CAST(g.block_height AS BIGINT) AS block_height
    FROM chain_head h, range(h.low, h.head + 1) g(block_height)
    WHERE NOT EXISTS (SELECT 1 FROM received r WHERE r.chain_id = h.chain_id AND r.block_height = g.block_height)""",
       ("chain_head", "received"))
def q_refetch_failed(spark, sf_dir):
    expected = qa.expected_heights(fx.chain_heads(spark, sf_dir))
    return qa.refetch_failed(expected, _received(spark, sf_dir))


# --- scalar keys ---------------------------------------------------------------

@query("shard_key", """
    SELECT webhook_id, 'chainlake:{s' || CAST(shard_id AS VARCHAR) || '}:pending' AS pending_key,
           'chainlake:{s' || CAST(shard_id AS VARCHAR) || '}:jobs' AS stream_key FROM job""", ("job",))
def q_shard_key(spark, sf_dir):
    j = fx.jobs(spark, sf_dir)
    return j.select("webhook_id", C.shard_key("chainlake", "shard_id", "pending").alias("pending_key"),
                    C.shard_key("chainlake", "shard_id", "jobs").alias("stream_key"))


@query("assign_shard", """
    SELECT w.id, CAST(CAST(w.id AS BIGINT) % c.shard_count AS INTEGER) AS shard_id
    FROM webhook w JOIN chain c ON c.id = w.blockchain_id""", ("webhook", "chain"))
def q_assign_shard(spark, sf_dir):
    c = fx.chains(spark, sf_dir).select(F.col("id").alias("blockchain_id"), "shard_count")
    w = fx.webhooks(spark, sf_dir).join(c, "blockchain_id")
    return w.select("id", C.assign_shard("id", F.col("shard_count"), method="mod").alias("shard_id"))


@query("next_height", """
    SELECT webhook_id, max(block_height) + 1 AS next_height FROM round_rows WHERE NOT is_new GROUP BY webhook_id""",
       ("round_rows",))
def q_next_height(spark, sf_dir):
    from chainlake.plans.q_delivery import _live_webhooks
    from chainlake.operators import delivery as dv
    j = dv.jobs_with_webhook(fx.jobs(spark, sf_dir).where(~F.col("is_new")), _live_webhooks(spark, sf_dir))
    rows = dv.jobs_with_blocks(j.where(~F.col("dropped")), fx.blocks(spark, sf_dir))
    return rows.groupBy("webhook_id").agg(C.next_height(F.max("block_height")).alias("next_height"))


@query("attempts_allowed", """
    SELECT id, max_retries, greatest(1, max_retries - 1) AS attempts_allowed FROM webhook""", ("webhook",))
def q_attempts_allowed(spark, sf_dir):
    return fx.webhooks(spark, sf_dir).select("id", "max_retries", C.attempts_allowed("max_retries").alias("attempts_allowed"))


@query("backoff_schedule", """
    SELECT w.id, CAST(a.attempt AS INTEGER) AS attempt,
           CASE WHEN a.attempt = 0 THEN 0.0
                WHEN a.attempt = 1 THEN 500.0 + (CAST(w.id AS BIGINT) * 31 + a.attempt * 7919) % 100
                ELSE pow(500.0, a.attempt) + (CAST(w.id AS BIGINT) * 31 + a.attempt * 7919) % 100 END AS wait_ms
    FROM webhook w, range(CAST(w.max_retries AS BIGINT)) a(attempt)""", ("webhook",))
def q_backoff_schedule(spark, sf_dir):
    w = fx.webhooks(spark, sf_dir).where(F.col("max_retries") > 0)
    a = w.select("id", F.explode(F.sequence(F.lit(0), F.col("max_retries") - 1)).alias("attempt"))
    return a.select("id", "attempt", C.backoff_wait_ms("attempt", 500, 100, F.col("id").cast("bigint")).alias("wait_ms"))


@query("block_field", """
    SELECT chain_id, block_height, CAST(json_extract(block, '$.height') AS BIGINT) AS f_height,
           json_extract_string(block, '$.timestamp') AS f_timestamp FROM block""", ("block",))
def q_block_field(spark, sf_dir):
    b = fx.blocks(spark, sf_dir)
    return b.select("chain_id", "block_height", C.block_field("block", "height").cast("bigint").alias("f_height"),
                    C.block_field("block", "timestamp").alias("f_timestamp"))
