"""Views of the driver tables in the engine's data model.

Every view exists twice: as a Spark DataFrame (what the engine runs) and as
DuckDB SQL (the oracle).  Both use only integer/string arithmetic so that
their results can be compared value by value.

Mapping (fixed by this repository, not by the data generator):

* ``chain``      <- region:   id = r_name, four shards per chain
* ``block``      <- orders:   chain = region (o_orderkey % 5),
                              height = o_orderkey div 5 (contiguous per chain),
                              seq = o_orderkey (arrival order), JSON payload
* ``webhook``    <- customer: id = c_custkey, owner = c_nationkey,
                              chain = region (c_custkey % 5) ...
* ``job``        <- webhook + chain heads: one cursor per webhook
* ``attempt``    <- events:   delivery attempts, webhook = user_id
* ``billing_event`` <- events: raw billing-provider JSON
* ``session``    <- latest order per customer: checkout session + subscription
* ``raw_evm`` / ``raw_flow`` <- orders + lineitem: chain-native payloads
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture mapping.
EPOCH = "2024-01-01 00:00:00"
SHARDS_PER_CHAIN = 4
CHAIN_COUNT = 5
WEI_ZEROS = "0" * 18
NONCE_BASE = 2 ** 63  # block nonces are unsigned 64-bit numbers


EVM_HASH_KEYS = ("root", "txHash", "receiptHash", "uncleHash", "mixDigest", "bloom")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c) -> Column:
    """Cast to string (shorthand for concat building)."""
    return (c if isinstance(c, Column) else F.col(c)).cast("string")


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select(
        F.col("r_name").alias("id"),
        F.col("r_regionkey").cast("bigint").alias("chain_no"),
        F.lit(SHARDS_PER_CHAIN).cast("int").alias("shard_count"),
        F.lit(EPOCH).cast("timestamp_ntz").alias("created_at"),
        F.concat(F.lit("rpc://"), F.lower(F.regexp_replace("r_name", " ", "-"))).alias("url"),
    )


def _chain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    # region is a dimension of a handful of rows: the planner broadcasts it
    # from its file statistics (autoBroadcastJoinThreshold is the size check).
    return chains(spark, sf_dir).select(F.col("chain_no"), F.col("id").alias("chain_id"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(chain_id, block_height, seq, ts, block)`` -- the block store."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    height = F.expr("o_orderkey div 5")
    payload = F.concat(
        F.lit('{"height":'), _s(height),
        F.lit(',"timestamp":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit('","miner":'), _s("o_custkey"),
        F.lit(',"status":"'), F.col("o_orderstatus"),
        F.lit('","priority":"'), F.col("o_orderpriority"), F.lit('"}'),
    )
    return (o.join(_chain_names(spark, sf_dir), F.pmod(o.o_orderkey, F.lit(CHAIN_COUNT)) == F.col("chain_no"))
             .select(F.col("chain_id"), height.alias("block_height"),
                     F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("ts"),
                     payload.alias("block")))


def chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chain: ``(chain_id, head, low, n_blocks)``."""
    return (blocks(spark, sf_dir).groupBy("chain_id")
            .agg(F.max("block_height").alias("head"), F.min("block_height").alias("low"),
                 F.count(F.lit(1)).alias("n_blocks")))


def webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return (c.join(_chain_names(spark, sf_dir), F.pmod(k, F.lit(CHAIN_COUNT)) == F.col("chain_no"))
             .select(
                 _s(k).alias("id"),
                 F.expr(f"timestampadd(MINUTE, c_custkey div 3, TIMESTAMP_NTZ'{EPOCH}')").alias("created_at"),
                 F.when(F.col("c_acctbal") >= 0, 1).otherwise(0).cast("int").alias("is_active"),
                 F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".example.com/hooks/"), _s(k)).alias("url"),
                 (F.pmod(k, F.lit(10)) + 1).cast("int").alias("max_blocks"),
                 F.pmod(k, F.lit(11)).cast("int").alias("max_retries"),
                 F.pmod(k * 37, F.lit(10001)).cast("int").alias("timeout_ms"),
                 _s("c_nationkey").alias("customer_id"),
                 F.col("chain_id").alias("blockchain_id"),
                 F.pmod(F.expr("c_custkey div 5"), F.lit(SHARDS_PER_CHAIN)).cast("int").alias("shard_id"),
             ))


def webhook_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw create-requests (some invalid) for the validation operators."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    url = (F.when(F.pmod(k, F.lit(13)) == 0, F.lit("not a url"))
            .when(F.pmod(k, F.lit(17)) == 0, F.lit(""))
            .otherwise(F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".example.com/in/"), _s(k))))
    return (c.join(_chain_names(spark, sf_dir), F.pmod(k, F.lit(CHAIN_COUNT)) == F.col("chain_no"))
             .select(
                 _s(k).alias("request_id"),
                 url.alias("url"),
                 F.pmod(k, F.lit(12)).cast("int").alias("max_blocks"),
                 F.pmod(F.col("c_nationkey"), F.lit(12)).cast("int").alias("max_retries"),
                 F.pmod(k * 37, F.lit(12001)).cast("int").alias("timeout_ms"),
                 F.when(F.pmod(k, F.lit(19)) == 0, F.lit("UNKNOWN CHAIN")).otherwise(F.col("chain_id")).alias("blockchain_id"),
                 _s("c_nationkey").alias("customer_id"),
             ))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cursor per webhook: ``(webhook_id, chain_id, shard_id, next_height, is_new)``."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    heads = F.broadcast(chain_heads(spark, sf_dir).select("chain_id", "head"))  # one row per chain
    return (c.join(_chain_names(spark, sf_dir), F.pmod(k, F.lit(CHAIN_COUNT)) == F.col("chain_no"))
             .join(heads, "chain_id")
             .select(
                 _s(k).alias("webhook_id"),
                 F.col("chain_id"),
                 F.pmod(F.expr("c_custkey div 5"), F.lit(SHARDS_PER_CHAIN)).cast("int").alias("shard_id"),
                 F.greatest(F.lit(0).cast("bigint"), F.col("head") + 1 - F.pmod(k * 7, F.lit(200))).alias("next_height"),
                 (F.pmod(k, F.lit(4)) == 0).alias("is_new"),
             ))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery attempt log ``(attempt_id, ts, webhook_id, msg_id, failed)``."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("attempt_id"),
        F.col("ts"),
        _s("user_id").alias("webhook_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("msg_id"),
        (F.col("event_type") == "error").alias("failed"),
    )


def billing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw billing-provider events ``(event_id, ts, payload)``."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    u = _s("user_id")
    etype = (F.when(F.col("event_type") == "signup", "customer.subscription.created")
              .when(F.col("event_type") == "purchase", "invoice.paid")
              .when(F.col("event_type") == "error", "customer.subscription.deleted")
              .when(F.col("event_type") == "view", "invoice.upcoming")
              .when(F.pmod(k, F.lit(3)) == 0, "customer.deleted")
              .when(F.pmod(k, F.lit(3)) == 1, "checkout.session.completed")
              .otherwise("product.created"))
    kind = F.pmod(k, F.lit(10))  # 0: no user; 5: wrong type or expanded; 7: expanded without a user
    named = F.concat(F.lit('{"userId":"'), u, F.lit('"}'))
    meta = (F.when(kind == 0, F.lit("{}")).when(kind == 5, F.concat(F.lit('{"userId":'), u, F.lit("}")))
             .otherwise(named))
    sub_object = F.concat(F.lit('{"id":"sub_'), u, F.lit('","metadata":'))
    sub_ref = (F.when(kind == 0, F.lit("null")).when(kind == 5, F.concat(sub_object, named, F.lit("}")))
                .when(kind == 7, F.concat(sub_object, F.lit("{}}")))
                .otherwise(F.concat(F.lit('"sub_'), u, F.lit('"'))))
    obj = (F.when(etype.startswith("customer.subscription.") | (etype == "checkout.session.completed"),
                  F.concat(F.lit('{"id":"sub_'), u, F.lit('","customer":"cus_'), u, F.lit('","metadata":'), meta, F.lit("}")))
            .when(etype.startswith("invoice."),
                  F.concat(F.lit('{"id":"in_'), _s("event_id"), F.lit('","subscription":'), sub_ref, F.lit("}")))
            .when(etype == "customer.deleted", F.concat(F.lit('{"id":"cus_'), u, F.lit('"}')))
            .otherwise(F.concat(F.lit('{"id":"x_'), _s("event_id"), F.lit('"}'))))
    payload = F.concat(F.lit('{"id":"evt_'), _s("event_id"), F.lit('","type":"'), etype,
                       F.lit('","data":{"object":'), obj, F.lit("}}"))
    return e.select("event_id", "ts", payload.alias("payload"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkout session of each user (= latest order per customer)."""
    o = table(spark, sf_dir, "orders")
    latest = (o.groupBy("o_custkey")
               .agg(F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderkey").alias("s"))
               .select("o_custkey", "s.*"))
    key = F.col("o_orderkey")
    status = (F.when(F.col("o_orderstatus") == "F", "complete")
               .when(F.col("o_orderstatus") == "O", "open").otherwise("expired"))
    sub_status = (F.when(F.pmod(key, F.lit(13)) == 0, F.lit(None).cast("string"))
                   .when(F.pmod(key, F.lit(4)) == 0, "active")
                   .when(F.pmod(key, F.lit(4)) == 1, "trialing")
                   .when(F.pmod(key, F.lit(4)) == 2, "canceled").otherwise("past_due"))
    return latest.select(
        F.concat(F.lit("cs_"), _s(key)).alias("id"),
        F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("ref-"), _s(key)).alias("client_reference_id"),
        F.concat(F.lit("cs_"), _s(key)).alias("session_id"),
        _s("o_custkey").alias("customer_id"),
        F.concat(F.lit("https://checkout.example.com/c/"), _s(key)).alias("url"),
        status.alias("status"),
        F.when(status == "open", F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("cus_"), _s("o_custkey"))).alias("billing_customer_id"),
        (F.pmod(key, F.lit(7)) == 0).alias("customer_deleted"),
        F.when(sub_status.isNull(), F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("sub_"), _s("o_custkey"))).alias("subscription_id"),
        sub_status.alias("subscription_status"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(_s("c_custkey").alias("user_id"))


def _tx_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: sorted JSON transaction list and collection/seal id lists."""
    li = table(spark, sf_dir, "lineitem")
    cents = _s(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    value = (F.when(F.col("l_linenumber") == 1, F.concat(F.lit('"0x'), F.lower(F.hex("l_partkey")), F.lit('"')))
              .when(F.col("l_linenumber") == 2, F.concat(F.lit('"'), cents, F.lit(WEI_ZEROS + '"')))
              .otherwise(cents))
    tx = F.concat(F.lit('{"to":"0xp'), _s("l_partkey"), F.lit('","from":"0xs'), _s("l_suppkey"),
                  F.lit('","nonce":'), _s("l_linenumber"),
                  F.lit(',"value":'), value, F.lit("}"))
    coll = F.concat(F.lit('{"collection_id":"c'), _s("l_partkey"), F.lit('"}'))
    seal = F.concat(F.lit('{"block_id":"f'), _s("l_orderkey"), F.lit('","execution_receipt_id":"r'),
                    _s("l_suppkey"), F.lit('"}'))
    return (li.groupBy("l_orderkey")
              .agg(F.array_join(F.array_sort(F.collect_list(tx)), ",").alias("txs"),
                   F.array_join(F.array_sort(F.collect_list(coll)), ",").alias("colls"),
                   F.array_join(F.array_sort(F.collect_list(seal)), ",").alias("seals")))


def raw_evm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain-native EVM payloads ``(chain_id, seq, raw)``."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    t = _tx_lists(spark, sf_dir)
    h = F.expr("o_orderkey div 5")
    raw = F.concat(
        F.lit('{"number":'), _s(h),
        F.lit(',"hash":"0xb'), _s("o_orderkey"),
        F.lit('","parentHash":"0xb'), _s(F.col("o_orderkey") - 5),
        F.lit('","time":'), _s(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)")),
        F.lit(',"gasUsed":'), _s(F.col("o_custkey") * 1000),
        F.lit(',"gasLimit":30000000,"coinbase":"0xc'), _s("o_custkey"),
        F.lit('","baseFee":"'), _s(F.col("o_orderkey") * 7), F.lit('","difficulty":"'), _s("o_orderkey"),
        F.lit(WEI_ZEROS + '","size":'), _s(F.col("o_custkey") + 500),
        F.lit(',"nonce":'), _s(F.col("o_orderkey").cast("decimal(20,0)") + F.lit(str(NONCE_BASE)).cast("decimal(20,0)")),
        *[F.concat(F.lit(f'{"," if i == 0 else chr(34) + ","}"{k}":"0x{k[0]}'), _s("o_orderkey"))
          for i, k in enumerate(EVM_HASH_KEYS)],
        F.lit('","extra":'), F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.lit("null")).otherwise(F.lit('"AA=="')),
        F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.lit(',"blobGasUsed":131072,"excessBlobGas":0')).otherwise(F.lit("")),
        F.lit(',"receivedAt":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit('","header":{"number":'), _s(h), F.lit(',"unknown":[1,{"k":null}]},"uncles":[],"transactions":['),
        F.coalesce(F.col("txs"), F.lit("")), F.lit("]"),
        F.when(F.pmod("o_orderkey", F.lit(5)) == 1, F.lit(',"withdrawals":[{"index":1}]')).otherwise(F.lit("")), F.lit("}"),
    )
    return (o.join(t, o.o_orderkey == t.l_orderkey, "left")
             .join(_chain_names(spark, sf_dir), F.pmod(F.col("o_orderkey"), F.lit(CHAIN_COUNT)) == F.col("chain_no"))
             .select("chain_id", F.col("o_orderkey").alias("seq"), raw.alias("raw")))


def raw_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain-native Flow payloads ``(chain_id, seq, raw)``."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    t = _tx_lists(spark, sf_dir)
    h = F.expr("o_orderkey div 5")
    raw = F.concat(
        F.lit('{"id":"f'), _s("o_orderkey"),
        F.lit('","parent_id":"f'), _s(F.col("o_orderkey") - 5),
        F.lit('","height":'), _s(h),
        F.lit(',"timestamp":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit('","status":'), F.when(F.pmod("o_orderkey", F.lit(7)) == 0, "null")
                               .when(F.col("o_orderstatus") == "F", "4").otherwise("2"),
        F.lit(',"collection_ids":['), F.coalesce(F.col("colls"), F.lit("")),
        F.lit('],"seals":['), F.coalesce(F.col("seals"), F.lit("")), F.lit("]}"),
    )
    return (o.join(t, o.o_orderkey == t.l_orderkey, "left")
             .join(_chain_names(spark, sf_dir), F.pmod(F.col("o_orderkey"), F.lit(CHAIN_COUNT)) == F.col("chain_no"))
             .select("chain_id", F.col("o_orderkey").alias("seq"), raw.alias("raw")))


# --------------------------------------------------------------------------
# DuckDB side: the same views as SQL, composed into WITH clauses.
# --------------------------------------------------------------------------

_EVM_HASHES_SQL = "".join(f'"{k}":"0x{k[0]}\' || CAST(o.o_orderkey AS VARCHAR) || \'",' for k in EVM_HASH_KEYS)

SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "chain": ((), f"""
        SELECT r_name AS id, CAST(r_regionkey AS BIGINT) AS chain_no, CAST({SHARDS_PER_CHAIN} AS INTEGER) AS shard_count,
               TIMESTAMP '{EPOCH}' AS created_at, 'rpc://' || lower(replace(r_name, ' ', '-')) AS url
        FROM region"""),
    "block": ((), """
        SELECT r.r_name AS chain_id, CAST(o.o_orderkey // 5 AS BIGINT) AS block_height, o.o_orderkey AS seq,
               o.o_orderdate AS ts,
               '{"height":' || CAST(o.o_orderkey // 5 AS VARCHAR) || ',"timestamp":"' || strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%SZ')
               || '","miner":' || CAST(o.o_custkey AS VARCHAR) || ',"status":"' || o.o_orderstatus
               || '","priority":"' || o.o_orderpriority || '"}' AS block
        FROM orders o JOIN region r ON r.r_regionkey = o.o_orderkey % 5"""),
    "chain_head": (("block",), """
        SELECT chain_id, max(block_height) AS head, min(block_height) AS low, count(*) AS n_blocks
        FROM block GROUP BY chain_id"""),
    "webhook": ((), f"""
        SELECT CAST(c.c_custkey AS VARCHAR) AS id,
               TIMESTAMP '{EPOCH}' + to_minutes(CAST(c.c_custkey // 3 AS BIGINT)) AS created_at,
               CAST(CASE WHEN c.c_acctbal >= 0 THEN 1 ELSE 0 END AS INTEGER) AS is_active,
               'https://' || lower(c.c_mktsegment) || '.example.com/hooks/' || CAST(c.c_custkey AS VARCHAR) AS url,
               CAST(c.c_custkey % 10 + 1 AS INTEGER) AS max_blocks,
               CAST(c.c_custkey % 11 AS INTEGER) AS max_retries,
               CAST((c.c_custkey * 37) % 10001 AS INTEGER) AS timeout_ms,
               CAST(c.c_nationkey AS VARCHAR) AS customer_id,
               r.r_name AS blockchain_id,
               CAST((c.c_custkey // 5) % {SHARDS_PER_CHAIN} AS INTEGER) AS shard_id
        FROM customer c JOIN region r ON r.r_regionkey = c.c_custkey % 5"""),
    "webhook_input": ((), """
        SELECT CAST(c.c_custkey AS VARCHAR) AS request_id,
               CASE WHEN c.c_custkey % 13 = 0 THEN 'not a url' WHEN c.c_custkey % 17 = 0 THEN ''
                    ELSE 'https://' || lower(c.c_mktsegment) || '.example.com/in/' || CAST(c.c_custkey AS VARCHAR) END AS url,
               CAST(c.c_custkey % 12 AS INTEGER) AS max_blocks,
               CAST(c.c_nationkey % 12 AS INTEGER) AS max_retries,
               CAST((c.c_custkey * 37) % 12001 AS INTEGER) AS timeout_ms,
               CASE WHEN c.c_custkey % 19 = 0 THEN 'UNKNOWN CHAIN' ELSE r.r_name END AS blockchain_id,
               CAST(c.c_nationkey AS VARCHAR) AS customer_id
        FROM customer c JOIN region r ON r.r_regionkey = c.c_custkey % 5"""),
    "job": (("chain_head",), f"""
        SELECT CAST(c.c_custkey AS VARCHAR) AS webhook_id, r.r_name AS chain_id,
               CAST((c.c_custkey // 5) % {SHARDS_PER_CHAIN} AS INTEGER) AS shard_id,
               CAST(greatest(0, h.head + 1 - (c.c_custkey * 7) % 200) AS BIGINT) AS next_height,
               (c.c_custkey % 4 = 0) AS is_new
        FROM customer c JOIN region r ON r.r_regionkey = c.c_custkey % 5
        JOIN chain_head h ON h.chain_id = r.r_name"""),
    "attempt": ((), """
        SELECT event_id AS attempt_id, ts, CAST(user_id AS VARCHAR) AS webhook_id,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS msg_id, (event_type = 'error') AS failed
        FROM events"""),
    "billing_event": ((), """
        SELECT event_id, ts,
          '{"id":"evt_' || CAST(event_id AS VARCHAR) || '","type":"' || etype || '","data":{"object":' ||
          CASE WHEN starts_with(etype, 'customer.subscription.') OR etype = 'checkout.session.completed'
                 THEN '{"id":"sub_' || u || '","customer":"cus_' || u || '","metadata":' ||
                      CASE kind WHEN 0 THEN '{}' WHEN 5 THEN '{"userId":' || u || '}'
                                ELSE '{"userId":"' || u || '"}' END || '}'
               WHEN starts_with(etype, 'invoice.')
                 THEN '{"id":"in_' || CAST(event_id AS VARCHAR) || '","subscription":' ||
                      CASE kind WHEN 0 THEN 'null'
                                WHEN 5 THEN '{"id":"sub_' || u || '","metadata":{"userId":"' || u || '"}}'
                                WHEN 7 THEN '{"id":"sub_' || u || '","metadata":{}}'
                                ELSE '"sub_' || u || '"' END || '}'
               WHEN etype = 'customer.deleted' THEN '{"id":"cus_' || u || '"}'
               ELSE '{"id":"x_' || CAST(event_id AS VARCHAR) || '"}' END || '}}' AS payload
        FROM (
          SELECT event_id, ts, CAST(user_id AS VARCHAR) AS u,
                 CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS kind,
                 CASE event_type WHEN 'signup' THEN 'customer.subscription.created'
                                 WHEN 'purchase' THEN 'invoice.paid'
                                 WHEN 'error' THEN 'customer.subscription.deleted'
                                 WHEN 'view' THEN 'invoice.upcoming'
                                 ELSE CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 3
                                           WHEN 0 THEN 'customer.deleted' WHEN 1 THEN 'checkout.session.completed'
                                           ELSE 'product.created' END END AS etype
          FROM events) e"""),
    "session": ((), """
        SELECT 'cs_' || CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS created_at,
               'ref-' || CAST(o_orderkey AS VARCHAR) AS client_reference_id,
               'cs_' || CAST(o_orderkey AS VARCHAR) AS session_id,
               CAST(o_custkey AS VARCHAR) AS customer_id,
               'https://checkout.example.com/c/' || CAST(o_orderkey AS VARCHAR) AS url,
               CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'open' ELSE 'expired' END AS status,
               CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 'cus_' || CAST(o_custkey AS VARCHAR) END AS billing_customer_id,
               (o_orderkey % 7 = 0) AS customer_deleted,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'sub_' || CAST(o_custkey AS VARCHAR) END AS subscription_id,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'active'
                    WHEN o_orderkey % 4 = 1 THEN 'trialing' WHEN o_orderkey % 4 = 2 THEN 'canceled'
                    ELSE 'past_due' END AS subscription_status
        FROM orders WHERE (o_custkey, o_orderkey) IN (SELECT o_custkey, max(o_orderkey) FROM orders GROUP BY o_custkey)"""),
    "app_user": ((), "SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer"),
    "tx_list": ((), f"""
        SELECT l_orderkey, string_agg(tx, ',' ORDER BY tx) AS txs, string_agg(coll, ',' ORDER BY coll) AS colls,
               string_agg(seal, ',' ORDER BY seal) AS seals
        FROM (
          SELECT l_orderkey,
            '{{"to":"0xp' || CAST(l_partkey AS VARCHAR) || '","from":"0xs' || CAST(l_suppkey AS VARCHAR)
            || '","nonce":' || CAST(l_linenumber AS VARCHAR) || ',"value":'
            || CASE l_linenumber WHEN 1 THEN '"0x' || lower(to_hex(l_partkey)) || '"'
                                 WHEN 2 THEN '"' || cents || '{WEI_ZEROS}"' ELSE cents END || '}}' AS tx,
            '{{"collection_id":"c' || CAST(l_partkey AS VARCHAR) || '"}}' AS coll,
            '{{"block_id":"f' || CAST(l_orderkey AS VARCHAR) || '","execution_receipt_id":"r'
            || CAST(l_suppkey AS VARCHAR) || '"}}' AS seal
          FROM (SELECT *, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS cents FROM lineitem))
        GROUP BY l_orderkey"""),
    "raw_evm": (("tx_list",), f"""
        SELECT r.r_name AS chain_id, o.o_orderkey AS seq,
          '{{"number":' || CAST(o.o_orderkey // 5 AS VARCHAR) || ',"hash":"0xb' || CAST(o.o_orderkey AS VARCHAR)
          || '","parentHash":"0xb' || CAST(o.o_orderkey - 5 AS VARCHAR)
          || '","time":' || CAST(CAST(epoch(o.o_orderdate) AS BIGINT) AS VARCHAR)
          || ',"gasUsed":' || CAST(o.o_custkey * 1000 AS VARCHAR)
          || ',"gasLimit":30000000,"coinbase":"0xc' || CAST(o.o_custkey AS VARCHAR)
          || '","baseFee":"' || CAST(o.o_orderkey * 7 AS VARCHAR)
          || '","difficulty":"' || CAST(o.o_orderkey AS VARCHAR) || '{WEI_ZEROS}'
          || '","size":' || CAST(o.o_custkey + 500 AS VARCHAR)
          || ',"nonce":' || CAST(CAST(o.o_orderkey AS HUGEINT) + {NONCE_BASE} AS VARCHAR)
          || ',{_EVM_HASHES_SQL}"extra":'
          || CASE WHEN o.o_orderkey % 3 = 0 THEN 'null' ELSE '"AA=="' END
          || CASE WHEN o.o_orderkey % 2 = 0 THEN ',"blobGasUsed":131072,"excessBlobGas":0' ELSE '' END
          || ',"receivedAt":"' || strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%SZ')
          || '","header":{{"number":' || CAST(o.o_orderkey // 5 AS VARCHAR) || ',"unknown":[1,{{"k":null}}]}},"uncles":[],"transactions":['
          || coalesce(t.txs, '') || ']'
          || CASE WHEN o.o_orderkey % 5 = 1 THEN ',"withdrawals":[{{"index":1}}]' ELSE '' END || '}}' AS raw
        FROM orders o LEFT JOIN tx_list t ON t.l_orderkey = o.o_orderkey
        JOIN region r ON r.r_regionkey = o.o_orderkey % 5"""),
    "raw_flow": (("tx_list",), """
        SELECT r.r_name AS chain_id, o.o_orderkey AS seq,
          '{"id":"f' || CAST(o.o_orderkey AS VARCHAR) || '","parent_id":"f' || CAST(o.o_orderkey - 5 AS VARCHAR)
          || '","height":' || CAST(o.o_orderkey // 5 AS VARCHAR)
          || ',"timestamp":"' || strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%SZ')
          || '","status":' || CASE WHEN o.o_orderkey % 7 = 0 THEN 'null' WHEN o.o_orderstatus = 'F' THEN '4' ELSE '2' END
          || ',"collection_ids":[' || coalesce(t.colls, '') || '],"seals":[' || coalesce(t.seals, '') || ']}' AS raw
        FROM orders o LEFT JOIN tx_list t ON t.l_orderkey = o.o_orderkey
        JOIN region r ON r.r_regionkey = o.o_orderkey % 5"""),
}

# Extra derived views used by several oracle queries.
SQL_VIEWS.update({
    "hot": (("block", "chain_head"), """
        SELECT b.* FROM block b JOIN chain_head h USING (chain_id) WHERE b.block_height >= (h.head * 4) // 5"""),
    "cold": (("block", "chain_head"), """
        SELECT b.* FROM block b JOIN chain_head h USING (chain_id) WHERE b.block_height < (h.head * 41) // 50"""),
})


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        deps, _ = SQL_VIEWS[n]
        for d in deps:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in order)
    if not ctes:
        return sql
    if sql.lstrip().upper().startswith("WITH"):
        sql = f"SELECT * FROM ({sql}) AS q"
    return f"WITH {ctes}\n{sql}"


def hot_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent part of every chain (height >= 80 % of the head)."""
    heads = F.broadcast(chain_heads(spark, sf_dir).select("chain_id", "head"))  # one row per chain
    b = blocks(spark, sf_dir)
    return b.join(heads, "chain_id").where(F.col("block_height") >= F.expr("(head * 4) div 5")).drop("head")


def cold_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older part of every chain (height < 82 % of the head); overlaps the hot tier."""
    heads = F.broadcast(chain_heads(spark, sf_dir).select("chain_id", "head"))
    b = blocks(spark, sf_dir)
    return b.join(heads, "chain_id").where(F.col("block_height") < F.expr("(head * 41) div 50")).drop("head")
