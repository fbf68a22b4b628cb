"""Billing queries (§2.3 user resolution/entitlement joins, §2.4 outcomes, §2.8 decisions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake import fixtures as fx
from chainlake.fixtures import SQL_VIEWS
from chainlake.functions.columns import DELETE_TYPES, EMAIL_TYPES, INVALIDATE_TYPES, METADATA_USER_TYPES
from chainlake.operators import billing as bl
from chainlake.plans.catalog import query

PORTAL_URL = "https://billing.example.com/portal"
NOW = "2024-01-31 00:00:00"
TTL_SECONDS = 86400


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _json_type_sql(path: str) -> str:
    return (f"CASE json_type(payload, '{path}') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' "
            f"WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' "
            f"ELSE CASE WHEN json_type(payload, '{path}') IS NULL THEN 'undefined' ELSE 'number' END END")


def _string_sql(path: str) -> str:
    return f"CASE WHEN json_type(payload, '{path}') = 'VARCHAR' THEN json_extract_string(payload, '{path}') END"


_META = "$.data.object.metadata.userId"
_SUB = "$.data.object.subscription"
SQL_VIEWS["subscription"] = (("session",), """
    SELECT subscription_id, billing_customer_id, customer_id AS user_id,
           subscription_status AS status, created_at FROM session WHERE subscription_id IS NOT NULL""")
SQL_VIEWS["billing_resolved"] = (("billing_event", "subscription"), f"""
    SELECT event_id, ts, type, action,
      CASE WHEN by_meta THEN meta_user WHEN is_invoice AND expanded THEN sub_meta_user
           WHEN is_invoice THEN sub_user WHEN action = 'delete_sessions' THEN cust_user END AS user_id,
      CASE WHEN detail IS NOT NULL THEN 'an error occurred while processing event "' || type
           || '" with message ID "' || CAST(event_id AS VARCHAR) || '": ' || detail END AS error
    FROM (
      SELECT *,
        CASE WHEN by_meta AND meta_user IS NULL THEN 'metadata.userId: expected string, received ' || meta_type
             WHEN is_invoice AND expanded AND sub_meta_user IS NULL
               THEN 'metadata.userId: expected string, received ' || sub_meta_type
             WHEN is_invoice AND NOT expanded AND subscription_ref IS NULL
               THEN 'subscription is missing in checkout session event'
             WHEN is_invoice AND NOT expanded AND sub_user IS NULL
               THEN 'no such subscription: ' || subscription_ref END AS detail
      FROM (
        SELECT e.*, s.user_id AS sub_user, c.cust_user, e.action = 'invalidate' AND NOT e.by_meta AS is_invoice
        FROM (SELECT *,
                CASE WHEN type IN {_in(INVALIDATE_TYPES)} THEN 'invalidate' WHEN type IN {_in(EMAIL_TYPES)} THEN 'email'
                     WHEN type IN {_in(DELETE_TYPES)} THEN 'delete_sessions' ELSE 'ignore' END AS action,
                coalesce(type IN {_in(METADATA_USER_TYPES)}, false) AS by_meta
              FROM (SELECT event_id, ts, json_extract_string(payload, '$.type') AS type,
                           json_extract_string(payload, '$.data.object.id') AS object_id,
                           {_string_sql(_META)} AS meta_user, {_json_type_sql(_META)} AS meta_type,
                           {_string_sql(_SUB)} AS subscription_ref,
                           coalesce(json_type(payload, '{_SUB}') = 'OBJECT', false) AS expanded,
                           {_string_sql(_SUB + ".metadata.userId")} AS sub_meta_user,
                           {_json_type_sql(_SUB + ".metadata.userId")} AS sub_meta_type
                    FROM billing_event)) e
        LEFT JOIN subscription s ON s.subscription_id = e.subscription_ref
        LEFT JOIN (SELECT billing_customer_id, arg_max(user_id, created_at) AS cust_user FROM subscription
                   GROUP BY billing_customer_id) c ON c.billing_customer_id = e.object_id) x) y""")
SQL_VIEWS["billing_outcome"] = (("billing_resolved",), """
    SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN action = 'ignore' THEN 'ignored'
                   WHEN action = 'delete_sessions' AND user_id IS NULL THEN 'no_subscription' ELSE 'ok' END AS status
    FROM billing_resolved""")


def _subs(spark, sf_dir):
    return bl.subscriptions_from_sessions(fx.sessions(spark, sf_dir))


def _outcomes(spark, sf_dir):
    return bl.event_outcomes(fx.billing_events(spark, sf_dir), _subs(spark, sf_dir))


@query("metadata_user", f"""
    SELECT event_id, {_string_sql(_META)} AS user_id, {_string_sql(_META)} IS NOT NULL AS valid
    FROM billing_event WHERE json_extract_string(payload, '$.type') IN {_in(METADATA_USER_TYPES)}""",
       ("billing_event",))
def q_metadata_user(spark, sf_dir):
    e = bl.parse_billing_events(fx.billing_events(spark, sf_dir))
    return (e.where(F.col("type").isin(*METADATA_USER_TYPES))
            .select("event_id", F.col("meta_user").alias("user_id"), F.col("meta_user").isNotNull().alias("valid")))


@query("billing_action", f"""
    SELECT json_extract_string(payload, '$.type') AS type,
      CASE WHEN json_extract_string(payload, '$.type') IN {_in(INVALIDATE_TYPES)} THEN 'invalidate'
           WHEN json_extract_string(payload, '$.type') IN {_in(EMAIL_TYPES)} THEN 'email'
           WHEN json_extract_string(payload, '$.type') IN {_in(DELETE_TYPES)} THEN 'delete_sessions'
           ELSE 'ignore' END AS action, count(*) AS n_events
    FROM billing_event GROUP BY 1, 2""", ("billing_event",))
def q_billing_action(spark, sf_dir):
    from chainlake.functions.columns import billing_action
    e = bl.parse_billing_events(fx.billing_events(spark, sf_dir))
    return e.groupBy("type", billing_action("type").alias("action")).agg(F.count(F.lit(1)).alias("n_events"))


@query("resolve_billing_user", "SELECT * FROM billing_resolved", ("billing_resolved",))
def q_resolve_billing_user(spark, sf_dir):
    return bl.resolve_billing_user(fx.billing_events(spark, sf_dir), _subs(spark, sf_dir))


@query("event_outcomes", "SELECT type, status, count(*) AS n_events FROM billing_outcome GROUP BY type, status",
       ("billing_outcome",))
def q_event_outcomes(spark, sf_dir):
    return bl.event_outcome_counts(_outcomes(spark, sf_dir))


@query("consume_billing_events", "SELECT * FROM billing_outcome", ("billing_outcome",))
def q_consume_billing_events(spark, sf_dir):
    return _outcomes(spark, sf_dir)


_SESSION_COLS = ["id", "created_at", "client_reference_id", "session_id", "customer_id", "url", "status",
                 "billing_customer_id", "customer_deleted", "subscription_id", "subscription_status"]


@query("delete_sessions_of_deleted_customers", f"""
    SELECT {", ".join(_SESSION_COLS)} FROM session s WHERE NOT EXISTS (
      SELECT 1 FROM billing_outcome o WHERE o.action = 'delete_sessions' AND o.user_id = s.customer_id)""",
       ("session", "billing_outcome"))
def q_delete_sessions(spark, sf_dir):
    return bl.delete_sessions_of_deleted_customers(fx.sessions(spark, sf_dir), _outcomes(spark, sf_dir)).select(
        *_SESSION_COLS)


SQL_VIEWS["entitle"] = (("app_user", "session"), """
    SELECT u.user_id, d.decision, d.message, d.decision = 'ok' AS entitled FROM app_user u
    LEFT JOIN session s ON s.customer_id = u.user_id,
    LATERAL (SELECT
      CASE WHEN s.id IS NULL THEN 'not_subscribed' WHEN s.status <> 'complete' THEN 'not_subscribed'
           WHEN s.billing_customer_id IS NULL THEN 'internal_error' WHEN s.customer_deleted THEN 'not_subscribed'
           WHEN s.subscription_status IS NULL THEN 'internal_error'
           WHEN s.subscription_status = 'canceled' THEN 'not_subscribed'
           WHEN s.subscription_status NOT IN ('trialing', 'active') THEN 'invalid_subscription' ELSE 'ok' END AS decision,
      CASE WHEN s.id IS NULL THEN 'user is not subscribed'
           WHEN s.status <> 'complete' THEN 'user must complete checkout session'
           WHEN s.billing_customer_id IS NULL THEN 'could not obtain customer from session'
           WHEN s.customer_deleted THEN 'user has been deleted and must subscribe again'
           WHEN s.subscription_status IS NULL THEN 'could not obtain subscription from session'
           WHEN s.subscription_status = 'canceled' THEN 'user has canceled their subscription'
           WHEN s.subscription_status NOT IN ('trialing', 'active') THEN 'invalid subscription' END AS message) d""")


@query("entitlement", "SELECT * FROM entitle", ("entitle",))
def q_entitlement(spark, sf_dir):
    return bl.entitlement(fx.users(spark, sf_dir), fx.sessions(spark, sf_dir))


SQL_VIEWS["checkout"] = (("app_user", "session"), f"""
    SELECT user_id, r AS resolution,
           CASE WHEN r = 'existing_url' THEN url WHEN r = 'portal' THEN '{PORTAL_URL}' END AS url,
           CASE WHEN r IN ('new_keep_ids', 'new_with_customer') THEN client_reference_id END AS client_reference_id,
           CASE WHEN r IN ('new_keep_ids', 'new_with_customer') THEN billing_customer_id END AS billing_customer_id,
           CASE WHEN r IN ('new_keep_ids', 'new_with_customer') AND billing_customer_id IS NOT NULL THEN 0
                WHEN r IN ('new', 'new_keep_ids', 'new_with_customer', 'delete_and_new') THEN {bl.TRIAL_DAYS}
                END AS trial_days
    FROM (SELECT u.user_id, s.url, s.client_reference_id, s.billing_customer_id,
            CASE WHEN s.id IS NULL THEN 'new' WHEN s.status = 'open' THEN 'existing_url'
                 WHEN s.status = 'expired' THEN 'new_keep_ids'
                 WHEN s.status = 'complete' AND s.customer_deleted THEN 'delete_and_new'
                 WHEN s.status = 'complete' AND s.subscription_status = 'canceled' THEN 'new_with_customer'
                 WHEN s.status = 'complete' THEN 'portal' ELSE 'error' END AS r
          FROM app_user u LEFT JOIN session s ON s.customer_id = u.user_id) x""")


@query("checkout_resolution", "SELECT * FROM checkout", ("checkout",))
def q_checkout_resolution(spark, sf_dir):
    return bl.checkout_resolution(fx.users(spark, sf_dir), fx.sessions(spark, sf_dir), PORTAL_URL)


@query("trial_offer", "SELECT user_id, trial_days FROM checkout", ("checkout",))
def q_trial_offer(spark, sf_dir):
    return bl.checkout_resolution(fx.users(spark, sf_dir), fx.sessions(spark, sf_dir), PORTAL_URL).select(
        "user_id", "trial_days")


SQL_VIEWS["proposal"] = (("checkout", "session"), f"""
    SELECT 'cs_new_' || c.user_id AS id, TIMESTAMP '{fx.EPOCH}' AS created_at,
           coalesce(c.client_reference_id, 'ref-new-' || c.user_id) AS client_reference_id,
           'cs_new_' || c.user_id AS session_id, c.user_id AS customer_id,
           'https://checkout.example.com/c/new-' || c.user_id AS url, 'open' AS status,
           c.billing_customer_id, false AS customer_deleted, CAST(NULL AS VARCHAR) AS subscription_id,
           CAST(NULL AS VARCHAR) AS subscription_status,
           CASE WHEN CAST(c.user_id AS BIGINT) % 5 = 0 THEN 'stale' ELSE s.client_reference_id END AS expected_reference,
           c.resolution = 'delete_and_new' AS delete_old
    FROM checkout c LEFT JOIN session s ON s.customer_id = c.user_id
    WHERE c.resolution IN {_in(bl.NEW_SESSION_RESOLUTIONS)}""")


def _proposals(spark, sf_dir):
    c = bl.checkout_resolution(fx.users(spark, sf_dir), fx.sessions(spark, sf_dir), PORTAL_URL)
    s = fx.sessions(spark, sf_dir).select("customer_id", F.col("client_reference_id").alias("_ref"))
    u = F.col("user_id")
    return (c.where(F.col("resolution").isin(*bl.NEW_SESSION_RESOLUTIONS))
            .join(s, c.user_id == s.customer_id, "left")
            .select(F.concat(F.lit("cs_new_"), u).alias("id"),
                    F.lit(fx.EPOCH).cast("timestamp_ntz").alias("created_at"),
                    F.coalesce(F.col("client_reference_id"), F.concat(F.lit("ref-new-"), u)).alias("client_reference_id"),
                    F.concat(F.lit("cs_new_"), u).alias("session_id"), u.alias("customer_id"),
                    F.concat(F.lit("https://checkout.example.com/c/new-"), u).alias("url"),
                    F.lit("open").alias("status"), "billing_customer_id",
                    F.lit(False).alias("customer_deleted"), F.lit(None).cast("string").alias("subscription_id"),
                    F.lit(None).cast("string").alias("subscription_status"),
                    F.when(F.pmod(u.cast("bigint"), F.lit(5)) == 0, F.lit("stale")).otherwise(F.col("_ref"))
                    .alias("expected_reference"),
                    (F.col("resolution") == "delete_and_new").alias("delete_old")))


@query("swap_session", f"""
    WITH winners AS (
      SELECT p.* EXCLUDE (expected_reference, delete_old, id, created_at),
             CASE WHEN s.id IS NULL OR p.delete_old THEN p.id ELSE s.id END AS id,
             CASE WHEN s.id IS NULL OR p.delete_old THEN p.created_at ELSE s.created_at END AS created_at
      FROM proposal p LEFT JOIN session s ON s.customer_id = p.customer_id
      WHERE (s.client_reference_id IS NULL AND p.expected_reference IS NULL)
         OR s.client_reference_id = p.expected_reference)
    SELECT {", ".join(_SESSION_COLS)} FROM session s
    WHERE NOT EXISTS (SELECT 1 FROM winners w WHERE w.customer_id = s.customer_id)
    UNION ALL
    SELECT {", ".join(_SESSION_COLS)} FROM winners""", ("proposal", "session"))
def q_swap_session(spark, sf_dir):
    return bl.swap_session(fx.sessions(spark, sf_dir), _proposals(spark, sf_dir)).select(*_SESSION_COLS)


@query("entitlement_state", f"""
    WITH f AS (SELECT CAST(user_id AS VARCHAR) AS user_id, max(ts) AS last_fill FROM events
               WHERE event_type = 'click' GROUP BY 1),
    i AS (SELECT user_id, max(ts) AS last_invalidation FROM billing_outcome
          WHERE action = 'invalidate' AND user_id IS NOT NULL AND error IS NULL GROUP BY user_id)
    SELECT f.user_id, f.last_fill, i.last_invalidation,
           CASE WHEN i.last_invalidation >= f.last_fill THEN 'invalidated'
                WHEN f.last_fill + INTERVAL {TTL_SECONDS} SECOND <= TIMESTAMP '{NOW}' THEN 'expired'
                ELSE 'cached' END AS state
    FROM f LEFT JOIN i USING (user_id)""", ("billing_outcome",))
def q_entitlement_state(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    fills = e.where(F.col("event_type") == "click").select(F.col("user_id").cast("string").alias("user_id"), "ts")
    inv = (_outcomes(spark, sf_dir)
           .where((F.col("action") == "invalidate") & F.col("user_id").isNotNull() & F.col("error").isNull())
           .select("user_id", "ts"))
    return bl.entitlement_state(fills, inv, F.lit(NOW).cast("timestamp_ntz"), TTL_SECONDS)


@query("resume_after_unpaid", """
    SELECT j.webhook_id, j.next_height, j.is_new, coalesce(e.entitled, false) AS entitled
    FROM job j JOIN webhook w ON w.id = j.webhook_id LEFT JOIN entitle e ON e.user_id = w.customer_id""",
       ("job", "webhook", "entitle"))
def q_resume_after_unpaid(spark, sf_dir):
    # delivery pauses for unpaid owners and resumes at the same cursor later
    ent = bl.entitlement(fx.users(spark, sf_dir), fx.sessions(spark, sf_dir)).select(
        F.col("user_id").alias("customer_id"), "entitled")
    w = fx.webhooks(spark, sf_dir).select(F.col("id").alias("webhook_id"), "customer_id")
    return (fx.jobs(spark, sf_dir).join(w, "webhook_id").join(ent, "customer_id", "left")
            .select("webhook_id", "next_height", "is_new", F.coalesce("entitled", F.lit(False)).alias("entitled")))
