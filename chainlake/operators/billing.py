"""Billing events -> subscription and entitlement decisions.

Raw events stay JSON strings (their shape depends on the type); only the
fields a rule needs are read with ``get_json_object``.  Every event gets an
outcome and is acknowledged whether it succeeded or not; unknown types are
no-ops.

Tables:

* ``events``        ``(event_id, ts, payload)``
* ``subscriptions`` ``(subscription_id, billing_customer_id, user_id, status, created_at)``
* ``sessions``      checkout sessions, one per user: ``(id, customer_id, client_reference_id,
  session_id, url, status, billing_customer_id, customer_deleted, subscription_id,
  subscription_status, created_at)``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.functions.columns import METADATA_USER_TYPES, billing_action

# Trial length, consumer error texts and subscription-gate
# decisions (code, message), in the order the gate checks them.
TRIAL_DAYS = 7
EVENT_ERROR_PREFIX = 'an error occurred while processing event "{type}" with message ID "{id}": '
WRONG_USER_ERROR = "metadata.userId: expected string, received "
MISSING_SUBSCRIPTION_ERROR = "subscription is missing in checkout session event"
UNKNOWN_SUBSCRIPTION_ERROR = "no such subscription: "
GATE_DECISIONS = [
    ("no_session", "not_subscribed", "user is not subscribed"),
    ("not_complete", "not_subscribed", "user must complete checkout session"),
    ("no_customer", "internal_error", "could not obtain customer from session"),
    ("customer_deleted", "not_subscribed", "user has been deleted and must subscribe again"),
    ("no_subscription", "internal_error", "could not obtain subscription from session"),
    ("canceled", "not_subscribed", "user has canceled their subscription"),
    ("not_active", "invalid_subscription", "invalid subscription"),
]


EVENT_SCHEMA = ("type string, data struct<object: struct<id: string, subscription: variant, "
                "metadata: struct<userId: variant>>>")


def _string_of(v: Column) -> Column:
    """A variant's text if it is a JSON string, else null (numbers are not coerced)."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _json_type(v: Column) -> Column:
    """What a validator calls the type of a variant; ``undefined`` if it is absent."""
    t = F.schema_of_variant(v)
    return (F.when(v.isNull(), "undefined").when(t == "VOID", "null").when(t == "BOOLEAN", "boolean")
             .when(t == "STRING", "string").when(t.startswith("OBJECT"), "object")
             .when(t.startswith("ARRAY"), "array").otherwise("number"))


def parse_billing_events(events: DataFrame) -> DataFrame:
    """Read the fields the rules need with one parse per event.

    ``meta_user`` is the event's own ``metadata.userId`` and ``meta_type`` its
    JSON type; ``subscription_ref`` is a subscription id; a subscription that
    is expanded to an object gives ``sub_meta_user``/``sub_meta_type`` instead.
    """
    e = events.withColumn("_p", F.from_json("payload", EVENT_SCHEMA)).select(
        "event_id", "ts", F.col("_p.type").alias("type"), F.col("_p.data.object.id").alias("object_id"),
        F.col("_p.data.object.metadata.userId").alias("_u"), F.col("_p.data.object.subscription").alias("_s"))
    expanded = F.schema_of_variant("_s").startswith("OBJECT")
    inner = F.try_variant_get(F.col("_s"), "$.metadata.userId", "variant")
    return e.select(
        "event_id", "ts", "type", "object_id",
        _string_of(F.col("_u")).alias("meta_user"), _json_type(F.col("_u")).alias("meta_type"),
        _string_of(F.col("_s")).alias("subscription_ref"),
        F.when(expanded, _string_of(inner)).alias("sub_meta_user"),
        F.when(expanded, _json_type(inner)).alias("sub_meta_type"))


def subscriptions_from_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("subscription_id").isNotNull()).select(
        "subscription_id", "billing_customer_id", F.col("customer_id").alias("user_id"),
        F.col("subscription_status").alias("status"), "created_at")


def _error(type_col: Column, event_id: Column, detail: Column) -> Column:
    before_type, rest = EVENT_ERROR_PREFIX.split("{type}")
    between, after_id = rest.split("{id}")
    return F.concat(F.lit(before_type), type_col, F.lit(between), event_id.cast("string"), F.lit(after_id), detail)


def _billing_lookup(subscriptions: DataFrame) -> DataFrame:
    """``(kind, ref, found_user)``: the user of each subscription and of the
    latest subscription of each billing customer."""
    subs = (subscriptions.where(F.col("subscription_id").isNotNull())
            .groupBy(F.col("subscription_id").alias("ref"))
            .agg(F.max_by("user_id", "created_at").alias("found_user")).withColumn("kind", F.lit("subscription")))
    latest = (subscriptions.where(F.col("billing_customer_id").isNotNull())
              .groupBy(F.col("billing_customer_id").alias("ref"))
              .agg(F.max_by("user_id", F.struct("created_at", "subscription_id")).alias("found_user"))
              .withColumn("kind", F.lit("customer")))
    return subs.unionByName(latest)


def resolve_billing_user(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Per event: ``action``, resolved ``user_id`` and ``error``.

    Subscription and checkout events carry the user in their metadata (absent
    or not a string -> error); invoices reach it through their subscription
    (missing reference -> error; an expanded subscription carries its own
    metadata); ``customer.deleted`` goes through the customer's most recent
    subscription (none -> nothing to do).  Invoices with a subscription id and
    deletions find their user by one lookup; events are read and parsed once.
    """
    e = parse_billing_events(events).withColumn("action", billing_action("type"))
    by_meta = F.col("type").isin(*METADATA_USER_TYPES)
    is_invoice = (F.col("action") == "invalidate") & ~by_meta
    deletion = F.col("action") == "delete_sessions"
    by_sub = is_invoice & F.col("subscription_ref").isNotNull()
    e = e.withColumns({
        "kind": F.when(by_sub, "subscription").when(deletion & F.col("object_id").isNotNull(), "customer"),
        # a null kind never matches; the event's own id spreads such rows over the tasks of the join
        "ref": F.coalesce(F.when(by_sub, F.col("subscription_ref")).when(deletion, F.col("object_id")),
                          F.col("event_id").cast("string"))})
    j = e.join(_billing_lookup(subscriptions), ["kind", "ref"], "left")
    expanded = is_invoice & F.col("sub_meta_type").isNotNull()
    user = (F.when(by_meta, F.col("meta_user"))
             .when(expanded, F.col("sub_meta_user"))
             .when(is_invoice | deletion, F.col("found_user")))
    detail = (F.when(by_meta & F.col("meta_user").isNull(), F.concat(F.lit(WRONG_USER_ERROR), F.col("meta_type")))
               .when(expanded & F.col("sub_meta_user").isNull(),
                     F.concat(F.lit(WRONG_USER_ERROR), F.col("sub_meta_type")))
               .when(is_invoice & ~expanded & F.col("subscription_ref").isNull(), F.lit(MISSING_SUBSCRIPTION_ERROR))
               .when(is_invoice & ~expanded & F.col("found_user").isNull(),
                     F.concat(F.lit(UNKNOWN_SUBSCRIPTION_ERROR), F.col("subscription_ref"))))
    return j.select("event_id", "ts", "type", "action", user.alias("user_id"),
                    F.when(detail.isNotNull(), _error(F.col("type"), F.col("event_id"), detail)).alias("error"))


def event_outcomes(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Outcome of every event (all are acknowledged)."""
    r = resolve_billing_user(events, subscriptions)
    status = (F.when(F.col("error").isNotNull(), "error")
               .when(F.col("action") == "ignore", "ignored")
               .when((F.col("action") == "delete_sessions") & F.col("user_id").isNull(), "no_subscription")
               .otherwise("ok"))
    return r.withColumn("status", status)


def event_outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("type", "status").agg(F.count(F.lit(1)).alias("n_events"))


def delete_sessions_of_deleted_customers(sessions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Sessions left after ``customer.deleted`` events removed their users' rows."""
    gone = (outcomes.where((F.col("action") == "delete_sessions") & F.col("user_id").isNotNull())
            .select(F.col("user_id").alias("customer_id")).distinct())
    return sessions.join(gone, "customer_id", "left_anti")


def entitlement(users: DataFrame, sessions: DataFrame) -> DataFrame:
    """Ordered decision chain of the subscription gate, for every user."""
    s = sessions.select(F.col("customer_id").alias("user_id"), "status", "billing_customer_id",
                        "customer_deleted", "subscription_status", F.lit(True).alias("_has"))
    j = users.select("user_id").join(s, "user_id", "left")
    checks = {
        "no_session": F.col("_has").isNull(),
        "not_complete": F.col("status") != "complete",
        "no_customer": F.col("billing_customer_id").isNull(),
        "customer_deleted": F.col("customer_deleted"),
        "no_subscription": F.col("subscription_status").isNull(),
        "canceled": F.col("subscription_status") == "canceled",
        "not_active": ~F.col("subscription_status").isin("trialing", "active"),
    }
    code_msg = [(checks[name], c, m) for name, c, m in GATE_DECISIONS]
    code, msg = F.lit("ok"), F.lit(None).cast("string")
    for cond, c, m in reversed(code_msg):
        code = F.when(cond, F.lit(c)).otherwise(code)
        msg = F.when(cond, F.lit(m)).otherwise(msg)
    return j.select("user_id", code.alias("decision"), msg.alias("message"),
                    (code == "ok").alias("entitled"))


# resolutions that create a checkout session; only these can offer a trial
NEW_SESSION_RESOLUTIONS = ("new", "new_keep_ids", "new_with_customer", "delete_and_new")


def checkout_resolution(users: DataFrame, sessions: DataFrame, portal_url: str) -> DataFrame:
    """What a checkout request does for each user, plus the trial offer."""
    s = sessions.select(F.col("customer_id").alias("user_id"), "status", "url", "client_reference_id",
                        "billing_customer_id", "customer_deleted", "subscription_status",
                        F.lit(True).alias("_has"))
    j = users.select("user_id").join(s, "user_id", "left")
    complete = F.col("status") == "complete"
    res = (F.when(F.col("_has").isNull(), "new")
            .when(F.col("status") == "open", "existing_url")
            .when(F.col("status") == "expired", "new_keep_ids")
            .when(complete & F.col("customer_deleted"), "delete_and_new")
            .when(complete & (F.col("subscription_status") == "canceled"), "new_with_customer")
            .when(complete, "portal")
            .otherwise("error"))
    keeps_ids = F.col("_r").isin("new_keep_ids", "new_with_customer")
    out = j.withColumn("_r", res)
    return out.select(
        "user_id", F.col("_r").alias("resolution"),
        F.when(F.col("_r") == "existing_url", F.col("url"))
         .when(F.col("_r") == "portal", F.lit(portal_url)).alias("url"),
        F.when(keeps_ids, F.col("client_reference_id")).alias("client_reference_id"),
        F.when(keeps_ids, F.col("billing_customer_id")).alias("billing_customer_id"),
        F.when(F.col("_r").isin(*NEW_SESSION_RESOLUTIONS),
               trial_days(F.when(keeps_ids, F.col("billing_customer_id")))).alias("trial_days"),
    )


def trial_days(billing_customer_id: Column) -> Column:
    """A trial only when the user never had a billing customer."""
    return F.when(billing_customer_id.isNull(), F.lit(TRIAL_DAYS)).otherwise(F.lit(0))


def swap_session(sessions: DataFrame, proposals: DataFrame) -> DataFrame:
    """Apply new checkout sessions, one per user at most.

    A proposal is accepted only while the user's client reference still equals
    its ``expected_reference`` (null: the user has no row).  An accepted one
    updates the user's row in place, so ``id`` and ``created_at`` stay and the
    other columns are those of the new session; with ``delete_old`` (an
    optional column) the old row is deleted and a new one inserted instead.
    """
    cur = sessions.select("customer_id", F.col("client_reference_id").alias("_cur_ref"),
                          F.col("id").alias("_cur_id"), F.col("created_at").alias("_cur_created"))
    p = proposals if "delete_old" in proposals.columns else proposals.withColumn("delete_old", F.lit(False))
    p = (p.join(cur, "customer_id", "left")
         .where(F.col("_cur_ref").eqNullSafe(F.col("expected_reference"))))
    # one proposal per user wins: the smallest session id (deterministic)
    winners = (p.groupBy("customer_id")
               .agg(F.min_by(F.struct(*[c for c in p.columns if c != "customer_id"]), "session_id").alias("w"))
               .select("customer_id", "w.*"))
    keeps = F.col("_cur_id").isNotNull() & ~F.col("delete_old")
    winners = winners.withColumns({"id": F.when(keeps, F.col("_cur_id")).otherwise(F.col("id")),
                                   "created_at": F.when(keeps, F.col("_cur_created")).otherwise(F.col("created_at"))})
    kept = sessions.join(winners.select("customer_id"), "customer_id", "left_anti")
    return kept.unionByName(winners.select(*sessions.columns)).select(*sessions.columns)


def entitlement_state(fills: DataFrame, invalidations: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Batch form of the cached entitlement: the latest read-through fill of
    each user is ``cached`` until its TTL passes (``expired``) or a later
    billing event drops it (``invalidated``)."""
    last_fill = fills.groupBy("user_id").agg(F.max("ts").alias("last_fill"))
    last_inv = invalidations.groupBy("user_id").agg(F.max("ts").alias("last_invalidation"))
    j = last_fill.join(last_inv, "user_id", "left")
    state = (F.when(F.col("last_invalidation") >= F.col("last_fill"), "invalidated")
              .when(F.col("last_fill") + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS") <= now, "expired")
              .otherwise("cached"))
    return j.select("user_id", "last_fill", "last_invalidation", state.alias("state"))
