"""Scalar column expressions (JVM-side, codegen-friendly; no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the webhook registry and pagination.
MAX_BLOCKS_MIN, MAX_BLOCKS_MAX = 1, 10
MAX_RETRIES_MIN, MAX_RETRIES_MAX = 0, 10
TIMEOUT_MS_MIN, TIMEOUT_MS_MAX = 0, 10000
BLOCKCHAIN_ID_MIN, BLOCKCHAIN_ID_MAX = 0, 1024
URL_LEN_MIN, URL_LEN_MAX = 1, 2048
MAX_IDS = 50
PAGE_LIMIT_MIN, PAGE_LIMIT_MAX = 0, 25

# Billing event types and what the consumer does with them.
INVALIDATE_TYPES = (
    "checkout.session.completed",
    "invoice.paid",
    "invoice.payment_failed",
    "invoice.payment_succeeded",
    "customer.subscription.deleted",
    "customer.subscription.updated",
    "customer.subscription.created",
    "customer.subscription.resumed",
    "customer.subscription.paused",
)
EMAIL_TYPES = ("invoice.upcoming", "customer.subscription.trial_will_end")
DELETE_TYPES = ("customer.deleted",)
# Types whose user id is read from the event's own metadata.
METADATA_USER_TYPES = (
    "checkout.session.completed",
    "customer.subscription.paused",
    "customer.subscription.created",
    "customer.subscription.deleted",
    "customer.subscription.updated",
    "customer.subscription.resumed",
)


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def shard_key(prefix: str, shard_id, name: str) -> Column:
    """Namespaced key of a shard-local structure: ``<prefix>:{s<id>}:<name>``."""
    return F.concat(F.lit(f"{prefix}:{{s"), _c(shard_id).cast("string"), F.lit(f"}}:{name}"))


def assign_shard(id_col, shard_count, method: str = "hash") -> Column:
    """Deterministic shard of a webhook.  ``hash`` spreads arbitrary ids
    (uuids) evenly; ``mod`` is the integer form used by the fixtures."""
    n = _c(shard_count) if not isinstance(shard_count, int) else F.lit(shard_count)
    if method == "mod":
        return F.pmod(_c(id_col).cast("bigint"), n).cast("int")
    return F.pmod(F.xxhash64(_c(id_col)), n).cast("int")


def attempts_allowed(max_retries) -> Column:
    """Deliveries made before a job is skipped: the delivery count is 1 on the
    first read and the job is skipped once the count reaches max_retries."""
    return F.greatest(F.lit(1), _c(max_retries) - 1)


def next_height(last_height) -> Column:
    return _c(last_height) + 1


def backoff_wait_ms(attempt, init_ms: int, max_rand_ms: int, seed=None) -> Column:
    """Wait before attempt ``attempt`` (0-based): none, then ``init + jitter``,
    then ``init ** attempt + jitter``.  The jitter is deterministic in
    ``seed`` and the attempt number so that replays agree."""
    a = _c(attempt).cast("bigint")
    s = F.lit(0) if seed is None else _c(seed).cast("bigint")
    jitter = F.pmod(s * 31 + a * 7919, F.lit(max(max_rand_ms, 1)))
    base = F.when(a == 1, F.lit(float(init_ms))).otherwise(F.pow(F.lit(float(init_ms)), a.cast("double")))
    return F.when(a == 0, F.lit(0.0)).otherwise(base + jitter).cast("double")


def block_field(block, path: str) -> Column:
    """Read one field of a block payload without parsing the whole document."""
    return F.get_json_object(_c(block), f"$.{path}")


def job_json(webhook_id, height, is_new) -> Column:
    """Wire form of a job as stored in the pending set (ties sort by it)."""
    return F.concat(F.lit('{"WebhookID":"'), _c(webhook_id), F.lit('","BlockHeight":'),
                    _c(height).cast("string"), F.lit(',"IsNew":'),
                    F.when(_c(is_new), F.lit("true")).otherwise(F.lit("false")), F.lit("}"))


def billing_action(event_type) -> Column:
    t = _c(event_type)
    return (F.when(t.isin(*INVALIDATE_TYPES), "invalidate")
             .when(t.isin(*EMAIL_TYPES), "email")
             .when(t.isin(*DELETE_TYPES), "delete_sessions")
             .otherwise("ignore"))


def valid_url(url) -> Column:
    """Absolute URL with a scheme and a host (what a URL parser accepts)."""
    u = _c(url)
    return u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]+([/?#]\S*)?$")


def div_floor(col: Column, width: int) -> Column:
    """Integer floor of ``col / width``, exact over the whole BIGINT range."""
    w = F.lit(width).cast("bigint")
    return F.call_function("div", col.cast("bigint") - F.pmod(col.cast("bigint"), w), w)
