"""Webhook registry: validation, create/update/remove/activate, search and
keyset paging -- all as DataFrame operators over request tables, so that a
batch of API calls (or a backfill) is one Spark job.

Registry schema: ``id, created_at, is_active (0/1), url, max_blocks,
max_retries, timeout_ms, customer_id, blockchain_id, shard_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlake.functions import columns as C
from chainlake.operators.ranks import rank_in_groups

PUBLIC_COLUMNS = ["id", "created_at", "is_active", "url", "max_blocks", "max_retries", "timeout_ms",
                  "customer_id", "blockchain_id"]


def webhook_public_view(webhooks: DataFrame) -> DataFrame:
    """The columns a customer sees (the shard is internal)."""
    return webhooks.select(*PUBLIC_COLUMNS)


def find_webhook(webhooks: DataFrame, customer_id: str, webhook_id: str) -> DataFrame:
    """The webhook if the customer owns it, else no row."""
    return webhooks.where((F.col("customer_id") == customer_id) & (F.col("id") == webhook_id))


def webhook_by_id(webhooks: DataFrame, webhook_id: str) -> DataFrame:
    return webhooks.where(F.col("id") == webhook_id).limit(1)


def ids_filter(webhooks: DataFrame, customer_id: str, ids: list[str]) -> DataFrame:
    """Rows among ``ids`` (at most 50 per call) owned by the customer."""
    if len(ids) > C.MAX_IDS:
        raise ValueError(f"at most {C.MAX_IDS} ids per call")
    return webhooks.where((F.col("customer_id") == customer_id) & F.col("id").isin(list(ids)))


def _rule(cond: Column, message: str) -> Column:
    return F.when(cond, F.lit(message))


def _int_rules(col: str, lo: int, hi: int, nullable: bool) -> list[Column]:
    c = F.col(col)
    ok_null = c.isNull() if nullable else F.lit(False)
    return [
        _rule(~ok_null & c.isNull(), f"{col} is required"),
        _rule(~ok_null & (c < lo), f"{col} must be >= {lo}"),
        _rule(~ok_null & (c > hi), f"{col} must be <= {hi}"),
    ]


def _violations(nullable: bool) -> Column:
    url = F.col("url")
    url_null = url.isNull() if nullable else F.lit(False)
    chain = F.col("blockchain_id")
    chain_null = chain.isNull() if nullable else F.lit(False)
    rules = [
        _rule(~url_null & url.isNull(), "url is required"),
        _rule(~url_null & (F.length(url) < C.URL_LEN_MIN), f"url must have at least {C.URL_LEN_MIN} character"),
        _rule(~url_null & (F.length(url) > C.URL_LEN_MAX), f"url must have at most {C.URL_LEN_MAX} characters"),
        _rule(~url_null & (F.length(url) >= C.URL_LEN_MIN) & ~C.valid_url(url), "url is not a valid url"),
        *_int_rules("max_blocks", C.MAX_BLOCKS_MIN, C.MAX_BLOCKS_MAX, nullable),
        *_int_rules("max_retries", C.MAX_RETRIES_MIN, C.MAX_RETRIES_MAX, nullable),
        *_int_rules("timeout_ms", C.TIMEOUT_MS_MIN, C.TIMEOUT_MS_MAX, nullable),
        _rule(~chain_null & chain.isNull(), "blockchain_id is required"),
        _rule(~chain_null & (F.length(chain) > C.BLOCKCHAIN_ID_MAX),
              f"blockchain_id must have at most {C.BLOCKCHAIN_ID_MAX} characters"),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def validate_webhooks(requests: DataFrame) -> DataFrame:
    """Create requests with ``violations`` (array of messages) and ``valid``."""
    return (requests.withColumn("violations", _violations(nullable=False))
            .withColumn("valid", F.size("violations") == 0))


def validate_webhook_patch(patches: DataFrame) -> DataFrame:
    """Update patches: same ranges, every field optional; an all-null patch
    is valid and changes nothing (``n_fields`` = 0)."""
    fields = ["url", "max_blocks", "max_retries", "timeout_ms"]
    n = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    return (patches.withColumn("violations", _violations(nullable=True))
            .withColumn("valid", F.size("violations") == 0)
            .withColumn("n_fields", n))


def create_webhooks(requests: DataFrame, chains: DataFrame, id_col: Column | None = None,
                    created_at: Column | None = None, shard_col: Column | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """Insert valid requests whose chain exists: ``(created, rejected)``.

    New webhooks are inactive; the shard is a deterministic function of the
    id over the chain's shard count (a replay assigns the same shard).  The
    chain registry is a small dimension joined by the planner's size check.
    """
    v = validate_webhooks(requests)
    ch = chains.select(F.col("id").alias("blockchain_id"), "shard_count")
    known = v.join(ch, "blockchain_id", "left")
    ok = F.col("valid") & F.col("shard_count").isNotNull()
    wid = id_col if id_col is not None else F.expr("uuid()")
    created = (known.where(ok)
               .withColumn("id", wid)
               .select("id",
                       (created_at if created_at is not None else F.current_timestamp().cast("timestamp_ntz"))
                       .alias("created_at"),
                       F.lit(0).alias("is_active"), "url", "max_blocks", "max_retries", "timeout_ms",
                       "customer_id", "blockchain_id",
                       (shard_col if shard_col is not None else C.assign_shard(F.col("id"), F.col("shard_count")))
                       .alias("shard_id")))
    rejected = (known.where(~ok)
                .withColumn("reason", F.when(~F.col("valid"), F.lit("invalid"))
                            .otherwise(F.concat(F.lit('invalid blockchain ID "'), F.col("blockchain_id"), F.lit('"'))))
                .drop("shard_count"))
    return created, rejected


def update_webhooks(webhooks: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``patches(id, customer_id, url?, max_blocks?, max_retries?,
    timeout_ms?)``: null keeps the old value; only the owner's rows change.
    Several patches of one webhook are applied in the order of their ``seq``
    (then of the value): each field takes its last non-null value.
    Returns ``(registry, affected_counts per customer)``."""
    p = validate_webhook_patch(patches).where(F.col("valid") & (F.col("n_fields") > 0))
    p = p if "seq" in p.columns else p.withColumn("seq", F.lit(0))
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(f"_new_{c}")
            for c in ("url", "max_blocks", "max_retries", "timeout_ms")]
    p = p.groupBy("id", F.col("customer_id").alias("_owner")).agg(*last)
    j = webhooks.join(p, (webhooks["id"] == p["id"]) & (webhooks["customer_id"] == p["_owner"]), "left").drop(p["id"])
    hit = F.col("_owner").isNotNull()
    out = j.select(*[F.when(hit, F.coalesce(F.col(f"_new_{c}"), F.col(c))).otherwise(F.col(c)).alias(c)
                     if c in ("url", "max_blocks", "max_retries", "timeout_ms") else F.col(c)
                     for c in webhooks.columns])
    counts = j.where(hit).groupBy("customer_id").agg(F.count(F.lit(1)).alias("affected"))
    return out, counts


def remove_webhooks(webhooks: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete ``removals(customer_id, id)`` rows the customer owns: ``(registry, counts)``."""
    r = removals.select("customer_id", "id").distinct()
    hit = webhooks.join(r, ["customer_id", "id"], "left_semi")
    counts = hit.groupBy("customer_id").agg(F.count(F.lit(1)).alias("affected"))
    return webhooks.join(r, ["customer_id", "id"], "left_anti"), counts


def activate_webhooks(webhooks: DataFrame, active_set: DataFrame, requests: DataFrame
                      ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Activate ``requests(request_id, customer_id, id)``.

    Only the owner's existing, inactive ids count.  Ids not yet in the active set get
    a job ``(height 0, is_new)``; every such id joins the set; the flag
    becomes 1.  Returns ``(registry, new_jobs, new_active_set, counts)``
    where counts is the true number activated per request.
    """
    inactive = webhooks.where(F.col("is_active") == 0)
    ok = requests.join(inactive.select("id", "customer_id", "blockchain_id", "shard_id"), ["id", "customer_id"])
    fresh = ok.join(active_set.select("id"), "id", "left_anti")
    jobs = fresh.select(F.col("id").alias("webhook_id"), F.col("blockchain_id").alias("chain_id"), "shard_id",
                        F.lit(0).cast("bigint").alias("next_height"), F.lit(True).alias("is_new")).distinct()
    new_set = active_set.select("id").unionByName(ok.select("id")).distinct()
    ids = ok.select("id").distinct().withColumn("_hit", F.lit(True))
    registry = (webhooks.join(ids, "id", "left")
                .withColumn("is_active", F.when(F.col("_hit"), F.lit(1)).otherwise(F.col("is_active")))
                .drop("_hit").select(*webhooks.columns))
    counts = (requests.join(ok.select("request_id", "id").distinct().withColumn("_ok", F.lit(1)),
                            ["request_id", "id"], "left")
              .groupBy("request_id").agg(F.count("_ok").alias("activated")))
    return registry, jobs, new_set, counts


def group_activation(jobs: DataFrame, chains: DataFrame, request_col: str = "request_id") -> DataFrame:
    """Nested routing of one activation request: chain (cluster) -> shard ->
    ids.  A request may carry ``MAX_IDS`` ids, which bounds every group; the
    rows of a larger one are marked by null ``ids`` beside their ``n_ids``,
    and none of its ids are collected."""
    ch = chains.select(F.col("id").alias("chain_id"), F.col("url").alias("cluster_url"))
    large = (jobs.groupBy(request_col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > C.MAX_IDS)
             .select(F.col(request_col).alias("_request"), F.lit(True).alias("_large")))
    ids = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_large").isNull(), F.col("webhook_id")))), ",")
    return (jobs.join(large, F.col(request_col).eqNullSafe(F.col("_request")), "left").join(ch, "chain_id")
            .groupBy(request_col, "chain_id", "cluster_url", "shard_id")
            .agg(F.when(F.max("_large").isNull(), ids).alias("ids"), F.count(F.lit(1)).alias("n_ids")))


def grouped_ids(jobs: DataFrame, chains: DataFrame, request_col: str = "request_id") -> DataFrame:
    """Activation routing for requests of any size: rows ``(request, chain,
    cluster_url, shard, part, ids, n_ids)``, the ids of a group in lists of at most
    ``MAX_IDS``, ascending within and over the parts.

    The place of an id in its group comes from counts per range of ids and
    ranks inside the ranges, so no group is sorted or collected in one task."""
    group = [request_col, "chain_id", "shard_id"]
    ranked = rank_in_groups(jobs.select(*group, "webhook_id").distinct(), group, "webhook_id")
    ch = chains.select(F.col("id").alias("chain_id"), F.col("url").alias("cluster_url"))
    part = F.floor(F.col("rank") / C.MAX_IDS).cast("int")
    return (ranked.withColumn("part", part).join(ch, "chain_id")
            .groupBy(request_col, "chain_id", "cluster_url", "shard_id", "part")
            .agg(F.array_join(F.array_sort(F.collect_list("webhook_id")), ",").alias("ids"),
                 F.count(F.lit(1)).alias("n_ids")))


def register_customers(customers: DataFrame, seen_users: DataFrame) -> DataFrame:
    """Insert-ignore of first-seen users into ``customers(id, created_at)``."""
    new = seen_users.select(F.col("user_id").alias("id"), F.col("ts").alias("created_at"))
    first = new.groupBy("id").agg(F.min("created_at").alias("created_at"))
    return customers.select("id", "created_at").unionByName(
        first.join(customers.select("id"), "id", "left_anti"))


def search_webhooks(webhooks: DataFrame, customer_id: str | Column | None = None,
                    blockchain_id: str | None = None, is_active: bool | None = None,
                    url_like: str | None = None, case_sensitive: bool = False) -> DataFrame:
    """Optional AND filters; ``None`` or ``""`` means no filter.  ``is_active``
    honours both true and false; ``url_like`` is a substring match."""
    df = webhooks
    if customer_id is not None:
        df = df.where(F.col("customer_id") == (customer_id if isinstance(customer_id, Column) else F.lit(customer_id)))
    if blockchain_id:
        df = df.where(F.col("blockchain_id") == blockchain_id)
    if is_active is not None:
        df = df.where(F.col("is_active") == (1 if is_active else 0))
    if url_like:
        pat = "%" + url_like.replace("\\", "\\\\") + "%"  # a backslash is itself
        df = df.where(F.col("url").like(pat) if case_sensitive else F.col("url").ilike(pat))
    return df


def keyset_predicate(cursor_created_at: Column, cursor_id: Column, reverse: bool | Column) -> Column:
    """Rows strictly before the cursor in ``(created_at, id)`` descending
    order (``reverse``: strictly after)."""
    after = ((F.col("created_at") > cursor_created_at) |
             ((F.col("created_at") == cursor_created_at) & (F.col("id") > cursor_id)))
    before = ((F.col("created_at") < cursor_created_at) |
              ((F.col("created_at") == cursor_created_at) & (F.col("id") < cursor_id)))
    rev = reverse if isinstance(reverse, Column) else F.lit(reverse)
    return F.when(rev, after).otherwise(before)


def cursor_row(webhooks: DataFrame, customer_id: str, cursor_id: str) -> DataFrame:
    """The cursor's own row, only if the same customer owns it."""
    return find_webhook(webhooks, customer_id, cursor_id).select(
        F.col("created_at").alias("cursor_created_at"), F.col("id").alias("cursor_id"))


def page_limit(limit: int) -> int:
    """The limit as asked for; a negative one is an error, none is cut silently."""
    if int(limit) < 0:
        raise ValueError(f"page limit must not be negative: {limit}")
    return int(limit)


def webhook_page(webhooks: DataFrame, customer_id: str, limit: int, cursor_id: str | None = None,
                 reverse: bool = False, **filters) -> DataFrame:
    """One page for one customer (the API form): ``limit + 1`` rows by
    ``(created_at, id)`` desc (asc when reverse), the extra row only sets the
    flags.  An unknown cursor id gives the first page.  Adds ``has_next``,
    ``has_prev`` and ``position`` (display order)."""
    limit = page_limit(limit)
    base = search_webhooks(webhooks, customer_id, **filters)
    cursors = None
    if cursor_id is not None:
        cursors = (cursor_row(webhooks, customer_id, cursor_id)
                   .withColumn("customer_id", F.lit(customer_id)).withColumn("reverse", F.lit(reverse)))
    return webhook_pages(base, limit, cursors)


def webhook_pages(webhooks: DataFrame, limit: int, cursors: DataFrame | None = None) -> DataFrame:
    """Pages for many customers at once.  ``cursors(customer_id,
    cursor_created_at, cursor_id, reverse)`` holds at most one row per
    customer; customers without a cursor get their first page.

    ``row_number() <= limit + 1`` per customer is planned as a
    WindowGroupLimit: each task keeps limit+1 rows per customer before the
    shuffle, so a customer with a third of all webhooks is still cheap.
    """
    limit = page_limit(limit)
    if cursors is None:
        df = webhooks.withColumn("reverse", F.lit(False)).withColumn("_first", F.lit(True))
    else:
        df = (webhooks.join(cursors.select("customer_id", "cursor_created_at", "cursor_id", "reverse"),
                            "customer_id", "left")
              .withColumn("_first", F.col("cursor_id").isNull())
              .withColumn("reverse", F.coalesce("reverse", F.lit(False)) & ~F.col("_first"))
              .where(F.col("_first") | keyset_predicate(F.col("cursor_created_at"), F.col("cursor_id"),
                                                        F.col("reverse"))))
    w_desc = Window.partitionBy("customer_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    w_asc = Window.partitionBy("customer_id").orderBy(F.col("created_at").asc(), F.col("id").asc())
    # one window per direction so each filter is a plain rank limit
    fwd = df.where(~F.col("reverse")).withColumn("_rn", F.row_number().over(w_desc)).where(F.col("_rn") <= limit + 1)
    rev = df.where(F.col("reverse")).withColumn("_rn", F.row_number().over(w_asc)).where(F.col("_rn") <= limit + 1)
    df = fwd.unionByName(rev)
    more = F.max("_rn").over(Window.partitionBy("customer_id")) > limit
    df = df.withColumn("_more", more).where(F.col("_rn") <= limit)
    has_next = F.when(F.col("_more"), F.lit(True)).when(F.col("_first"), F.lit(False)).otherwise(F.col("reverse"))
    has_prev = (F.when(F.col("_more"), ~F.col("_first")).when(F.col("_first"), F.lit(False))
                .otherwise(~F.col("reverse")))
    # display order is always descending: a reverse page is flipped back
    position = F.when(F.col("reverse"), F.count(F.lit(1)).over(Window.partitionBy("customer_id")) - F.col("_rn") + 1
                      ).otherwise(F.col("_rn"))
    return df.select(*[c for c in webhooks.columns], has_next.alias("has_next"), has_prev.alias("has_prev"),
                     position.cast("int").alias("position"))
