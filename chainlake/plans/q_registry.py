"""Registry queries (§2.2 filters/validation, §2.3 CRUD joins, §2.4 counts, §2.6 paging)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake import fixtures as fx
from chainlake.fixtures import SQL_VIEWS
from chainlake.operators import registry as rg
from chainlake.operators import url_index
from chainlake.plans.catalog import query
from chainlake.sources.store_io import fresh_path

WEBHOOK_COLS = ["id", "created_at", "is_active", "url", "max_blocks", "max_retries", "timeout_ms",
                "customer_id", "blockchain_id", "shard_id"]
_WCOLS = ", ".join(WEBHOOK_COLS)

# --- request tables derived from the driver tables -------------------------

SQL_VIEWS["patch"] = ((), """
    SELECT CAST(c_custkey AS VARCHAR) AS id,
           CASE WHEN c_custkey % 23 = 0 THEN 'nobody' ELSE CAST(c_nationkey AS VARCHAR) END AS customer_id,
           CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'https://patched.example.com/' || CAST(c_custkey AS VARCHAR) END AS url,
           CAST(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 12 END AS INTEGER) AS max_blocks,
           CAST(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 12 END AS INTEGER) AS max_retries,
           CAST(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey * 53) % 11000 END AS INTEGER) AS timeout_ms,
           CAST(NULL AS VARCHAR) AS blockchain_id
    FROM customer""")
SQL_VIEWS["removal"] = (("webhook",), """
    SELECT CASE WHEN url LIKE 'https://automobile%' THEN customer_id ELSE 'other' END AS customer_id, id
    FROM webhook WHERE is_active = 0""")
SQL_VIEWS["activation"] = (("webhook",), """
    SELECT customer_id || ':' || CAST(CAST(id AS BIGINT) // 50 AS VARCHAR) AS request_id,
           CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 'other' ELSE customer_id END AS customer_id, id
    FROM webhook""")


def patches(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.cast("string").alias("id"),
        F.when(F.pmod(k, F.lit(23)) == 0, F.lit("nobody")).otherwise(F.col("c_nationkey").cast("string")).alias("customer_id"),
        F.when(F.pmod(k, F.lit(2)) == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("https://patched.example.com/"), k.cast("string"))).alias("url"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.lit(None)).otherwise(F.pmod(k, F.lit(12))).cast("int").alias("max_blocks"),
        F.when(F.pmod(k, F.lit(5)) == 0, F.lit(None)).otherwise(F.pmod(k, F.lit(12))).cast("int").alias("max_retries"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.lit(None)).otherwise(F.pmod(k * 53, F.lit(11000))).cast("int").alias("timeout_ms"),
        F.lit(None).cast("string").alias("blockchain_id"),
    )


def removals(spark, sf_dir):
    w = fx.webhooks(spark, sf_dir).where(F.col("is_active") == 0)
    return w.select(F.when(F.col("url").startswith("https://automobile"), F.col("customer_id"))
                    .otherwise(F.lit("other")).alias("customer_id"), "id")


def activations(spark, sf_dir):
    w = fx.webhooks(spark, sf_dir)  # one activation request per 50 consecutive ids of an owner
    idn = F.col("id").cast("bigint")
    return w.select(F.concat(F.col("customer_id"), F.lit(":"), F.expr("cast(id as bigint) div 50").cast("string"))
                    .alias("request_id"),
                    F.when(F.pmod(idn, F.lit(7)) == 0, F.lit("other")).otherwise(F.col("customer_id")).alias("customer_id"),
                    "id")


# --- validation ------------------------------------------------------------

_URL_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]+([/?#]\S*)?$"


def _violations_sql(nullable: bool) -> str:
    def nn(col):  # rule applies when the field is present (patch) / always (create)
        return f"{col} IS NOT NULL AND " if nullable else ""

    def req(col):
        return "" if nullable else f"CASE WHEN {col} IS NULL THEN '{col} is required' END, "

    def ints(col, lo, hi):
        return (req(col) + f"CASE WHEN {nn(col)}{col} < {lo} THEN '{col} must be >= {lo}' END, "
                f"CASE WHEN {nn(col)}{col} > {hi} THEN '{col} must be <= {hi}' END")
    return ("list_filter([" + req("url") +
            f"CASE WHEN {nn('url')}length(url) < 1 THEN 'url must have at least 1 character' END, "
            f"CASE WHEN {nn('url')}length(url) > 2048 THEN 'url must have at most 2048 characters' END, "
            f"CASE WHEN {nn('url')}length(url) >= 1 AND NOT regexp_matches(url, '{_URL_RE}') "
            "THEN 'url is not a valid url' END, " +
            ints("max_blocks", 1, 10) + ", " + ints("max_retries", 0, 10) + ", " + ints("timeout_ms", 0, 10000) +
            ", " + req("blockchain_id") +
            f"CASE WHEN {nn('blockchain_id')}length(blockchain_id) > 1024 "
            "THEN 'blockchain_id must have at most 1024 characters' END], lambda x: x IS NOT NULL)")


SQL_VIEWS["checked_input"] = (("webhook_input",), f"""
    SELECT *, {_violations_sql(False)} AS violations FROM webhook_input""")
SQL_VIEWS["checked_patch"] = (("patch",), f"""
    SELECT *, {_violations_sql(True)} AS violations,
           (url IS NOT NULL)::INT + (max_blocks IS NOT NULL)::INT + (max_retries IS NOT NULL)::INT
           + (timeout_ms IS NOT NULL)::INT AS n_fields
    FROM patch""")


@query("validate_webhooks", """
    SELECT request_id, len(violations) = 0 AS valid, array_to_string(violations, '; ') AS violations
    FROM checked_input""", ("checked_input",))
def q_validate_webhooks(spark, sf_dir):
    v = rg.validate_webhooks(fx.webhook_inputs(spark, sf_dir))
    return v.select("request_id", "valid", F.array_join("violations", "; ").alias("violations"))


@query("validate_webhook_patch", """
    SELECT id, len(violations) = 0 AS valid, array_to_string(violations, '; ') AS violations, n_fields
    FROM checked_patch""", ("checked_patch",))
def q_validate_webhook_patch(spark, sf_dir):
    v = rg.validate_webhook_patch(patches(spark, sf_dir))
    return v.select("id", "valid", F.array_join("violations", "; ").alias("violations"), "n_fields")


@query("create_webhooks", f"""
    SELECT i.request_id,
           CASE WHEN len(i.violations) = 0 AND c.id IS NOT NULL THEN 'created' ELSE 'rejected' END AS status,
           CASE WHEN len(i.violations) > 0 THEN 'invalid'
                WHEN c.id IS NULL THEN 'invalid blockchain ID "' || i.blockchain_id || '"' END AS reason,
           CASE WHEN len(i.violations) = 0 AND c.id IS NOT NULL THEN 'wh-' || i.request_id END AS id,
           CASE WHEN len(i.violations) = 0 AND c.id IS NOT NULL
                THEN CAST(CAST(i.request_id AS BIGINT) % c.shard_count AS INTEGER) END AS shard_id
    FROM checked_input i LEFT JOIN chain c ON c.id = i.blockchain_id""", ("checked_input", "chain"))
def q_create_webhooks(spark, sf_dir):
    created, rejected = rg.create_webhooks(
        fx.webhook_inputs(spark, sf_dir), fx.chains(spark, sf_dir),
        id_col=F.concat(F.lit("wh-"), F.col("request_id")),
        created_at=F.lit(fx.EPOCH).cast("timestamp_ntz"),
        shard_col=F.pmod(F.col("request_id").cast("bigint"), F.col("shard_count")).cast("int"))
    c = created.select(F.expr("substring(id, 4)").alias("request_id"), F.lit("created").alias("status"),
                       F.lit(None).cast("string").alias("reason"), "id", "shard_id")
    r = rejected.select("request_id", F.lit("rejected").alias("status"), "reason",
                        F.lit(None).cast("string").alias("id"), F.lit(None).cast("int").alias("shard_id"))
    return c.unionByName(r)


_UPDATE_SQL = f"""
    SELECT w.id, w.created_at, w.is_active,
           CASE WHEN hit THEN coalesce(p.url, w.url) ELSE w.url END AS url,
           CASE WHEN hit THEN coalesce(p.max_blocks, w.max_blocks) ELSE w.max_blocks END AS max_blocks,
           CASE WHEN hit THEN coalesce(p.max_retries, w.max_retries) ELSE w.max_retries END AS max_retries,
           CASE WHEN hit THEN coalesce(p.timeout_ms, w.timeout_ms) ELSE w.timeout_ms END AS timeout_ms,
           w.customer_id, w.blockchain_id, w.shard_id
    FROM (SELECT w.*, p.id IS NOT NULL AND p.customer_id = w.customer_id AS hit FROM webhook w
          LEFT JOIN (SELECT * FROM checked_patch WHERE len(violations) = 0 AND n_fields > 0) p ON p.id = w.id) w
    LEFT JOIN checked_patch p ON p.id = w.id"""


@query("update_webhooks", _UPDATE_SQL, ("webhook", "checked_patch"))
def q_update_webhooks(spark, sf_dir):
    out, _ = rg.update_webhooks(fx.webhooks(spark, sf_dir), patches(spark, sf_dir))
    return out


@query("affected_counts", """
    SELECT w.customer_id, count(*) AS affected FROM webhook w
    JOIN (SELECT * FROM checked_patch WHERE len(violations) = 0 AND n_fields > 0) p
      ON p.id = w.id AND p.customer_id = w.customer_id
    GROUP BY w.customer_id""", ("webhook", "checked_patch"))
def q_affected_counts(spark, sf_dir):
    _, counts = rg.update_webhooks(fx.webhooks(spark, sf_dir), patches(spark, sf_dir))
    return counts


@query("remove_webhooks", f"""
    SELECT {_WCOLS} FROM webhook w
    WHERE NOT EXISTS (SELECT 1 FROM removal r WHERE r.id = w.id AND r.customer_id = w.customer_id)""",
       ("webhook", "removal"))
def q_remove_webhooks(spark, sf_dir):
    out, _ = rg.remove_webhooks(fx.webhooks(spark, sf_dir), removals(spark, sf_dir))
    return out.select(*WEBHOOK_COLS)


@query("remove_counts", """
    SELECT w.customer_id, count(*) AS affected FROM webhook w
    JOIN removal r ON r.id = w.id AND r.customer_id = w.customer_id GROUP BY w.customer_id""",
       ("webhook", "removal"))
def q_remove_counts(spark, sf_dir):
    _, counts = rg.remove_webhooks(fx.webhooks(spark, sf_dir), removals(spark, sf_dir))
    return counts


SQL_VIEWS["activation_ok"] = (("activation", "webhook"), """
    SELECT a.request_id, a.id, w.blockchain_id, w.shard_id, w.is_active
    FROM activation a JOIN webhook w ON w.id = a.id AND w.customer_id = a.customer_id WHERE w.is_active = 0""")


def _activate(spark, sf_dir):
    w = fx.webhooks(spark, sf_dir)
    active = w.where(F.col("is_active") == 1).select("id")
    return rg.activate_webhooks(w, active, activations(spark, sf_dir))


@query("activate_webhooks", """
    SELECT DISTINCT id AS webhook_id, blockchain_id AS chain_id, shard_id, CAST(0 AS BIGINT) AS next_height,
           true AS is_new
    FROM activation_ok WHERE is_active = 0""", ("activation_ok",))
def q_activate_webhooks(spark, sf_dir):
    _, jobs, _, _ = _activate(spark, sf_dir)
    return jobs


@query("activate_counts", """
    SELECT a.request_id, count(o.id) AS activated FROM activation a
    LEFT JOIN activation_ok o ON o.request_id = a.request_id AND o.id = a.id GROUP BY a.request_id""",
       ("activation", "activation_ok"))
def q_activate_counts(spark, sf_dir):
    _, _, _, counts = _activate(spark, sf_dir)
    return counts


@query("active_set", """
    SELECT id FROM webhook WHERE is_active = 1 UNION SELECT id FROM activation_ok""",
       ("webhook", "activation_ok"))
def q_active_set(spark, sf_dir):
    _, _, new_set, _ = _activate(spark, sf_dir)
    return new_set


@query("group_activation", """
    SELECT a.request_id, a.blockchain_id AS chain_id, c.url AS cluster_url, a.shard_id,
           string_agg(a.id, ',' ORDER BY a.id) AS ids, count(*) AS n_ids
    FROM (SELECT DISTINCT request_id, id, blockchain_id, shard_id FROM activation_ok WHERE is_active = 0) a
    JOIN chain c ON c.id = a.blockchain_id
    GROUP BY a.request_id, a.blockchain_id, c.url, a.shard_id""", ("activation_ok", "chain"))
def q_group_activation(spark, sf_dir):
    w = fx.webhooks(spark, sf_dir)
    ok = (activations(spark, sf_dir).join(w.select("id", "customer_id", "blockchain_id", "shard_id", "is_active"),
                                          ["id", "customer_id"])
          .where(F.col("is_active") == 0)
          .select("request_id", F.col("id").alias("webhook_id"), F.col("blockchain_id").alias("chain_id"), "shard_id")
          .distinct())
    return rg.group_activation(ok, fx.chains(spark, sf_dir))


@query("webhooks_with_blockchain", """
    SELECT w.id, w.blockchain_id, c.shard_count, c.url AS chain_url
    FROM webhook w JOIN chain c ON c.id = w.blockchain_id""", ("webhook", "chain"))
def q_webhooks_with_blockchain(spark, sf_dir):
    c = fx.chains(spark, sf_dir).select(F.col("id").alias("blockchain_id"), "shard_count",
                                        F.col("url").alias("chain_url"))
    return fx.webhooks(spark, sf_dir).join(c, "blockchain_id").select("id", "blockchain_id", "shard_count", "chain_url")


@query("shard_distribution", """
    SELECT blockchain_id, shard_id, count(*) AS n_webhooks FROM webhook GROUP BY blockchain_id, shard_id""",
       ("webhook",))
def q_shard_distribution(spark, sf_dir):
    return (fx.webhooks(spark, sf_dir).groupBy("blockchain_id", "shard_id")
            .agg(F.count(F.lit(1)).alias("n_webhooks")))


@query("register_customers", """
    SELECT customer_id AS id, created_at FROM session
    UNION ALL
    SELECT u AS id, min(ts) AS created_at FROM (SELECT CAST(user_id AS VARCHAR) AS u, ts FROM events) e
    WHERE NOT EXISTS (SELECT 1 FROM session s WHERE s.customer_id = e.u) GROUP BY u""", ("session",))
def q_register_customers(spark, sf_dir):
    existing = fx.sessions(spark, sf_dir).select(F.col("customer_id").alias("id"), "created_at")
    seen = fx.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id"), "ts")
    return rg.register_customers(existing, seen)


@query("search_webhooks", f"""
    SELECT {_WCOLS} FROM webhook
    WHERE blockchain_id = 'ASIA' AND is_active = 0 AND url ILIKE '%hooks/1%'""", ("webhook",))
def q_search_webhooks(spark, sf_dir):
    return rg.search_webhooks(fx.webhooks(spark, sf_dir), None, blockchain_id="ASIA", is_active=False,
                              url_like="HOOKS/1")


SQL_VIEWS["url_search"] = (("webhook",), """
    SELECT CAST(id AS BIGINT) AS request_id, customer_id,
           CASE WHEN CAST(id AS BIGINT) % 100 = 7 THEN NULL
                WHEN CAST(id AS BIGINT) % 5 = 0 THEN upper(substr(url, 12, 9))
                WHEN CAST(id AS BIGINT) % 5 = 1 THEN 'M_CH%/' || id
                WHEN CAST(id AS BIGINT) % 5 = 2 THEN right(id, 2)
                WHEN CAST(id AS BIGINT) % 5 = 3 THEN '\\' || id
                ELSE 'HOOKS/' || id END AS pattern
    FROM webhook""")


def url_searches(w):
    """One search per webhook over its owner's urls: pieces, wildcards, short patterns, backslashes, none."""
    k = F.col("id").cast("bigint")
    pattern = (F.when(k % 100 == 7, F.lit(None).cast("string"))
               .when(k % 5 == 0, F.upper(F.substring("url", 12, 9)))
               .when(k % 5 == 1, F.concat(F.lit("M_CH%/"), "id"))
               .when(k % 5 == 2, F.expr("right(id, 2)"))
               .when(k % 5 == 3, F.concat(F.lit("\\"), "id"))
               .otherwise(F.concat(F.lit("HOOKS/"), "id")))
    return w.select(k.alias("request_id"), "customer_id", pattern.alias("pattern"))


@query("search_webhooks_indexed", """
    SELECT r.request_id, w.id, w.url FROM url_search r JOIN webhook w ON w.customer_id = r.customer_id
    WHERE r.pattern IS NULL OR w.url ILIKE '%' || r.pattern || '%'""", ("url_search", "webhook"))
def q_search_webhooks_indexed(spark, sf_dir):
    """All searches at once over the stored trigram postings; only the rarest pieces are joined."""
    w = fx.webhooks(spark, sf_dir)
    index = url_index.UrlIndex(spark, fresh_path(spark, "url-index"))
    index.add(w)
    return url_index.search(index.read(), w, url_searches(w)).select("request_id", "id", "url")


@query("group_activation_parts", """
    WITH r AS (SELECT w.customer_id, w.blockchain_id, w.shard_id, w.id, c.url,
                      (row_number() OVER (PARTITION BY w.customer_id, w.blockchain_id, w.shard_id ORDER BY w.id) - 1)
                      // 50 AS part
               FROM webhook w JOIN chain c ON c.id = w.blockchain_id)
    SELECT customer_id, blockchain_id AS chain_id, url AS cluster_url, shard_id, CAST(part AS INTEGER) AS part,
           string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n_ids
    FROM r GROUP BY ALL""", ("webhook", "chain"))
def q_group_activation_parts(spark, sf_dir):
    """Activation of everything a customer owns: requests of any size, ids in parts of at most 50."""
    jobs = fx.webhooks(spark, sf_dir).select("customer_id", F.col("id").alias("webhook_id"),
                                             F.col("blockchain_id").alias("chain_id"), "shard_id")
    return rg.grouped_ids(jobs, fx.chains(spark, sf_dir), "customer_id")


@query("keyset_predicate", f"""
    SELECT {_WCOLS} FROM webhook
    WHERE created_at < TIMESTAMP '2024-01-01 02:00:00'
       OR (created_at = TIMESTAMP '2024-01-01 02:00:00' AND id < '360')""", ("webhook",))
def q_keyset_predicate(spark, sf_dir):
    w = fx.webhooks(spark, sf_dir)
    return w.where(rg.keyset_predicate(F.lit("2024-01-01 02:00:00").cast("timestamp_ntz"), F.lit("360"), False))


_IDS = [str(i) for i in range(0, 500, 10)]


@query("ids_filter", f"""
    SELECT {_WCOLS} FROM webhook WHERE customer_id = '7' AND id IN ({", ".join(repr(i) for i in _IDS)})""",
       ("webhook",))
def q_ids_filter(spark, sf_dir):
    return rg.ids_filter(fx.webhooks(spark, sf_dir), "7", _IDS)


@query("webhook_public_view", """
    SELECT id, created_at, is_active, url, max_blocks, max_retries, timeout_ms, customer_id, blockchain_id
    FROM webhook""", ("webhook",))
def q_webhook_public_view(spark, sf_dir):
    return rg.webhook_public_view(fx.webhooks(spark, sf_dir))


@query("find_webhook", f"SELECT {_WCOLS} FROM webhook WHERE customer_id = '2' AND id = '0'", ("webhook",))
def q_find_webhook(spark, sf_dir):
    return rg.find_webhook(fx.webhooks(spark, sf_dir), "2", "0")


@query("webhook_by_id", f"SELECT {_WCOLS} FROM webhook WHERE id = '42' LIMIT 1", ("webhook",))
def q_webhook_by_id(spark, sf_dir):
    return rg.webhook_by_id(fx.webhooks(spark, sf_dir), "42")


@query("cursor_row", """
    SELECT created_at AS cursor_created_at, id AS cursor_id FROM webhook WHERE customer_id = '2' AND id = '0'""",
       ("webhook",))
def q_cursor_row(spark, sf_dir):
    return rg.cursor_row(fx.webhooks(spark, sf_dir), "2", "0")


# --- keyset pages ------------------------------------------------------------

SQL_VIEWS["page1"] = (("webhook",), f"""
    SELECT {_WCOLS}, cnt > 5 AS has_next, false AS has_prev, CAST(rn AS INTEGER) AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, id DESC) AS rn,
             count(*) OVER (PARTITION BY customer_id) AS cnt FROM webhook) WHERE rn <= 5""")
SQL_VIEWS["page2"] = (("webhook", "page1"), f"""
    WITH cur AS (SELECT customer_id, created_at AS cc, id AS ci FROM page1 WHERE position = 5),
    fwd AS (SELECT w.*, row_number() OVER (PARTITION BY w.customer_id ORDER BY w.created_at DESC, w.id DESC) AS rn,
                   count(*) OVER (PARTITION BY w.customer_id) AS cnt
            FROM webhook w JOIN cur c ON c.customer_id = w.customer_id
            WHERE w.created_at < c.cc OR (w.created_at = c.cc AND w.id < c.ci))
    SELECT {_WCOLS}, cnt > 5 AS has_next, true AS has_prev, CAST(rn AS INTEGER) AS position FROM fwd WHERE rn <= 5
    UNION ALL
    SELECT p.* FROM page1 p WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.customer_id = p.customer_id)""")
SQL_VIEWS["page_back"] = (("webhook", "page1", "page2"), f"""
    WITH cur AS (SELECT customer_id, created_at AS cc, id AS ci FROM page2 WHERE position = 1),
    rev AS (SELECT w.*, row_number() OVER (PARTITION BY w.customer_id ORDER BY w.created_at ASC, w.id ASC) AS rn,
                   count(*) OVER (PARTITION BY w.customer_id) AS cnt
            FROM webhook w JOIN cur c ON c.customer_id = w.customer_id
            WHERE w.created_at > c.cc OR (w.created_at = c.cc AND w.id > c.ci)),
    revp AS (SELECT *, count(*) OVER (PARTITION BY customer_id) AS n_page FROM rev WHERE rn <= 5)
    SELECT {_WCOLS}, true AS has_next, cnt > 5 AS has_prev, CAST(n_page - rn + 1 AS INTEGER) AS position FROM revp
    UNION ALL
    SELECT p.* FROM page1 p WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.customer_id = p.customer_id)""")


def _page1(spark, sf_dir):
    return rg.webhook_pages(fx.webhooks(spark, sf_dir), 5)


def _cursor_of(page, position, reverse):
    return page.where(F.col("position") == position).select(
        "customer_id", F.col("created_at").alias("cursor_created_at"), F.col("id").alias("cursor_id"),
        F.lit(reverse).alias("reverse"))


@query("webhook_page", f"""
    SELECT {_WCOLS}, has_next, has_prev, position FROM page1 WHERE customer_id = '2'""", ("page1",))
def q_webhook_page(spark, sf_dir):
    return rg.webhook_page(fx.webhooks(spark, sf_dir), "2", 5)


@query("webhook_pages", "SELECT * FROM page1", ("page1",))
def q_webhook_pages(spark, sf_dir):
    return _page1(spark, sf_dir)


@query("webhook_pages_next", "SELECT * FROM page2", ("page2",))
def q_webhook_pages_next(spark, sf_dir):
    w = fx.webhooks(spark, sf_dir)
    return rg.webhook_pages(w, 5, _cursor_of(_page1(spark, sf_dir), 5, False))


@query("webhook_pages_back", "SELECT * FROM page_back", ("page_back",))
def q_webhook_pages_back(spark, sf_dir):
    # forward to page 2, then back from its first row: page 1 again
    w = fx.webhooks(spark, sf_dir)
    page2 = rg.webhook_pages(w, 5, _cursor_of(_page1(spark, sf_dir), 5, False))
    return rg.webhook_pages(w, 5, _cursor_of(page2, 1, True))
