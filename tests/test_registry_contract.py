import pytest

"""Registry CRUD contract: create, update, read, activate, remove, list."""

from pyspark.sql import functions as F

from chainlake.operators import registry as rg

REQ = "request_id string, url string, max_blocks int, max_retries int, timeout_ms int, blockchain_id string, customer_id string"


def test_crud_flow(spark):
    chains = spark.createDataFrame([("chain-1", 2, "rpc://x")], "id string, shard_count int, url string")
    req = spark.createDataFrame([("r1", "http://fakeurl.com", 10, 10, 1000, "chain-1", "user-1"),
                                 ("r2", "http://fakeurl.com", 10, 10, 1000, "nope", "user-1"),
                                 ("r3", "not a url", 0, 11, 20000, "chain-1", "user-1")], REQ)
    created, rejected = rg.create_webhooks(req, chains, id_col=F.lit("wh-1"))
    rows = created.collect()
    assert len(rows) == 1 and rows[0].is_active == 0 and rows[0].shard_id in (0, 1)
    assert {r.request_id for r in rejected.collect()} == {"r2", "r3"}
    reg = created
    patch = spark.createDataFrame([("wh-1", "user-1", None, 1, None, None, None)],
                                  "id string, customer_id string, url string, max_blocks int, max_retries int, "
                                  "timeout_ms int, blockchain_id string")
    reg, counts = rg.update_webhooks(reg, patch)
    assert counts.collect()[0].affected == 1
    row = rg.find_webhook(reg, "user-1", "wh-1").collect()[0]
    assert (row.max_blocks, row.max_retries, row.url) == (1, 10, "http://fakeurl.com")
    assert rg.find_webhook(reg, "user-2", "wh-1").count() == 0
    active = spark.createDataFrame([], "id string")
    for ids, expect in (([], 0), (["unknown"], 0), (["wh-1"], 1)):
        r = spark.createDataFrame([("q", "user-1", i) for i in ids], "request_id string, customer_id string, id string")
        reg2, jobs, new_set, cnt = rg.activate_webhooks(reg, active, r)
        assert jobs.count() == expect
    reg, jobs, active, _ = rg.activate_webhooks(reg, active, spark.createDataFrame(
        [("q", "user-1", "wh-1")], "request_id string, customer_id string, id string"))
    assert reg.collect()[0].is_active == 1
    j = jobs.collect()[0]
    assert (j.next_height, j.is_new) == (0, True)
    # activating again creates no second job
    _, jobs2, _, _ = rg.activate_webhooks(reg, active, spark.createDataFrame(
        [("q", "user-1", "wh-1")], "request_id string, customer_id string, id string"))
    assert jobs2.count() == 0
    for ids, expect in (([], 0), (["unknown"], 0), (["wh-1"], 1)):
        rem = spark.createDataFrame([("user-1", i) for i in ids], "customer_id string, id string")
        reg2, cnt = rg.remove_webhooks(reg, rem)
        got = cnt.collect()
        assert (got[0].affected if got else 0) == expect
    reg, _ = rg.remove_webhooks(reg, spark.createDataFrame([("user-1", "wh-1")], "customer_id string, id string"))
    assert rg.search_webhooks(reg, "user-1").count() == 0


def test_validation_messages(spark):
    req = spark.createDataFrame([("r", "", 11, -1, 10001, "x" * 1025, "u")], REQ)
    v = rg.validate_webhooks(req).collect()[0]
    assert not v.valid
    assert set(v.violations) == {"url must have at least 1 character", "max_blocks must be <= 10",
                                 "max_retries must be >= 0", "timeout_ms must be <= 10000",
                                 "blockchain_id must have at most 1024 characters"}


def test_limit_is_not_cut():
    assert rg.page_limit(100) == 100
    with pytest.raises(ValueError):
        rg.page_limit(-3)


WEBHOOK = ("id string, customer_id string, blockchain_id string, shard_id int, is_active int, url string, max_blocks int, "
           "max_retries int, timeout_ms int")


def test_two_patches_of_one_webhook_give_one_row(spark):
    w = spark.createDataFrame([("w", "c", "b", 0, 0, "u", 1, 1, 1), ("x", "c", "b", 0, 0, "u", 1, 1, 1)], WEBHOOK)
    p = spark.createDataFrame([("w", "c", "b", "https://new.example.com", 5, None, None, 2), ("w", "c", "b", "https://old.example.com", None, 3, None, 1),
                               ("w", "other", "b", "https://no.example.com", 9, 9, 9, 9)],
                              "id string, customer_id string, blockchain_id string, url string, max_blocks int, max_retries int, timeout_ms int, seq int")
    out, counts = rg.update_webhooks(w, p)
    got = {r.id: (r.url, r.max_blocks, r.max_retries, r.timeout_ms) for r in out.collect()}
    assert out.count() == 2 and got == {"w": ("https://new.example.com", 5, 3, 1), "x": ("u", 1, 1, 1)}
    assert [(r.customer_id, r.affected) for r in counts.collect()] == [("c", 1)]


def test_active_ids_are_not_activated_again(spark):
    w = spark.createDataFrame([("on", "c", "b", 0, 1, "u", 1, 1, 1), ("off", "c", "b", 0, 0, "u", 1, 1, 1)], WEBHOOK)
    req = spark.createDataFrame([(1, "c", "on"), (1, "c", "off")], "request_id int, customer_id string, id string")
    _, jobs, _, counts = rg.activate_webhooks(w, w.where("is_active = 1").select("id"), req)
    assert [r.webhook_id for r in jobs.collect()] == ["off"] and counts.first().activated == 1


def test_search_text_with_a_backslash(spark):
    w = spark.createDataFrame([("a", "c", "b", 0, 0, "x\\\\B", 1, 1, 1), ("b", "c", "b", 0, 0, "xB", 1, 1, 1)], WEBHOOK)
    assert [r.id for r in rg.search_webhooks(w, url_like="x\\\\b").collect()] == ["a"]


def test_activation_of_too_many_ids_is_marked(spark):
    jobs = spark.createDataFrame([(r, f"{i:03}", "c", i % 2) for r, n in (("ok", 50), ("big", 51)) for i in range(n)],
                                 "request_id string, webhook_id string, chain_id string, shard_id int")
    chains = spark.createDataFrame([("c", "rpc://x")], "id string, url string")
    got = {(r.request_id, r.shard_id): (r.ids, r.n_ids) for r in rg.group_activation(jobs, chains).collect()}
    even, odd = (",".join(f"{i:03}" for i in range(k, 50, 2)) for k in (0, 1))
    assert got == {("ok", 0): (even, 25), ("ok", 1): (odd, 25), ("big", 0): (None, 26), ("big", 1): (None, 25)}
