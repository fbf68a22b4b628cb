"""Delivery semantics: due rule, first delivery modes, retries, plan = step loop."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as S
from pyspark.sql import functions as F

from chainlake.functions.columns import attempts_allowed
from chainlake.operators import delivery as dv
from chainlake.operators.gapped import plan_deliveries

WH = "id string, blockchain_id string, max_blocks int, max_retries int, url string, timeout_ms int"
JOB = "webhook_id string, chain_id string, next_height bigint, is_new boolean"


def _chain(spark, chain, low, head):
    blocks = spark.range(low, head + 1).select(F.lit(chain).alias("chain_id"), F.col("id").alias("block_height"),
                                               F.concat(F.lit('{"h":'), F.col("id").cast("string"), F.lit("}")).alias("block"))
    heads = spark.createDataFrame([(chain, head, low)], "chain_id string, head bigint, low bigint")
    return blocks, heads


def test_new_job_modes(spark):
    blocks, heads = _chain(spark, "c", 0, 20)
    wh = spark.createDataFrame([("w", "c", 3, 3, "http://x", 100)], WH)
    jobs = spark.createDataFrame([("w", "c", 0, True)], JOB)
    ref = dv.relay_step(jobs, wh, blocks, heads, mode="reference").collect()[0]
    assert ref.outcome == "deliver" and ref.body == '["{\\"h\\":20}","{\\"h\\":19}","{\\"h\\":18}"]'
    assert (ref.new_next_height, ref.new_is_new) == (19, False)
    ordd = dv.relay_step(jobs, wh, blocks, heads, mode="ordered").collect()[0]
    assert ordd.body == '["{\\"h\\":18}","{\\"h\\":19}","{\\"h\\":20}"]' and ordd.new_next_height == 21


def test_due_rule_is_strict(spark):
    _, heads = _chain(spark, "c", 0, 20)
    jobs = spark.createDataFrame([("a", "c", 19, False), ("b", "c", 20, False), ("x", "nochain", 1, False)], JOB)
    got = {r.webhook_id: r.state for r in dv.due_jobs(jobs, heads).collect()}
    assert got == {"a": "ready", "b": "pending", "x": "pending"}
    got = {r.webhook_id: r.state for r in dv.due_jobs(jobs, heads, inclusive=True).collect()}
    assert got["b"] == "ready"


def test_retry_skip_and_drop(spark):
    blocks, heads = _chain(spark, "c", 5, 20)
    wh = spark.createDataFrame([("r3", "c", 2, 3, "u", 1), ("r0", "c", 2, 0, "u", 1)], WH)
    jobs = spark.createDataFrame([("r3", "c", 7, False), ("r0", "c", 7, False), ("gone", "c", 7, False)], JOB)
    for f, expect in ((1, "deliver"), (2, "skip")):
        fails = spark.createDataFrame([("r3", f), ("r0", 1)], "webhook_id string, failures int")
        out = {r.webhook_id: r for r in dv.relay_step(jobs, wh, blocks, heads, fails).collect()}
        assert out["r3"].outcome == expect
        assert out["r0"].outcome == "skip" and out["r0"].new_next_height == 8
        assert out["gone"].outcome == "dropped"
    assert [r.a for r in spark.range(12).select(attempts_allowed(F.col("id").cast("int")).alias("a")).collect()] == \
        [1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]


def test_waiting_and_evicted(spark):
    blocks, heads = _chain(spark, "c", 100, 120)
    wh = spark.createDataFrame([("w", "c", 5, 3, "u", 1)], WH)
    jobs = spark.createDataFrame([("w", "c", 200, False)], JOB).unionByName(
        spark.createDataFrame([("w2", "c", 10, False)], JOB))
    wh = wh.unionByName(spark.createDataFrame([("w2", "c", 5, 3, "u", 1)], WH))
    out = {r.webhook_id: r for r in dv.relay_step(jobs, wh, blocks, heads, skip_evicted=True).collect()}
    assert out["w"].outcome == "waiting" and out["w"].new_next_height == 200
    assert out["w2"].outcome == "evicted" and out["w2"].new_next_height == 100


def _simulate(low, head, s, is_new, m, mode):
    reqs = []
    if is_new:
        hs = list(range(max(low, head - m + 1), head + 1))
        reqs.append((min(hs), max(hs), len(hs)))
        s = min(hs) + 1 if mode == "reference" else max(hs) + 1
    while s < head:
        hs = [h for h in range(s, s + m) if low <= h <= head]
        if not hs:
            break
        reqs.append((min(hs), max(hs), len(hs)))
        s = max(hs) + 1
    return reqs


case = S.tuples(S.integers(0, 30), S.integers(0, 60), S.integers(0, 70), S.booleans(), S.integers(1, 10))


@settings(max_examples=5, deadline=None)
@given(S.lists(case, min_size=1, max_size=12), S.sampled_from(["reference", "ordered"]))
def test_plan_equals_step_loop(spark, cases, mode):
    rows_j, rows_w, rows_h, expect = [], [], [], {}
    for i, (low, span, s, is_new, m) in enumerate(cases):
        head = low + span
        s = max(s, low)
        chain, wid = f"c{i}", f"w{i}"
        rows_j.append((wid, chain, s, is_new))
        rows_w.append((wid, chain, m, 3, "u", 1))
        rows_h.append((chain, head, low))
        expect[wid] = _simulate(low, head, s, is_new, m, mode)
    jobs = spark.createDataFrame(rows_j, JOB)
    wh = spark.createDataFrame(rows_w, WH)
    heads = spark.createDataFrame(rows_h, "chain_id string, head bigint, low bigint")
    got = {}
    for r in dv.delivery_plan(jobs, wh, heads, mode=mode).orderBy("webhook_id", "request_no").collect():
        got.setdefault(r.webhook_id, []).append((r.first_height, r.last_height, r.n_blocks))
    assert {k: v for k, v in expect.items() if v} == got


def test_current_failures(spark):
    a = spark.createDataFrame([(1, "w", True), (2, "w", False), (3, "w", True), (4, "w", True), (5, "v", True)],
                              "attempt_id bigint, webhook_id string, failed boolean")
    got = {r.webhook_id: r.failures for r in dv.current_failures(a).collect()}
    assert got == {"w": 2, "v": 1}


def test_recent_top_blocks_exact_with_gaps(spark):
    rows = [("a", h, str(h)) for h in [1, 2, 3, 50_000, 50_001]] + [("b", h, str(h)) for h in range(0, 40)]
    blocks = spark.createDataFrame(rows, "chain_id string, block_height bigint, block string")
    heads = blocks.groupBy("chain_id").agg(F.max("block_height").alias("head"))
    got = {}
    for r in dv.recent_top_blocks(blocks, heads, n=4, lookback=10).collect():
        got.setdefault(r.chain_id, []).append(r.block_height)
    assert sorted(got["a"]) == [2, 3, 50_000, 50_001]   # window too short: exact fallback
    assert sorted(got["b"]) == [36, 37, 38, 39]


def _simulate_gapped(H, s, is_new, m, mode):
    H = sorted(H)
    head = H[-1]
    reqs = []
    if is_new:
        top = H[-m:]
        reqs.append((top[0], top[-1], len(top)))
        s = top[0] + 1 if mode == "reference" else top[-1] + 1
    while s < head:
        got = [h for h in H if s <= h <= s + m - 1]
        if not got:
            break
        reqs.append((got[0], got[-1], len(got)))
        s = got[-1] + 1
    return reqs


gcase = S.tuples(S.lists(S.integers(0, 80), min_size=1, max_size=40, unique=True), S.integers(0, 90),
                 S.booleans(), S.integers(1, 10))


@settings(max_examples=3, deadline=None)
@given(S.lists(gcase, min_size=1, max_size=6), S.sampled_from(["reference", "ordered"]))
def test_gapped_plan_equals_step_loop(spark, cases, mode):
    from chainlake.operators.gapped import delivery_plan_gapped
    rows_b, rows_j, rows_w, expect = [], [], [], {}
    for i, (H, s, is_new, m) in enumerate(cases):
        chain, wid = f"c{i}", f"w{i}"
        rows_b += [(chain, h, "") for h in H]
        rows_j.append((wid, chain, s, is_new))
        rows_w.append((wid, chain, m, 3, "u", 1))
        expect[wid] = _simulate_gapped(H, s, is_new, m, mode)
    blocks = spark.createDataFrame(rows_b, "chain_id string, block_height bigint, block string")
    out = delivery_plan_gapped(spark.createDataFrame(rows_j, JOB), spark.createDataFrame(rows_w, WH), blocks,
                               mode=mode, bucket=16)
    got = {}
    for r in out.orderBy("webhook_id", "request_no").collect():
        got.setdefault(r.webhook_id, []).append((r.first_height, r.last_height, r.n_blocks))
    assert {k: v for k, v in expect.items() if v} == got


def test_hot_heights_are_salted_without_changing_results(spark):
    blocks, heads = _chain(spark, "c", 0, 50)
    rows = [(f"w{i}", "c", 40 + (i % 3), False) for i in range(60)]
    jobs = spark.createDataFrame(rows, JOB).withColumn("max_blocks", F.lit(4))
    plain = sorted(tuple(r) for r in dv.jobs_with_blocks(jobs, blocks, salt=1).collect())
    salted = dv.jobs_with_blocks(jobs, blocks, hot_rows=10, salt=4)
    assert sorted(tuple(r) for r in salted.collect()) == plain
    plan = salted._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" in plan


@settings(max_examples=5, deadline=None)
@given(S.lists(S.tuples(S.sampled_from(["a", "b", "c"]), S.booleans()), min_size=1, max_size=60), S.integers(1, 7))
def test_current_failures_bucketed(spark, rows, bucket):
    data = [(i, w, f) for i, (w, f) in enumerate(rows)]
    expect = {}
    for w in {w for _, w, _ in data}:
        seq = [f for _, ww, f in data if ww == w]
        last_ok = max([i for i, f in enumerate(seq) if not f], default=-1)
        n = sum(1 for i, f in enumerate(seq) if f and i > last_ok)
        if n:
            expect[w] = n
    a = spark.createDataFrame(data, "attempt_id bigint, webhook_id string, failed boolean")
    got = {r.webhook_id: r.failures for r in dv.current_failures(a, bucket=bucket).collect()}
    assert got == expect


@settings(max_examples=5, deadline=None)
@given(S.lists(S.tuples(S.integers(0, 40), S.integers(1, 10), S.integers(0, 45)), min_size=1, max_size=10))
def test_ordered_plan_covers_each_block_once(spark, cases):
    rows_j, rows_w, rows_h = [], [], []
    for i, (span, m, s) in enumerate(cases):
        head = 5 + span
        rows_j.append((f"w{i}", f"c{i}", min(s, head), False))
        rows_w.append((f"w{i}", f"c{i}", m, 3, "u", 1))
        rows_h.append((f"c{i}", head, 0))
    plan = dv.delivery_plan(spark.createDataFrame(rows_j, JOB), spark.createDataFrame(rows_w, WH),
                            spark.createDataFrame(rows_h, "chain_id string, head bigint, low bigint"), mode="ordered")
    got = {}
    for r in plan.collect():
        got.setdefault(r.webhook_id, []).extend(range(r.first_height, r.last_height + 1))
    for i, (span, m, s) in enumerate(cases):
        head, start = 5 + span, min(s, 5 + span)
        covered = sorted(got.get(f"w{i}", []))
        assert covered == sorted(set(covered))           # no block twice
        if start < head:                                   # everything from the cursor is sent,
            assert covered[0] == start                     # the head only when a batch reaches it
            assert covered == list(range(start, covered[-1] + 1))
            assert covered[-1] in (head - 1, head)


@pytest.mark.parametrize("shape", ["contiguous", "gappy", "both", "no_blocks", "no_jobs"])
@pytest.mark.parametrize("mode", ["reference", "ordered"])
def test_plan_of_any_store(spark, shape, mode):
    """Stores that begin above 0, cursors below them and large batches; both planners agree with the simulation."""
    chains = {"a": list(range(100, 161)), "b": [5, 6, 9, 30, 31, 32, 33, 70, 71, 72]}
    chains = {"contiguous": {"a": chains["a"]}, "gappy": {"b": chains["b"]}, "no_blocks": {}}.get(shape, chains)
    cases = [(f"{c}{i}", c, s, new, m) for c in ("a", "b") for i, (s, new, m) in enumerate(
        [(0, False, 5), (98, False, 5), (120, False, 7), (0, True, 40), (100, False, 15), (29, False, 40), (71, True, 1)])]
    cases = [] if shape == "no_jobs" else cases
    jobs = spark.createDataFrame([(w, c, 0, s, new) for w, c, s, new, _ in cases],
                                 "webhook_id string, chain_id string, shard_id int, next_height bigint, is_new boolean")
    hooks = spark.createDataFrame([(w, m) for w, *_, m in cases], "id string, max_blocks int")
    blocks = spark.createDataFrame([(c, h, str(h)) for c, hs in chains.items() for h in hs],
                                   "chain_id string, block_height bigint, block string")
    want = sorted((w, k, *r) for w, c, s, new, m in cases if c in chains
                  for k, r in enumerate(_simulate_gapped(chains[c], s, new, m, mode)))
    got = plan_deliveries(jobs, hooks, blocks, mode=mode)
    assert sorted((r.webhook_id, r.request_no, r.first_height, r.last_height, r.n_blocks) for r in got.collect()) == want


def test_new_job_gets_more_than_ten_blocks(spark):
    jobs = spark.createDataFrame([("w", "a", 15)], "webhook_id string, chain_id string, max_blocks int")
    blocks = spark.createDataFrame([("a", h, str(h)) for h in range(30)], "chain_id string, block_height bigint, block string")
    heads = spark.createDataFrame([("a", 29)], "chain_id string, head bigint")
    for h in (None, heads):
        assert sorted(r.block_height for r in dv.new_jobs_with_latest(jobs, blocks, h).collect()) == list(range(15, 30))


def test_far_behind_job_is_planned_in_chunks(spark):
    jobs = spark.createDataFrame([("w", "a", 0, False)], "webhook_id string, chain_id string, next_height bigint, is_new boolean")
    hooks = spark.createDataFrame([("w", 1)], "id string, max_blocks int")
    heads = spark.createDataFrame([("a", 100_000, 0)], "chain_id string, head bigint, low bigint")
    r = dv.delivery_plan(jobs, hooks, heads).agg(F.count("*"), F.min("request_no"), F.max("request_no"), F.sum("n_blocks")).first()
    assert tuple(r) == (100_000, 0, 99_999, 100_000)


def test_gapped_plan_builds_only_states_that_paths_reach(spark, monkeypatch):
    """A long chain under jobs near its head: states from the lowest cursor on, and no round multiplies the partitions."""
    from chainlake.operators import gapped
    kept = []
    plain = gapped._checkpoint
    monkeypatch.setattr(gapped, "_checkpoint", lambda df: kept.append(plain(df)) or kept[-1])
    heights = [h for h in range(40_000) if h % 3]
    blocks = spark.createDataFrame([("c", h, "") for h in heights], "chain_id string, block_height bigint, block string")
    cases = [(f"w{i}", 39_990 - 60 * (i % 4), 1 + i % 2) for i in range(40)]
    jobs = spark.createDataFrame([(w, "c", s, False) for w, s, _ in cases], JOB)
    hooks = spark.createDataFrame([(w, m) for w, _, m in cases], "id string, max_blocks int")
    out = gapped.delivery_plan_gapped(jobs, hooks, blocks)
    want = sorted((w, k, *r) for w, s, m in cases for k, r in enumerate(_simulate_gapped(heights, s, False, m, "reference")))
    assert sorted(tuple(r) for r in out.collect()) == want
    assert max(df.count() for df in kept) < 1_000
    assert max(df.rdd.getNumPartitions() for df in kept) <= 64
