"""Rounds with windows of ordered requests, bodies by range and the ordered sender."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from chainlake import fixtures as fx
from chainlake.operators import delivery as dv
from chainlake.operators import windows as wd
from chainlake.sources.store_io import fresh_path
from chainlake.streaming import rounds as rd
from chainlake.streaming import runners

WH = "id string, blockchain_id string, max_blocks int, max_retries int, url string, timeout_ms int, shard_id int"
JOB = "webhook_id string, chain_id string, next_height bigint, is_new boolean"


def world(spark, chains, cases):
    blocks = spark.createDataFrame([(c, h, f'{{"height":{h}}}') for c, hs in chains.items() for h in hs],
                                   "chain_id string, block_height bigint, block string")
    jobs = spark.createDataFrame([(w, c, s, new) for w, c, s, new, *_ in cases], JOB)
    hooks = spark.createDataFrame([(w, c, m, r, "u", 1, 0) for w, c, _, _, m, r in cases], WH)
    return blocks, jobs, hooks


def messages(H, s, is_new, m, mode):
    """(cursor, is_new, first, last, n, next cursor) of each request until nothing is due, one by one."""
    H, out = sorted(H), []
    while is_new or s < H[-1]:
        got = H[-m:] if is_new else [h for h in H if s <= h <= s + m - 1]
        if not got:
            break
        move = got[0] + 1 if is_new and mode == "reference" else got[-1] + 1
        out.append((s, is_new, got[0], got[-1], len(got), move))
        s, is_new = move, False
    return out


def draw_cases(draw, chains, n):
    return [(f"w{i}", c, draw.randint(0, max(chains[c]) + 2), draw.random() < 0.3, draw.randint(1, 10), draw.randint(0, 5))
            for i, c in enumerate(draw.choice(sorted(chains)) for _ in range(n))]


@pytest.mark.parametrize("mode", ["reference", "ordered"])
@pytest.mark.parametrize("window", [1, 3, 50])
def test_window_equals_the_step_loop(spark, mode, window):
    """Contiguous, gappy, sparse and single-block chains, cursors below, in and above them."""
    draw = random.Random(window)
    chains = {"whole": list(range(20, 90)), "gaps": sorted(draw.sample(range(120), 60)), "thin": sorted(draw.sample(range(400), 12)),
              "one": [5]}
    cases = draw_cases(draw, chains, 60)
    blocks, jobs, hooks = world(spark, chains, cases)
    heads = wd.chain_bounds(blocks)
    due = dv.due_jobs(jobs, heads).where("is_new or state = 'ready'").select(*jobs.columns)
    got = {}
    for bounds in (heads, heads.drop("n_blocks")):
        got = {}
        for r in wd.request_window(due, hooks, blocks, bounds, None, window, mode).orderBy("webhook_id", "seq").collect():
            if r.outcome == "deliver":
                assert r.seq == len(got.setdefault(r.webhook_id, []))
                got[r.webhook_id].append((r.next_height, r.is_new, r.first_height, r.last_height, r.n_blocks, r.new_next_height))
            else:
                assert r.new_next_height == r.next_height and r.first_height is None
                assert (r.outcome == "evicted") == (not r.is_new and r.next_height + r.batch - 1 < min(chains[r.chain_id]))
        want = {w: messages(chains[c], s, new, m, mode)[:window] for w, c, s, new, m, _ in cases}
        assert got == {w: r for w, r in want.items() if r}


def test_window_of_one_equals_relay_step(spark, small_dir):
    hooks = fx.webhooks(spark, small_dir).where("cast(id as int) % 7 != 0")  # some jobs have no webhook
    jobs, heads, blocks = fx.jobs(spark, small_dir), fx.chain_heads(spark, small_dir), fx.blocks(spark, small_dir)
    failures = jobs.where("cast(webhook_id as int) % 5 = 0").select("webhook_id", F.lit(20).alias("failures"))
    due = dv.due_jobs(jobs, heads).where("is_new or state = 'ready'").select("webhook_id", "chain_id", "next_height", "is_new")
    columns = ["webhook_id", "chain_id", "next_height", "is_new", "outcome", "first_height", "last_height", "n_blocks",
               "new_next_height", "new_is_new"]
    one = wd.request_window(due, hooks, blocks, heads, failures)
    step = dv.relay_step(due, hooks, blocks, heads, failures)
    want = sorted(map(str, step.select(*columns).collect()))
    assert sorted(map(str, one.select(*columns).collect())) == want
    assert {r.outcome for r in step.select("outcome").distinct().collect()} >= {"deliver", "skip", "dropped"}
    with pytest.raises(ValueError):
        wd.request_window(due, hooks, blocks, heads, window=0)


def test_advance_stops_at_the_first_failure(spark):
    draw = random.Random(4)
    steps, answers, want, failed = [], [], {}, set()
    for i in range(60):
        w, n = f"w{i}", draw.randint(1, 6)
        told = [draw.choice([True, True, True, False, None]) for _ in range(n)]  # None: no answer
        steps += [(w, "c", k, 10 * k, False, "deliver", 10 * k + 10, False) for k in range(n)]
        answers += [(w, k, d) for k, d in enumerate(told) if d is not None]
        good = next((k for k, d in enumerate(told) if not d), n)
        if good:
            want[w] = 10 * good
        if good < n:
            failed.add((w, 10 * good))
    steps += [("skip", "c", 0, 7, False, "skip", 8, False), ("wait", "c", 0, 7, False, "waiting", 7, False),
              ("gone", "c", 0, 7, True, "dropped", None, None)]
    want.update(skip=8, gone=None)
    steps = spark.createDataFrame(steps, "webhook_id string, chain_id string, seq int, next_height bigint, is_new boolean, "
                                         "outcome string, new_next_height bigint, new_is_new boolean")
    moves, misses = wd.advance(steps, spark.createDataFrame(answers, "webhook_id string, seq int, delivered boolean"))
    assert {r.webhook_id: r.next_height for r in moves.collect()} == want
    assert {(r.webhook_id, r.next_height) for r in misses.collect()} == failed
    moves, misses = wd.advance(steps)
    assert misses.isEmpty() and moves.count() == 62


def replay(chains, cases, fails, window):
    """The relay event by event, a job at a time: requests sent, cursors and failure counts of current messages."""
    sent, cursors, counts, longest = [], {}, {}, 0
    for w, c, s, new, m, retries in cases:
        tries, rounds = 0, 0
        while new or s < max(chains[c]):
            rounds += 1
            if tries >= 1 and tries >= max(1, retries - 1):
                s, tries = s + 1, 0
                continue
            todo = messages(chains[c], s, new, m, "reference")[:window]
            if not todo:
                break
            for cursor, fresh, first, last, _, move in todo:
                sent.append((w, first, last))
                if fails(w, first):
                    tries += 1
                    break
                s, new, tries = move, False, 0
        cursors[w] = (s, new)
        longest = max(longest, rounds)
    return sorted(sent), cursors, longest


@pytest.mark.parametrize("window", [4, 30])
def test_loop_until_idle_equals_an_event_by_event_replay(spark, window):
    draw = random.Random(window)
    chains = {"whole": list(range(10, 40)), "gaps": sorted(draw.sample(range(40), 25))}
    cases = draw_cases(draw, chains, 12)
    fails = lambda w, first: (int(w[1:]) * 7 + first) % 9 == 0  # the same message fails each time, until it is skipped
    blocks, jobs, hooks = world(spark, chains, cases)
    base = fresh_path(spark, "windows")
    rd.init_cursors(jobs, f"{base}/cursors")

    def send(outbox):  # answers every request, also those behind a failure
        failed = F.pmod(F.substring("webhook_id", 2, 9).cast("int") * 7 + F.col("first_height"), F.lit(9)) == 0
        return outbox.select("webhook_id", "seq", (~failed).alias("delivered"))

    n = rd.run_until_idle(spark, f"{base}/cursors", f"{base}/outbox", hooks, blocks, wd.chain_bounds(blocks),
                          compact_every=5, send=send, window=window)
    want, cursors, longest = replay(chains, cases, fails, window)
    got = {r.webhook_id: (r.next_height, r.is_new) for r in rd.current_cursors(spark, f"{base}/cursors").collect()}
    assert got == cursors
    assert longest <= n <= longest + 1
    # the outbox also lists what lay behind a failure in its round: those were not to be sent
    rows = spark.read.parquet(f"{base}/outbox").orderBy("webhook_id", "round_id", "seq").collect()
    sent, stop = [], None
    for r in rows:
        if (r.webhook_id, r.round_id) != stop:
            sent.append((r.webhook_id, r.first_height, r.last_height))
            if fails(r.webhook_id, r.first_height):
                stop = (r.webhook_id, r.round_id)
    assert sorted(sent) == want
    bodies = {(r.first_height, r.last_height, r.body) for r in rows}
    assert all([json.loads(b)["height"] for b in json.loads(body)][0] in (first, last) for first, last, body in bodies)


def test_bodies_are_built_once_per_range(spark):
    """10,000 webhooks on one range: one body, and payload rows in the shuffles do not grow with the webhooks."""
    blocks = spark.createDataFrame([("c", h, "x" * 100) for h in range(50)], "chain_id string, block_height bigint, block string")
    jobs = spark.range(10_000).select(F.concat(F.lit("w"), "id").alias("webhook_id"), F.lit("c").alias("chain_id"),
                                      F.lit(30).cast("bigint").alias("next_height"), F.lit(False).alias("is_new"),
                                      F.lit(5).alias("max_blocks"))
    bodies = dv.range_bodies(dv.with_range(jobs), blocks)
    assert [tuple(r)[:6] for r in bodies.collect()] == [("c", False, 30, 34, 30, 34)]
    joined = dv.join_bodies(dv.with_range(jobs).select("webhook_id", *dv.RANGE), bodies, hot_rows=1000, salt=4)
    rows = joined.select("webhook_id", "_salt" if "_salt" in joined.columns else "body").distinct().count()
    assert rows == joined.count() == 10_000
    plain = dv.payloads(jobs, blocks)
    assert plain.select("body").distinct().count() == 1 and plain.count() == 10_000


def test_range_bodies_of_new_and_old_jobs(spark):
    blocks = spark.createDataFrame([("c", h, str(h)) for h in (1, 2, 5, 9)], "chain_id string, block_height bigint, block string")
    ranges = spark.createDataFrame([("c", True, 0, 3), ("c", False, 1, 3), ("c", False, 6, 8), ("d", True, 0, 2)],
                                   "chain_id string, is_new boolean, lo bigint, hi bigint")
    got = {(r.chain_id, r.is_new, r.lo): (r.first_height, r.last_height, r.n_blocks, r.body) for r in dv.range_bodies(ranges, blocks).collect()}
    assert got == {("c", True, 0): (2, 9, 3, '["9","5","2"]'), ("c", False, 1): (1, 2, 2, '["1","2"]')}
    ordered = dv.range_bodies(ranges.where("is_new"), blocks, mode="ordered").first()
    assert ordered.body == '["2","5","9"]'


def test_sender_keeps_the_order_of_a_webhook(spark):
    """One hot shard over several tasks: each webhook gets its requests in order and none behind a failure."""
    folder = tempfile.mkdtemp(prefix="sent-")
    rows = [(f"w{w}", seq, 10 * seq, 0) for w in range(20) for seq in range(8)]
    random.Random(1).shuffle(rows)
    outbox = spark.createDataFrame(rows, "webhook_id string, seq int, first_height bigint, shard_id int").repartition(5)

    def send_one(row):
        with open(os.path.join(folder, f"{row['webhook_id']}"), "a") as f:
            f.write(f"{row['seq']} {os.getpid()}\n")
        if row["webhook_id"] == "w3" and row["seq"] == 5:
            raise OSError("connection reset")
        return not (row["webhook_id"] == "w7" and row["seq"] == 2)

    answers = runners.ordered_sender(send_one)(outbox)
    plan = answers._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(shard_id" in plan and "webhook_id" in plan
    told = {(r.webhook_id, r.seq): r.delivered for r in answers.collect()}
    for w in range(20):
        upto = {3: 6, 7: 3}.get(w, 8)
        with open(os.path.join(folder, f"w{w}")) as f:
            assert [int(line.split()[0]) for line in f] == list(range(upto))
        assert [told.get((f"w{w}", k)) for k in range(8)] == [k + 1 < upto or upto == 8 for k in range(upto)] + [None] * (8 - upto)


def test_sender_must_name_requests_of_a_window(spark):
    blocks, jobs, hooks = world(spark, {"c": list(range(20))}, [("w0", "c", 3, False, 2, 3)])
    base = fresh_path(spark, "windows")
    rd.init_cursors(jobs, f"{base}/cursors")
    with pytest.raises(ValueError):
        rd.run_round(spark, 0, f"{base}/cursors", f"{base}/outbox", hooks, blocks, wd.chain_bounds(blocks), window=2,
                     send=lambda o: o.select("webhook_id", F.lit(True).alias("delivered")))


def test_summary_of_missing_fields(spark):
    rows = [("a", '["{\\"height\\":1,\\"timestamp\\":\\"t1\\"}","{\\"height\\":2}"]'), ("a", '["not json"]'), ("a", "[]"), ("b", "[]")]
    got = dv.delivery_summary(spark.createDataFrame(rows, "webhook_id string, body string")).collect()
    assert [tuple(r) for r in got] == [("a", 3, 3, 1, 2, "t1", "t1", 2)]
