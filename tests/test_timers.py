"""Redelivery and entitlement timers against event-by-event replays; admission in messages."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.sources.store_io import fresh_path
from chainlake.streaming import admission, timers
from chainlake.streaming import runners as sp

START = dt.datetime(2024, 1, 1)
HOUR = 3_600_000_000


def _land(spark, path, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _files_with_delay(rows, n, delay, rnd):
    """``rows`` (time first) in ``n`` files, each row later than its time by at most ``delay``."""
    last = max(r[0] for r in rows) + delay + 1
    files = [[] for _ in range(n)]
    for r in rows:
        files[(r[0] + rnd.randrange(delay)) * n // last].append(r)
    return [f for f in files if f]


def _time(at):
    return START + dt.timedelta(microseconds=at)


def _replay(events, waits):
    """Plain event loop over one message: a list of all events and timers in the order of time."""
    out, failures, due = [], 0, None
    for at, _, failed in [*sorted(events), (10 ** 18, 0, None)]:
        if due is not None and due < at:
            out.append(("redeliver", failures, due))
        due = None
        if failed is None:
            break
        failures = failures + 1 if failed else 0
        if failed and failures == len(waits):
            out.append(("skip", failures, at))
            failures = 0
        elif failed:
            due = at + waits[failures - 1]
    return out


def test_redelivery_equals_an_event_loop(spark):
    rnd = random.Random(5)
    hooks = {"a": [HOUR, 3 * HOUR, 9 * HOUR], "b": [2 * HOUR], "c": [HOUR, HOUR]}
    rows = [(rnd.randrange(200 * HOUR), rnd.choice("abcx"), rnd.randrange(6), k, rnd.random() < .7) for k in range(260)]
    rows += [(rows[0][0], *rows[0][1:3], 999, True)]  # two attempts of a message at one time
    base = fresh_path(spark, "timers")
    files = [[(w, m, k, _time(at), failed, "attempt") for at, w, m, k, failed in f]
             for f in _files_with_delay(rows, 6, 30 * HOUR, rnd)]
    files[0] += [(None, 1, 1, START, True, "attempt"), ("a", 1, 2, None, True, "attempt"), ("a", 1, 3, START, None, "attempt")]
    _land(spark, f"{base}/src", timers.EVENT, [*files, *[[("", 0, 0, _time(10 ** 10 * 3600), None, "tick")]] * 2])
    waits = spark.createDataFrame(list(hooks.items()), "webhook_id string, waits array<bigint>")
    stream = sp.ingest_stream(spark, f"{base}/src", T.StructType.fromDDL(timers.EVENT), 1)
    sp.run_available_now(timers.redelivery_stream(stream, waits, "72 hours"),
                         lambda df, bid: df.write.mode("append").parquet(f"{base}/out"), f"{base}/ckpt")
    got = sorted((r.webhook_id, r.msg_id, r.kind, r.attempt, r.due_at) for r in spark.read.parquet(f"{base}/out").collect())
    want = []
    for w, m in {(r[1], r[2]) for r in rows if r[1] in hooks}:
        events = [(at, k, failed) for at, x, y, k, failed in rows if (x, y) == (w, m)]
        want += [(w, m, kind, n, _time(at)) for kind, n, at in _replay(events, hooks[w])]
    assert got == sorted(want) and {g[2] for g in got} == {"redeliver", "skip"}


def test_open_timers_wait_for_the_clock():
    assert timers.replay_attempts([(5, 1, True)], [10, 10], 0, None, 15) == ([], 1, 15)
    assert timers.replay_attempts([], [10, 10], 1, 15, 16) == ([("redeliver", 1, 15)], 1, None)
    assert timers.replay_attempts([(15, 2, False)], [10, 10], 1, 15, 99) == ([], 0, None)
    assert timers.replay_attempts([], [], 0, None, 99) == ([], 0, None)


def test_waits_follow_the_schedule(spark):
    hooks = spark.createDataFrame([("1", 0), ("2", 5)], "id string, max_retries int")
    got = {r.webhook_id: r.waits for r in timers.waits_of(hooks, 500, 1, 100_000).collect()}
    assert got == {"1": [500_000], "2": [500_000, 100_000_000, 100_000_000, 100_000_000]}


def _entitlements(rows, ttl, now):
    out = {}
    for user in {r[1] for r in rows if r[2] == "fill"}:
        fill = max(at for at, u, kind in rows if u == user and kind == "fill")
        drops = [at for at, u, kind in rows if u == user and kind == "invalidate" and fill <= at < fill + ttl]
        end = min(drops) if drops else fill + ttl if fill + ttl <= now else None
        state = "invalidated" if drops else "cached" if end is None else "expired"
        out[user] = (_time(fill), state, end if end is None else _time(end))
    return out


def test_entitlements_expire_and_the_state_shrinks(spark):
    rnd = random.Random(8)
    now, ttl = 300 * HOUR, 20 * HOUR
    rows = [(rnd.randrange(now), f"u{rnd.randrange(60)}", rnd.choice(["fill", "invalidate"])) for _ in range(200)]
    rows += [(50 * HOUR, "same", "fill"), (50 * HOUR, "same", "invalidate"), (50 * HOUR, "same", "fill")]
    base = fresh_path(spark, "ttl")
    schema = "user_id string, ts timestamp_ntz, kind string"
    files = [[(u, _time(at), kind) for at, u, kind in f] for f in _files_with_delay(rows, 5, 20 * HOUR, rnd)]
    files[0] += [(None, START, "fill"), ("u0", None, "fill")]
    tick = [("", _time(now + 100 * HOUR + 1000), "tick")]
    _land(spark, f"{base}/src", schema, [*files, tick, tick])
    stream = sp.ingest_stream(spark, f"{base}/src", sp.SIGNAL_SCHEMA, 1)
    changes = timers.entitlement_ttl_stream(stream, ttl // 1_000_000, "100 hours")
    q = (changes.writeStream.foreachBatch(lambda df, bid: sp._write_batch(df, bid, f"{base}/out"))
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.user_id: (r.last_fill, r.state, r.ended_at)
           for r in timers.current_entitlements(spark.read.parquet(f"{base}/out")).collect()}
    want = _entitlements(rows, ttl, now)
    assert got == want and {v[1] for v in want.values()} == {"cached", "expired", "invalidated"}
    live = sum(1 for fill, _, _ in want.values() if fill + dt.timedelta(microseconds=ttl) > _time(now))
    left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress][-1]
    # users without a fill keep a late invalidation for as long as a fill can still precede it
    assert live <= left <= live + sum(1 for at, u, _ in rows if u not in want and at >= now)


def test_cut_by_rows():
    files = [("a", 5), ("b", 0), ("c", 1), ("d", 7)]
    for size in range(1, 15):
        parts = list(admission.cut(files, size))
        rows = [(f, r) for part in parts for f, lo, hi in part for r in range(lo, hi + 1)]
        assert rows == [(f, r) for f, n in files for r in range(n)]
        counts = [sum(hi - lo + 1 for _, lo, hi in p) for p in parts]
        assert all(c == size for c in counts[:-1]) and 0 < counts[-1] <= size
    assert list(admission.cut([], 3)) == []


SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


@pytest.mark.parametrize("trigger", [1, 50])
def test_batches_are_bounded_and_resume_inside_a_file(spark, trigger):
    """One large and many small files; a crash in the middle of a file; nothing twice, nothing lost."""
    base = fresh_path(spark, "bounded")
    rows = spark.range(130).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    rows.where("k < 100").coalesce(1).write.parquet(f"{base}/src")
    rows.where("k >= 100").repartition(6).write.mode("append").parquet(f"{base}/src")
    seen, numbers = [], []

    def handle(crash_at):
        def run(df, number):
            if len(numbers) == crash_at:
                raise RuntimeError("stopped")
            numbers.append(number)
            seen.append([r.k for r in df.collect()])
        return run

    def once(crash_at):
        stream = admission.landed_messages(spark, f"{base}/src", SCHEMA, trigger)
        sp.run_available_now(stream, admission.bounded_batches(handle(crash_at), 40, f"{base}/log"), f"{base}/ckpt")

    with pytest.raises(Exception):
        once(2)
    assert [len(s) for s in seen] == [40, 40]
    once(-1)
    assert sorted(k for s in seen for k in s) == list(range(130)) and all(len(s) <= 40 for s in seen)
    assert numbers == sorted(set(numbers)) and seen[2][:20] == list(range(80, 100))


def test_start_now_leaves_earlier_files_out(spark):
    base = fresh_path(spark, "now")
    spark.range(5).selectExpr("id AS k", "'old' AS v").write.parquet(f"{base}/src")
    stream = admission.landed_messages(spark, f"{base}/src", SCHEMA, start_at=dt.datetime(2999, 1, 1))
    sp.run_available_now(stream, admission.bounded_batches(lambda df, n: df.write.mode("append").parquet(f"{base}/out"),
                                                           2, f"{base}/log"), f"{base}/ckpt")
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException):
        spark.read.parquet(f"{base}/out")


def test_redelivery_state_is_kept_in_groups(spark):
    """Many messages share a few state rows, and so a few calls, and are still replayed one by one."""
    rnd = random.Random(11)
    rows = [(rnd.randrange(100 * HOUR), "ab"[m % 2], m, 3 * m + k, rnd.random() < .8) for m in range(300) for k in range(3)]
    base = fresh_path(spark, "groups")
    files = [[(w, m, k, _time(at), failed, "attempt") for at, w, m, k, failed in f]
             for f in _files_with_delay(rows, 4, 20 * HOUR, rnd)]
    _land(spark, f"{base}/src", timers.EVENT, [*files, *[[("", 0, 0, _time(200 * HOUR), None, "tick")]] * 2])
    hooks = {"a": [HOUR, 400 * HOUR], "b": [500 * HOUR, HOUR, HOUR]}
    waits = spark.createDataFrame(list(hooks.items()), "webhook_id string, waits array<bigint>")
    stream = sp.ingest_stream(spark, f"{base}/src", T.StructType.fromDDL(timers.EVENT), 1)
    q = (timers.redelivery_stream(stream, waits, "60 hours", groups=8).writeStream
         .foreachBatch(lambda df, bid: df.write.mode("append").parquet(f"{base}/out"))
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 8
    got = sorted((r.webhook_id, r.msg_id, r.kind, r.attempt, r.due_at) for r in spark.read.parquet(f"{base}/out").collect())
    want = []
    for m in range(300):
        events = [(at, k, failed) for at, _, x, k, failed in rows if x == m]
        w = "ab"[m % 2]
        want += [(w, m, kind, n, _time(at)) for kind, n, at in _replay(events, hooks[w]) if at < 140 * HOUR]
    assert got == sorted(want)


def test_slices_land_from_one_evaluation(spark, monkeypatch):
    from chainlake.plans import q_streaming as q
    base = fresh_path(spark, "slices")
    spark.createDataFrame([("u", START + dt.timedelta(days=3 * k), "fill") for k in range(9)],
                          "user_id string, ts timestamp_ntz, kind string").write.parquet(f"{base}/in")
    read, plain = [], sp.land_files
    monkeypatch.setattr(sp, "land_files", lambda df, path, n: (read.extend(df.inputFiles()), plain(df, path, n)))
    q._land_in_time(spark.read.parquet(f"{base}/in"), f"{base}/src", "ts", F.lit(START))
    rows = spark.read.parquet(f"{base}/src").collect()
    assert sorted(r.ts for r in rows if r.kind == "fill") == [START + dt.timedelta(days=3 * k) for k in range(9)]
    assert sum(r.kind == "tick" for r in rows) == 2
    assert read and not any(f"{base}/in" in name for name in read)
