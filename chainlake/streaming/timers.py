"""Keyed state with event-time timers: redelivery by schedule and entitlements that expire.

Both functions are exact replays in event time.  Events may arrive in any
order within the watermark ``delay``; Spark drops later ones.  Timers fire as the
watermark passes them, so results do not depend on how events fall into
micro-batches.  The clock moves with the events; where it must move without
them, ``tick`` rows (``clock_tick``) carry a time and nothing else.
"""

from __future__ import annotations

from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.functions import columns as C

EVENT = "webhook_id string, msg_id bigint, attempt_id bigint, ts timestamp_ntz, failed boolean, kind string"


def _stamp(micros: str) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def _clocked(rows: DataFrame, delay: str) -> DataFrame:
    stamp = F.col("ts").cast("timestamp")
    return rows.withColumn("event_ts", stamp).withColumn("_at", F.unix_micros(stamp)).withWatermark("event_ts", delay)


def _wake(state, micros: int) -> None:
    """A timer at the first millisecond at or after ``micros``; never in the past, which Spark refuses."""
    state.setTimeoutTimestamp(max(-(-micros // 1000), state.getCurrentWatermarkMs() + 1))


def waits_of(webhooks: DataFrame, init_ms: int, max_rand_ms: int, max_wait_ms: int) -> DataFrame:
    """``(webhook_id, waits)``: microseconds to wait after each failure; as many entries as attempts are allowed."""
    attempts = F.sequence(F.lit(1), C.attempts_allowed("max_retries"))
    seed = F.abs(F.hash("id"))
    wait = F.transform(attempts, lambda a: (F.least(C.backoff_wait_ms(a, init_ms, max_rand_ms, seed), F.lit(float(max_wait_ms)))
                                            * 1000).cast("bigint"))
    return webhooks.select(F.col("id").alias("webhook_id"), wait.alias("waits"))


def replay_attempts(events: list, waits: list, failures: int, due: int | None, until: int) -> tuple[list, int, int | None]:
    """One message through its ``events`` ``(at, attempt_id, failed)``, all before
    ``until`` and in order: the rows to hand out, the failures that count and the
    timer that is still open.

    A failure sets the timer of its number, the last one allowed skips the
    message; any further attempt stops the timer, a success forgets the failures.
    """
    out = []
    for at, _, failed in events:
        if due is not None and due < at:
            out.append(("redeliver", failures, due))
        due = None
        if not failed:
            failures = 0
            continue
        failures += 1
        if failures >= len(waits):
            out.append(("skip", failures, at))
            failures = 0
        else:
            due = at + waits[failures - 1]
    if due is not None and due < until:
        out.append(("redeliver", failures, due))
        due = None
    return out, failures, due


GROUPS = 1024  # groups of messages in the state; fixed for the life of a stream's checkpoint


def redelivery_stream(attempts: DataFrame, waits: DataFrame, delay: str, groups: int = GROUPS) -> DataFrame:
    """Failed messages when their schedule hands them out again:
    ``(webhook_id, msg_id, kind, attempt, due_at)``.

    ``attempts`` is a stream of ``EVENT`` rows, ``waits`` the table of
    ``waits_of``; attempts of unknown webhooks are dropped.  ``kind`` is
    ``redeliver`` (``attempt`` failures so far, due at ``due_at``) or ``skip``.  The
    state of a message is its attempts that the watermark has not passed, its
    failures and its timer; it goes with a success or a skip.  Rows without a
    webhook, message, time or outcome are left out.

    Messages are kept in ``groups`` groups by hash, since a call of Python for
    a message costs far more than its replay; a group's timer is the first of
    its messages', and each message is replayed alone.
    """
    rows = (_clocked(attempts, delay).join(waits, "webhook_id", "left")
            .select("webhook_id", "msg_id", "attempt_id", "event_ts", "_at", "failed", "kind", "waits"))

    def run(key, frames, state):
        messages = {}
        if state.exists:
            *heads, at, ids, failed = state.get
            rest = zip(at, ids, failed)
            for hook, msg, waits, failures, due, n in zip(*heads):
                messages[hook, msg] = [waits, failures, due, list(islice(rest, n))]
        if not state.hasTimedOut:
            for f in frames:
                f = f[(f["kind"] != "tick") & f["_at"].notna() & f["failed"].notna() & f["waits"].notna()]
                for hook, msg, a, i, x, w in zip(f["webhook_id"], f["msg_id"], f["_at"], f["attempt_id"].fillna(0),
                                                 f["failed"], f["waits"]):
                    message = messages.setdefault((hook, int(msg)), [None, 0, None, []])
                    message[0] = w
                    message[3].append((int(a), int(i), bool(x)))
        now = state.getCurrentWatermarkMs() * 1000
        out, kept, left, wake = [], [], [], []
        for (hook, msg), (waits, failures, due, events) in messages.items():
            waits = [int(w) for w in waits]
            events.sort()
            ready = [e for e in events if e[0] < now]
            events = events[len(ready):]
            fired, failures, due = replay_attempts(ready, waits, failures, due, now)
            out += [(hook, msg, *o) for o in fired]
            if events or failures:
                kept.append((hook, msg, waits, failures, due, len(events)))
                left += events
                wake += [t for t in (events[0][0] if events else None, due) if t is not None]
        if kept:
            at, ids, failed = (list(c) for c in zip(*left)) if left else ([], [], [])
            state.update((*(list(c) for c in zip(*kept)), at, ids, failed))
            if wake:
                _wake(state, min(wake) + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["webhook_id", "msg_id", "kind", "attempt", "_at"])

    known = (rows.where(F.col("webhook_id").isNotNull() & F.col("msg_id").isNotNull())
             .withColumn("_group", F.pmod(F.xxhash64("webhook_id", "msg_id"), F.lit(groups))))
    fired = known.groupBy("_group").applyInPandasWithState(
        run, "webhook_id string, msg_id bigint, kind string, attempt int, _at bigint",
        "hooks array<string>, msgs array<bigint>, waits array<array<bigint>>, failures array<int>, due array<bigint>, "
        "n array<int>, at array<bigint>, ids array<bigint>, failed array<boolean>",
        "append", "EventTimeTimeout")
    return fired.select("webhook_id", "msg_id", "kind", "attempt", _stamp("_at").alias("due_at"))


def entitlement_ttl_stream(signals: DataFrame, ttl_seconds: int, delay: str) -> DataFrame:
    """Changes of the cached entitlement of each user as they become known:
    ``(user_id, last_fill, state, ended_at)``.

    ``signals`` is a stream ``(user_id, ts, kind)`` of fills, invalidations and
    ticks.  A fill is ``cached``, until the first invalidation at or after it
    (``invalidated``) or until its time to live has passed (``expired``); an
    invalidation after that changes nothing.  A user's state goes when the
    watermark passes that time, whatever ended the entry, so the store holds the users
    that were filled within the time to live and the delay.  A user has at most
    one row per micro-batch; the last one is the current state.
    """
    ttl = int(ttl_seconds) * 1_000_000

    def run(key, frames, state):
        fill, drops, told, told_end = None, [], None, None
        if state.exists:
            fill, drops, told, told_end = state.get
            drops = list(drops)
        if state.hasTimedOut:
            state.remove()
            if fill is not None and told == "cached":
                yield pd.DataFrame([(*key, fill, "expired", fill + ttl)], columns=["user_id", "_fill", "state", "_end"])
            return
        before = fill
        for f in frames:
            for kind, at in zip(f["kind"].tolist(), f["_at"].tolist()):  # a few rows: no frame operations
                if kind == "fill" and not pd.isna(at):
                    fill = int(at) if fill is None else max(fill, int(at))
                elif kind == "invalidate" and not pd.isna(at):
                    drops.append(int(at))
        # before the first fill only invalidations that a late fill can still precede count
        floor = fill if fill is not None else state.getCurrentWatermarkMs() * 1000
        drops = sorted({d for d in drops if d >= floor})
        if fill is None and not drops:
            if state.exists:
                state.remove()
            return
        ended = drops[0] if fill is not None and drops and drops[0] < fill + ttl else None
        now = None if fill is None else "cached" if ended is None else "invalidated"
        state.update((fill, drops, now, ended))
        _wake(state, fill + ttl if fill is not None else drops[-1] + 1)
        if now is not None and (now, fill, ended) != (told, before, told_end):
            yield pd.DataFrame({"user_id": [key[0]], "_fill": [fill], "state": [now],
                                "_end": pd.array([ended], dtype="Int64")})

    known = _clocked(signals, delay).where(F.col("user_id").isNotNull()).select("user_id", "event_ts", "_at", "kind")
    out = known.groupBy("user_id").applyInPandasWithState(
        run, "user_id string, _fill bigint, state string, _end bigint",
        "fill bigint, drops array<bigint>, told string, told_end bigint", "append", "EventTimeTimeout")
    return out.select("user_id", _stamp("_fill").alias("last_fill"), "state", _stamp("_end").alias("ended_at"))


def current_entitlements(changes: DataFrame) -> DataFrame:
    """Per user the last of the rows that ``entitlement_ttl_stream`` wrote under their ``batch_id``."""
    newest = F.max_by(F.struct("last_fill", "state", "ended_at"), "batch_id").alias("s")
    return changes.groupBy("user_id").agg(newest).select("user_id", "s.last_fill", "s.state", "s.ended_at")


def clock_tick(like: DataFrame, at: Column) -> DataFrame:
    """One row with the columns of ``like`` that carries nothing but the time ``at`` (kind ``tick``)."""
    values = {"ts": at.cast("timestamp_ntz"), "kind": F.lit("tick")}
    blank = {"string": F.lit(""), "bigint": F.lit(0)}
    cols = [values.get(n, blank.get(t, F.lit(None))).cast(t).alias(n) for n, t in like.dtypes]
    return like.sparkSession.range(1).select(*cols)
