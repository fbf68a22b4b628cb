"""Billing consumer contract: 8 events in, 8 outcomes out, exactly one error."""

from chainlake.operators import billing as bl


def _event(i, etype, user="dummy-id"):
    meta = "{}" if user is None else '{"userId":"%s"}' % user
    return (i, None, '{"type":"%s","data":{"object":{"metadata":%s}}}' % (etype, meta))


def test_eight_events_one_error(spark):
    types = ["checkout.session.completed", "customer.subscription.paused", "customer.subscription.created",
             "customer.subscription.deleted", "customer.subscription.updated", "customer.subscription.resumed"]
    rows = [_event(i, t) for i, t in enumerate(types)]
    rows.append(_event(6, "some.unknown.type"))
    rows.append(_event(7, "customer.subscription.deleted", user=None))
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, payload string")
    subs = spark.createDataFrame([], "subscription_id string, billing_customer_id string, user_id string, "
                                     "status string, created_at timestamp_ntz")
    out = bl.event_outcomes(events, subs).collect()
    assert len(out) == 8
    errors = [r.error for r in out if r.error is not None]
    assert len(errors) == 1
    assert "userId" in errors[0] and "customer.subscription.deleted" in errors[0]
    assert {r.status for r in out if r.event_id == 6} == {"ignored"}


def test_entitlement_chain(spark):
    users = spark.createDataFrame([(u,) for u in "abcdefgh"], "user_id string")
    sessions = spark.createDataFrame([
        ("b", "open", "cus_b", False, "active"),
        ("c", "complete", None, False, "active"),
        ("d", "complete", "cus_d", True, "active"),
        ("e", "complete", "cus_e", False, None),
        ("f", "complete", "cus_f", False, "canceled"),
        ("g", "complete", "cus_g", False, "past_due"),
        ("h", "complete", "cus_h", False, "trialing"),
    ], "customer_id string, status string, billing_customer_id string, customer_deleted boolean, subscription_status string")
    got = {r.user_id: r.decision for r in bl.entitlement(users, sessions).collect()}
    assert got == {"a": "not_subscribed", "b": "not_subscribed", "c": "internal_error", "d": "not_subscribed",
                   "e": "internal_error", "f": "not_subscribed", "g": "invalid_subscription", "h": "ok"}


SUBS = "subscription_id string, billing_customer_id string, user_id string, status string, created_at timestamp_ntz"
EVENTS = "event_id bigint, ts timestamp_ntz, payload string"


def _payload(etype, obj):
    return '{"type":"%s","data":{"object":%s}}' % (etype, obj)


CASES = [
    ("customer.subscription.created", '{"metadata":{"userId":5}}', None, "received number"),
    ("customer.subscription.created", '{"metadata":{"userId":null}}', None, "received null"),
    ("customer.subscription.created", '{"metadata":{"userId":["a"]}}', None, "received array"),
    ("customer.subscription.created", "{}", None, "received undefined"),
    ("checkout.session.completed", '{"metadata":{"userId":"u"}}', "u", None),
    ("invoice.paid", '{"subscription":"sub_1"}', "one", None),
    ("invoice.paid", '{"subscription":{"id":"sub_9","metadata":{"userId":"own"}}}', "own", None),
    ("invoice.paid", '{"subscription":{"id":"sub_9","metadata":{}}}', None, "received undefined"),
    ("invoice.paid", '{"subscription":null}', None, "subscription is missing"),
    ("invoice.paid", '{"subscription":"sub_8"}', None, "no such subscription: sub_8"),
    ("customer.deleted", '{"id":"cus_1"}', "two", None),
    ("customer.deleted", '{"id":"cus_7"}', None, None),
    ("customer.deleted", "{}", None, None),
]


def _cases(spark):
    import datetime as dt
    events = spark.createDataFrame([(i, None, _payload(t, o)) for i, (t, o, _, _) in enumerate(CASES)]
                                   + [(99, None, "no json"), (98, None, None)], EVENTS)
    subs = spark.createDataFrame([("sub_1", "cus_1", "one", "active", dt.datetime(2024, 1, 1)),
                                  ("sub_2", "cus_1", "two", "active", dt.datetime(2024, 1, 2)),
                                  ("sub_3", None, "three", "active", dt.datetime(2024, 1, 3))], SUBS)
    return events, subs


def test_user_of_every_kind_of_event(spark):
    out = {r.event_id: r for r in bl.event_outcomes(*_cases(spark)).collect()}
    assert len(out) == len(CASES) + 2
    for i, (_, _, user, error) in enumerate(CASES):
        assert out[i].user_id == user, CASES[i]
        assert (out[i].error is None) if error is None else (error in out[i].error), CASES[i]
    assert out[11].status == out[12].status == "no_subscription"
    assert out[98].status == out[99].status == "ignored"


def test_consumer_writes_side_effects_and_rereads_subscriptions(spark):
    from chainlake.sources.store_io import fresh_path
    from chainlake.streaming.runners import consume_billing_batch
    events, subs = _cases(spark)
    base = fresh_path(spark, "billing-effects")
    calls = []

    def current():
        calls.append(1)
        return subs

    handle = consume_billing_batch(current, f"{base}/out", f"{base}/signals", f"{base}/gone")
    for batch_id in (0, 0, 1):  # a replay rewrites its own rows
        handle(events if batch_id == 0 else events.limit(0), batch_id)
    assert len(calls) == 3
    assert spark.read.parquet(f"{base}/out").count() == len(CASES) + 2
    assert sorted(r.user_id for r in spark.read.parquet(f"{base}/signals").collect()) == ["one", "own", "two", "u"]
    assert [r.customer_id for r in spark.read.parquet(f"{base}/gone").collect()] == ["two"]


def test_swap_updates_in_place_and_deletes(spark):
    sch = "id string, created_at string, customer_id string, client_reference_id string, session_id string, url string"
    sessions = spark.createDataFrame([("1", "old", "a", "ra", "sa", "ua"), ("2", "old", "b", "rb", "sb", "ub"),
                                      ("3", "old", "c", "rc", "sc", "uc")], sch)
    proposals = spark.createDataFrame(
        [("n1", "new", "a", "ra2", "sa2", "ua2", "ra", False), ("n2", "new", "b", "rb2", "sb2", "ub2", "rb", True),
         ("n3", "new", "c", "rc2", "sc2", "uc2", "stale", False), ("n4", "new", "d", "rd", "sd", "ud", None, False),
         ("n5", "new", "d", "rd", "se", "ue", None, False)],
        sch + ", expected_reference string, delete_old boolean")
    got = sorted(tuple(r) for r in bl.swap_session(sessions, proposals).collect())
    assert got == [("1", "old", "a", "ra2", "sa2", "ua2"), ("3", "old", "c", "rc", "sc", "uc"),
                   ("n2", "new", "b", "rb2", "sb2", "ub2"), ("n4", "new", "d", "rd", "sd", "ud")]
