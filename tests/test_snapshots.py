"""Snapshots of a long stream are folded without changing what readers see."""

from pyspark.sql import functions as F

from chainlake.sources.store_io import BlockTable, fresh_path
from chainlake.streaming import rounds as rd
from chainlake.streaming import runners as sp
from chainlake.streaming import snapshots


def _write(spark, path, batch_id, rows):
    sp._write_batch(spark.createDataFrame(rows, "chain_id string, head bigint, low bigint"), batch_id, path)


def _read(spark, path):
    return sorted(tuple(r) for r in sp.current_bounds(spark, path).collect())


def test_fold_keeps_bounds_over_failures_and_replays(spark):
    path = fresh_path(spark, "heads")
    for k in range(6):
        _write(spark, path, k, [("a", 10 - k, k), ("b", k, 50 - k)])
    want = _read(spark, path)
    snapshots.fold(spark, path, 5, sp._bounds_of)
    assert _read(spark, path) == want and set(snapshots._folders(spark, path)[1]) == {-5, 5}
    _write(spark, path, 3, [("a", 7, 3)])   # as if an old folder had outlived a failed call
    _write(spark, path, 5, [("a", 5, 5), ("b", 5, 45)])   # the running batch is replayed
    snapshots.fold(spark, path, 5, sp._bounds_of)
    assert _read(spark, path) == want and set(snapshots._folders(spark, path)[1]) == {-5, 5}
    _write(spark, path, 6, [("c", 1, 1)])
    snapshots.fold(spark, path, 7, sp._bounds_of)
    assert _read(spark, path) == sorted([*want, ("c", 1, 1)]) and set(snapshots._folders(spark, path)[1]) == {-7}
    snapshots.fold(spark, path, 7, sp._bounds_of)
    snapshots.fold(spark, fresh_path(spark, "none"), 7, sp._bounds_of)
    assert set(snapshots._folders(spark, path)[1]) == {-7}


def test_router_folds_its_snapshots(spark):
    base = fresh_path(spark, "router")
    store = BlockTable(spark, f"{base}/store").init()
    rd.init_cursors(spark.createDataFrame([("w", "a", 1, False)],
                                          "webhook_id string, chain_id string, next_height bigint, is_new boolean"),
                    f"{base}/cursors")
    handle = sp.route_blocks_batch(store, f"{base}/heads", f"{base}/cursors", f"{base}/ready", fold_every=2)
    for k in range(5):
        rows = spark.range(1).select(F.lit("a").alias("chain_id"), F.lit(3 * k).cast("bigint").alias("block_height"),
                                     F.lit("{}").alias("block"), F.lit(k).cast("bigint").alias("seq"))
        handle(rows, k)
    handle(rows, 4)  # replayed
    assert _read(spark, f"{base}/heads") == [("a", 12, 0)]
    assert set(snapshots._folders(spark, f"{base}/heads")[1]) == {-4, 4}
    assert set(snapshots._folders(spark, f"{base}/ready")[1]) == {3, 4}
    assert spark.read.parquet(f"{base}/ready").where("batch_id = 4").count() == 1


def test_entitlement_state_folds_its_snapshots(spark):
    path = fresh_path(spark, "signals")
    handle = sp.entitlement_state_batch(path, fold_every=2)
    state = lambda rows: spark.createDataFrame(rows, "user_id string, last_fill int, last_invalidation int")
    batches = [[("a", 1, None), ("b", None, 4)], [("a", 3, None)], [("b", 5, 4)], [("a", 3, 7)], [("c", None, None)]]
    for k, rows in enumerate(batches):
        handle(state(rows), k)
    handle(state(batches[-1]), 4)  # replayed
    assert set(snapshots._folders(spark, path)[1]) == {-4, 4}
    got = sorted(tuple(r) for r in sp.current_signals(spark, path).collect())
    assert got == [("a", 3, 7), ("b", 5, 4), ("c", None, None)]
    newest = spark.read.parquet(path).groupBy("user_id").agg(F.max_by(F.struct("last_fill", "last_invalidation"), "batch_id").alias("s"))
    assert sorted(tuple(r) for r in newest.select("user_id", "s.*").collect()) == got
