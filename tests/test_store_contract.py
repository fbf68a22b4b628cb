"""Store contract of the reference's store suites, on every store form."""

import pytest
from pyspark.sql import functions as F

from chainlake.operators import store as st
from chainlake.sources import store_io
from chainlake.sources.store_io import BlockTable, fresh_path
from chainlake.streaming.runners import flush_tick

CHAIN = "dummy-chain"


def _blocks(spark, heights):
    return spark.createDataFrame([(CHAIN, h, "", h) for h in heights], "chain_id string, block_height bigint, block string, seq bigint")


def _heights(df):
    return [r.block_height for r in df.collect()]


def test_put_twice_range_latest(spark):
    store = spark.createDataFrame([], "chain_id string, block_height bigint, block string, seq bigint")
    b = _blocks(spark, [1, 2, 3])
    store = st.put_blocks(st.put_blocks(store, b), b)
    assert store.count() == 3
    assert _heights(st.get_blocks(store, CHAIN, 2, 3)) == [2, 3]
    assert _heights(st.latest_blocks(store, CHAIN, 2)) == [3, 2]
    assert _heights(st.latest_blocks(store, CHAIN, 1)) == [3]
    assert st.get_blocks(store, CHAIN, 3, 2).count() == 0
    assert st.latest_blocks(store, CHAIN, 0).count() == 0


def test_tiered_flush_and_add(spark):
    base = fresh_path(spark, "contract")
    hot, cold = BlockTable(spark, f"{base}/hot"), BlockTable(spark, f"{base}/cold")
    hot.init(); hot.init(); cold.init(); cold.init()
    b = _blocks(spark, [1, 2, 3])
    hot.put(b); hot.put(b)
    ranges = spark.createDataFrame([(CHAIN, 1, 4)], "chain_id string, start_height bigint, end_height bigint")
    assert sorted(_heights(st.tiered_get_blocks(hot.read(), cold.read(), ranges))) == [1, 2, 3]
    assert flush_tick(hot, cold, 3) == 3
    assert hot.read().count() == 0
    assert sorted(_heights(st.tiered_get_blocks(hot.read(), cold.read(), ranges))) == [1, 2, 3]
    latest = st.tiered_latest_blocks(hot.read(), cold.read(), 2).orderBy("rank")
    assert _heights(latest) == [3, 2]
    hot.put(_blocks(spark, [4]))
    got = st.tiered_get_blocks(hot.read(), cold.read(), ranges).orderBy("block_height")
    assert _heights(got) == [1, 2, 3, 4]
    assert _heights(st.tiered_latest_blocks(hot.read(), cold.read(), 2).orderBy("rank")) == [4, 3]
    tl = st.tiered_latest_block(hot.read(), cold.read()).collect()[0]
    assert (tl.block_height, tl.tier) == (4, "hot")


def test_flush_needs_threshold(spark):
    base = fresh_path(spark, "contract2")
    hot, cold = BlockTable(spark, f"{base}/hot"), BlockTable(spark, f"{base}/cold")
    hot.put(_blocks(spark, [1, 2]))
    cold.init()
    assert flush_tick(hot, cold, 3) == 0
    assert hot.read().count() == 2


def test_put_policies(spark):
    store = spark.createDataFrame([(CHAIN, 1, "a", 1)], "chain_id string, block_height bigint, block string, seq bigint")
    inc = spark.createDataFrame([(CHAIN, 1, "b", 2), (CHAIN, 1, "c", 3), (CHAIN, 2, "d", 4)],
                                "chain_id string, block_height bigint, block string, seq bigint")
    first = {(r.block_height, r.block) for r in st.put_blocks(store, inc, "first").collect()}
    assert first == {(1, "a"), (2, "d")}
    last = {(r.block_height, r.block) for r in st.put_blocks(store, inc, "last").collect()}
    assert last == {(1, "c"), (2, "d")}
    exact = {(r.block_height, r.block) for r in st.put_blocks(store, inc, "exact").collect()}
    assert exact == {(1, "a"), (1, "b"), (1, "c"), (2, "d")}


def test_partitioned_read_prunes(spark):
    base = fresh_path(spark, "prune")
    t = BlockTable(spark, base)
    t.put(_blocks(spark, list(range(0, 30))))
    plan = t.get_blocks(CHAIN, 5, 9)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "height_bucket" in plan
    assert _heights(t.get_blocks(CHAIN, 5, 9)) == [5, 6, 7, 8, 9]
    t.put(spark.createDataFrame([(CHAIN, 5, "new", 99)], "chain_id string, block_height bigint, block string, seq bigint"), "last")
    assert [r.block for r in t.get_blocks(CHAIN, 5, 5).collect()] == ["new"]
    assert t.read().count() == 30


def test_advance_head_is_monotone(spark):
    prev = spark.createDataFrame([(CHAIN, 10)], "chain_id string, head bigint")
    older = _blocks(spark, [3, 4])
    assert st.advance_head(prev, older).collect()[0].head == 10
    assert st.advance_head(prev, _blocks(spark, [11])).collect()[0].head == 11


def test_bulk_ranges_cross_partitions(spark):
    base = fresh_path(spark, "ranges")
    t = BlockTable(spark, base)
    t.put(_blocks(spark, list(range(9_000, 21_000, 7))))
    ranges = spark.createDataFrame([(CHAIN, 9_990, 10_260, 1), (CHAIN, 19_990, 20_010, 2), (CHAIN, 5, 1, 3)],
                                   "chain_id string, start_height bigint, end_height bigint, range_id bigint")
    got = sorted((r.range_id, r.block_height) for r in st.get_block_ranges(t.read(), ranges, range_bucket=64).collect())
    want = sorted([(1, h) for h in range(9_000, 21_000, 7) if 9_990 <= h <= 10_260] +
                  [(2, h) for h in range(9_000, 21_000, 7) if 19_990 <= h <= 20_010])
    assert got == want
    plain = st.get_block_ranges(t.read().drop("height_bucket"), ranges, range_bucket=1024)
    assert sorted((r.range_id, r.block_height) for r in plain.collect()) == want


from hypothesis import given, settings
from hypothesis import strategies as S


@settings(max_examples=5, deadline=None)
@given(S.lists(S.integers(0, 60), max_size=30, unique=True), S.lists(S.integers(0, 60), max_size=30, unique=True),
       S.integers(0, 60), S.integers(0, 60))
def test_tiered_read_is_read_of_union(spark, hot_h, cold_h, a, b):
    sch = "chain_id string, block_height bigint, block string"
    hot = spark.createDataFrame([(CHAIN, h, f"hot{h}") for h in hot_h], sch)
    cold = spark.createDataFrame([(CHAIN, h, f"cold{h}") for h in cold_h], sch)
    ranges = spark.createDataFrame([(CHAIN, a, b)], "chain_id string, start_height bigint, end_height bigint")
    got = sorted((r.block_height, r.block) for r in st.tiered_get_blocks(hot, cold, ranges).collect())
    union = {h: f"cold{h}" for h in cold_h} | {h: f"hot{h}" for h in hot_h}
    assert got == sorted((h, v) for h, v in union.items() if a <= h <= b)


def test_compaction_applies_tombstones(spark):
    base = fresh_path(spark, "compact")
    t = BlockTable(spark, base)
    t.put(_blocks(spark, list(range(0, 30)) + list(range(20_000, 20_005))))
    t.delete(t.read().where("block_height < 5 or block_height >= 20000"))
    before = sorted(_heights(t.read()))
    assert before == list(range(5, 30))
    assert t.compact() == 2
    assert sorted(_heights(t.read())) == before
    raw = t.spark.read.schema("chain_id string, block_height bigint, block string, seq bigint, height_bucket bigint") \
        .parquet(base)
    assert sorted(_heights(raw)) == before                 # rows are physically gone
    assert t.compact() == 0                                 # tombstones were consumed


MEMBER = "chain_id string, block_height bigint, block string, seq bigint"


def test_put_after_delete_is_visible(spark):
    t = BlockTable(spark, fresh_path(spark, "put-delete-put"))
    one = _blocks(spark, [1, 2, 3])
    t.put(one)
    t.delete(one.where("block_height = 2"))
    assert sorted(_heights(t.read())) == [1, 3]
    t.put(one)
    assert sorted(_heights(t.read())) == [1, 2, 3]
    assert t.compact() == 1
    assert sorted(_heights(t.read())) == [1, 2, 3]
    t.delete(one)
    assert t.compact() == 1 and t.read().count() == 0
    t.put(one)
    assert sorted(_heights(t.read())) == [1, 2, 3]


def test_upsert_there_and_back(spark):
    t = BlockTable(spark, fresh_path(spark, "upsert"))
    row = lambda text, seq: spark.createDataFrame([(CHAIN, 1, text, seq)], MEMBER)
    for seq, text in enumerate(["a", "b", "b", "a", "c", "a"]):
        t.put(row(text, seq), "last")
        assert [r.block for r in t.read().collect()] == [text]
    t.put(row("z", 9), "exact")
    t.put(row("z", 9), "exact")
    assert sorted(r.block for r in t.read().collect()) == ["a", "z"]
    t.compact()
    assert sorted(r.block for r in t.read().collect()) == ["a", "z"]


def test_compaction_keeps_what_arrives_meanwhile(spark, monkeypatch):
    t = BlockTable(spark, fresh_path(spark, "append-compact"))
    t.put(_blocks(spark, [1, 2, 3, 4]))
    t.delete(_blocks(spark, [1]))
    visible, other = BlockTable._visible, BlockTable(spark, t.path)

    def late(data, tombs):
        # another writer puts and deletes after the files were listed
        monkeypatch.setattr(BlockTable, "_visible", staticmethod(visible))
        other.put(_blocks(spark, [5]))
        other.delete(_blocks(spark, [2]))
        return visible(data, tombs)

    monkeypatch.setattr(BlockTable, "_visible", staticmethod(late))
    assert t.compact() == 1
    assert sorted(_heights(t.read())) == [3, 4, 5]
    assert t.compact() == 1
    assert sorted(_heights(t.read())) == [3, 4, 5]


def test_failed_compaction_is_made_good(spark, monkeypatch):
    t = BlockTable(spark, fresh_path(spark, "failed-compact"))
    t.put(_blocks(spark, [1, 2, 3]))
    t.delete(_blocks(spark, [1]))
    with monkeypatch.context() as m:
        m.setattr(BlockTable, "_fs", lambda self, real=BlockTable._fs: (real(self)[0], Unwilling(real(self)[1])))
        try:
            t.compact()
        except OSError:
            pass
    assert sorted(set(_heights(t.read()))) == [2, 3]
    t.compact()
    assert sorted(_heights(t.read())) == [2, 3]


def test_compaction_that_fails_between_the_deletions_is_made_good(spark, monkeypatch):
    """All file addresses need quoting; the files that tasks leave go through the driver."""
    t = BlockTable(spark, fresh_path(spark, "half compact%41"))
    rows = _blocks(spark, range(40)).withColumn("chain_id", F.when(F.col("block_height") % 2 == 0, "a b:c%2").otherwise(CHAIN))
    t.put(rows)
    t.delete(rows.where("block_height < 10"))
    delete, calls = BlockTable._delete, []

    def failing(self, files):
        calls.append(1)
        if len(calls) > 1:
            raise OSError("refused")
        delete(self, files)

    with monkeypatch.context() as m:
        m.setattr(BlockTable, "_delete", failing)
        with pytest.raises(OSError):
            t.compact()
    assert sorted(_heights(t.read())) == list(range(10, 40))
    monkeypatch.setattr(store_io, "_delete_in_task", lambda batches: batches)  # no store is known to the tasks
    assert t.compact() == 2
    raw = spark.read.schema("block_height bigint").parquet(t.path)
    assert sorted(r[0] for r in raw.collect()) == list(range(10, 40))
    assert t.compact() == 0


class Unwilling:
    """A file system that refuses to delete."""

    def __init__(self, fs):
        self.fs = fs

    def __getattr__(self, name):
        return getattr(self.fs, name)

    def delete(self, *args):
        raise OSError("refused")
