"""Zone table of the store, exact stream deduplication, and payload forms that the fixtures lack."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.operators import store as st
from chainlake.sources import payloads as pl
from chainlake.sources.store_io import BlockTable, fresh_path, tiered_latest, write_blocks_partitioned
from chainlake.streaming import runners

BLOCK = "chain_id string, block_height bigint, block string"


def frame(spark, members):
    return spark.createDataFrame([(c, h, f"{c}{h}") for c, h in members], BLOCK)


def newest(members, n):
    chains = {c for c, _ in members}
    return sorted(x for c in chains for x in sorted((m for m in members if m[0] == c), reverse=True)[:n])


def read(df):
    return sorted((r.chain_id, r.block_height) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_latest_equals_a_full_scan_after_puts_and_deletes(spark, seed):
    draw = random.Random(seed)
    table, kept = BlockTable(spark, fresh_path(spark, "zones")).init(), set()
    universe = [(c, h) for c in ("a", "b") for h in draw.sample(range(8 * st.HEIGHT_BUCKET), 60)]
    for step in range(5):
        some = draw.sample(universe, 30)
        if step in (1, 3):  # also heights that are not there, and the newest ones
            some += newest(kept, 12)
            table.delete(frame(spark, some))
            kept -= set(some)
        else:
            table.put(frame(spark, some))
            kept |= set(some)
        if step == 3:
            table.fold_zones()
        n = draw.choice([1, 5, 20, 100])
        assert read(table.latest(n)) == newest(kept, n)
    assert {r.chain_id: r.head for r in table.heads().collect()} == {c: max(h for k, h in kept if k == c) for c in {k for k, _ in kept}}
    assert table.latest(0).count() == 0


def test_only_the_newest_partitions_are_read(spark):
    """Older partitions are gone from the disk: a read of them would fail."""
    table = BlockTable(spark, fresh_path(spark, "zones"))
    table.put(frame(spark, [("a", h) for h in range(0, 5 * st.HEIGHT_BUCKET, 16)]))
    per = st.HEIGHT_BUCKET // 16
    top = table.newest_partitions(per + 1)
    assert sorted(r.height_bucket for r in top.collect()) == [3, 4]
    rows = table.read().join(F.broadcast(top), ["chain_id", "height_bucket"], "left_semi")
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert len(read(table.latest(per))) == per


def test_zones_that_count_too_much_are_found_out(spark):
    """A write that failed after its zones were recorded, and repeated puts: the result stays right."""
    table = BlockTable(spark, fresh_path(spark, "zones"))
    table.put(frame(spark, [("a", 1), ("a", 2), ("a", st.HEIGHT_BUCKET + 1)]))
    lost = BlockTable.prepare(frame(spark, [("a", 9 * st.HEIGHT_BUCKET + k) for k in range(5)]))
    table._record(lost)
    table.put(frame(spark, [("a", 2)]))
    assert read(table.latest(2)) == [("a", 2), ("a", st.HEIGHT_BUCKET + 1)]


def test_tables_without_zones(spark):
    path = fresh_path(spark, "zones")
    (BlockTable.prepare(frame(spark, [("a", 5), ("b", 7)])).withColumn("version", F.lit(1).cast("bigint"))
     .write.partitionBy("chain_id", "height_bucket").parquet(path))
    table = BlockTable(spark, path)
    assert read(table.latest(1)) == [("a", 5), ("b", 7)]
    bulk = fresh_path(spark, "zones")
    write_blocks_partitioned(frame(spark, [("a", h) for h in range(3000)]), bulk)
    assert read(BlockTable(spark, bulk).latest(2)) == [("a", 2998), ("a", 2999)]
    cold = BlockTable(spark, fresh_path(spark, "zones")).init()
    assert read(tiered_latest(table, cold, 3)) == [("a", 5), ("b", 7)]
    assert BlockTable(spark, fresh_path(spark, "zones")).latest(3).count() == 0


def test_rows_without_a_key_are_no_blocks(spark):
    rows = spark.createDataFrame([("a", None, "x"), (None, 1, "y"), ("a", 3, "z"), ("a", 4, None)], BLOCK)
    store = spark.createDataFrame([("a", 1, "o")], BLOCK)
    for policy in ("first", "last", "exact"):
        once = st.put_blocks(store, rows, policy)
        assert read(once) == read(st.put_blocks(once, rows, policy)) == [("a", 1), ("a", 3)]
    table = BlockTable(spark, fresh_path(spark, "zones"))
    table.put(rows)
    table.put(rows)
    assert read(table.read()) == [("a", 3)]
    good, bad = pl.split_blocks(rows)
    assert read(good) == [("a", 3)] and sorted(r.reason for r in bad.collect()) == ["no chain", "no document", "no height"]


# ---------------------------------------------------------------- stream deduplication

def test_interval_set_equals_a_set():
    draw = random.Random(0)
    for _ in range(200):
        starts, ends, seen = np.array([], np.int64), np.array([], np.int64), set()
        for _ in range(draw.randint(1, 8)):
            new = sorted(set(draw.sample(range(40), draw.randint(1, 10))) - seen)
            if new:
                starts, ends = runners._add(starts, ends, np.array(new, np.int64))
                seen |= set(new)
            assert {h for s, e in zip(starts, ends) for h in range(s, e + 1)} == seen
            assert (starts[1:] > ends[:-1] + 1).all() and (starts <= ends).all()


def test_copies_of_any_age_are_dropped_over_a_restart(spark):
    base = fresh_path(spark, "dedupe")
    schema = T.StructType.fromDDL("chain_id string, block_height bigint, seq bigint, block string")
    draw = random.Random(3)
    files = [[(draw.choice("ab"), draw.randint(-5, 60), 10 * k + i, "x") for i in range(40)] for k in range(4)]
    files[0] += [("a", None, 0, "x"), (None, 1, 0, "x")]
    heights = {(c, h) for f in files for c, h, *_ in f if c and h is not None}

    def run(some):
        for rows in some:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/src")
        stream = runners.dedupe_stream_exact(runners.ingest_stream(spark, f"{base}/src", schema, 1), span=16)
        runners.run_available_now(stream, lambda df, bid: df.write.mode("append").parquet(f"{base}/out"), f"{base}/ckpt")

    run(files[:2])
    run(files[2:] + [files[0]])  # a new query over the same checkpoint, and all rows of the first file once more
    out = spark.read.parquet(f"{base}/out")
    assert out.columns == schema.fieldNames()
    assert read(out) == sorted(heights)  # no copy twice, none lost


# ---------------------------------------------------------------- payload forms

def test_heights_in_both_forms(spark):
    texts = {"16": 16, "0x10": 16, "0XfF": 255, "0x7fffffffffffffff": 2 ** 63 - 1, "0xffffffffffffffff": None, "0x": None,
             "0x1g": None, "9223372036854775808": None, "1.5": None, "": None, "-3": -3, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pl.block_number(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == texts
    raw = spark.createDataFrame([("c", '{"number":"0x10","hash":"h","transactions":[{"to":"a"}]}'), ("c", '{"number":17}'), ("c", "no json")],
                                "chain_id string, raw string")
    got = pl.normalize_evm_blocks(raw)
    assert [r.block_height for r in got.collect()] == [16, 17, None]
    assert '"number":16' in got.first().block
    assert pl.explode_transactions(raw).first().block_height == 16
    good, bad = pl.split_blocks(got)
    assert (good.count(), [r.reason for r in bad.collect()]) == (2, ["no height"])


def test_flow_times(spark):
    texts = {"2023-01-01T10:00:00Z": "2023-01-01 10:00:00", "2023-01-01T10:00:00.123456789Z": "2023-01-01 10:00:00.123456",
             "2023-01-01T12:00:00.5+02:00": "2023-01-01 10:00:00.500000", "2023-01-01 10:00:00.123 +0000 UTC": "2023-01-01 10:00:00.123000",
             "2023-01-01 10:00:00 +0000 UTC": "2023-01-01 10:00:00", "2023-01-01 10:00:00 -0130 X": "2023-01-01 11:30:00",
             "2023-01-01": None, "": None, "soon": None, "2023-13-01T10:00:00Z": None, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", pl.flow_time(F.col("t")).cast("timestamp_ntz").alias("ts")).collect()
    assert {r.t: r.ts and str(r.ts) for r in rows} == texts


def test_documents_of_any_schema(spark):
    schema = T.StructType.fromDDL("d decimal(38,0), f float, s smallint, t timestamp, l array<bigint>, m map<string,bigint>, r struct<x: int>")
    good = '{"d":123456789012345678901234567890,"f":1.5,"s":3,"t":"2023-01-01 00:00:00","l":[1,2],"m":{"k":1},"r":{"x":1}}'
    bad = '{"d":"1","f":"x","s":70000,"t":5,"l":{},"m":[],"r":1}'
    got = pl.enforce_schema(spark.createDataFrame([(good,), (bad,)], "doc string"), schema).collect()
    assert got[0].reason is None and int(got[0].d) == 123456789012345678901234567890 and got[0].l == [1, 2] and got[0].r.x == 1
    assert got[1].reason == "; ".join(f"bad type for {f}" for f in "dfstlmr")
    with pytest.raises(ValueError, match="interval"):
        pl.enforce_schema(spark.createDataFrame([("{}",)], "doc string"), T.StructType.fromDDL("i interval day"))
