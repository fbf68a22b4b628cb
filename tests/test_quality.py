"""Bucketed neighbour windows equal plain windows; gaps; ascending check."""

from hypothesis import given, settings
from hypothesis import strategies as S
from pyspark.sql import Window
from pyspark.sql import functions as F

from chainlake.operators import quality as qa


@settings(max_examples=5, deadline=None)
@given(S.lists(S.tuples(S.sampled_from(["a", "b"]), S.integers(0, 200)), min_size=1, max_size=60, unique=True),
       S.integers(1, 9))
def test_bucketed_lag_lead_match_plain(spark, rows, bucket):
    df = spark.createDataFrame(rows, "chain_id string, block_height bigint").withColumn("seq", F.col("block_height"))
    w = Window.partitionBy("chain_id").orderBy("seq")
    plain = {(r.chain_id, r.seq): (r.p, r.n) for r in
             df.select("chain_id", "seq", F.lag("block_height").over(w).alias("p"),
                       F.lead("block_height").over(w).alias("n")).collect()}
    prev = qa.with_previous(df, "chain_id", "seq", "block_height", "p", bucket)
    both = qa.with_next(prev, "chain_id", "seq", "block_height", "n", bucket)
    got = {(r.chain_id, r.seq): (r.p, r.n) for r in both.collect()}
    assert got == plain


def test_gaps_and_ascending(spark):
    store = spark.createDataFrame([("c", h) for h in [0, 1, 2, 5, 6, 9]], "chain_id string, block_height bigint")
    gaps = sorted((r.gap_start, r.gap_end) for r in qa.height_gaps(store, bucket=4).collect())
    assert gaps == [(3, 4), (7, 8)]
    arr = spark.createDataFrame([("c", 1, 10), ("c", 2, 11), ("c", 3, 11), ("c", 4, 9), ("c", 5, 12)],
                                "chain_id string, seq bigint, block_height bigint")
    bad = sorted(r.seq for r in qa.check_ascending(arr, bucket=2).collect())
    assert bad == [3, 4]


def test_expected_heights_buckets(spark):
    heads = spark.createDataFrame([("c", 3, 25)], "chain_id string, low bigint, head bigint")
    hs = sorted(r.block_height for r in qa.expected_heights(heads, bucket=7).collect())
    assert hs == list(range(3, 26))


@settings(max_examples=5, deadline=None)
@given(S.lists(S.tuples(S.sampled_from(["a", "b"]), S.integers(0, 100)), min_size=1, max_size=50),
       S.integers(1, 30))
def test_bucketed_row_number_matches_plain(spark, rows, bucket):
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "k string, t bigint, i bigint")
    w = Window.partitionBy("k").orderBy("t", "i")
    plain = {r.i: r.rn for r in df.select("i", F.row_number().over(w).alias("rn")).collect()}
    got = qa.bucketed_row_number(df, ["k"], ["t", "i"], F.floor(F.col("t") / bucket).cast("bigint"), "rn")
    assert {r.i: r.rn for r in got.collect()} == plain
