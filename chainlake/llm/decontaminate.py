"""Benchmark decontamination: size-partitioned MinHash containment search.

An item with q distinct shingles is contained in a document at threshold t if
the document holds at least ceil(t * q) of them.  Items are partitioned by
size; within a partition with at most u shingles an item's sketch is its
u - ceil(t * u) + 1 smallest shingle hashes (bottom-k MinHash).  A document
that holds the item misses at most q - ceil(t * q) shingles, fewer than the
sketch has, so it shows at least one sketch hash: the candidate search loses
nothing, however long the document.  Candidates are verified by the exact
number of the item's shingles, compared as text.

Documents are read once.  A bitmap of fixed size lets only shingles that may
belong to an item leave the scan; these meet the sketches of the items, and the
candidates alone meet all shingles of their items, in equality joins that Spark
may broadcast or shuffle by size.  Documents with the same set of such shingles
(copies of a passage) are joined once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, id_and_text, text_key
from .grams import Words, filter_test, hash_filter

SHINGLE = 5
CONTAINMENT = 0.8


def least_shared(q: int, threshold: float) -> int:
    """Fewest shared shingles n with n / q >= threshold."""
    n = max(0, math.ceil(threshold * q) - 1)
    return n if q and n / q >= threshold else n + 1


def sketch_length(q: int, threshold: float) -> int:
    """Sketch length of the size partition of items with ``q`` shingles."""
    u = 1 << (q - 1).bit_length()  # the partition holds sizes above u / 2, up to u
    return u - least_shared(u, threshold) + 1


def item_shingles(items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(item_id, item_key, gram, hash, n_words, q, in_sketch) per distinct shingle of each item.

    An item with fewer words than ``shingle`` is one shingle of all its words;
    one without words has none and matches nothing.
    """
    names = ["item_id", "item_key", "gram", "hash", "n_words", "q", "in_sketch"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for item, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_key", "text"))):
                words = Words(text)
                n = min(shingle, len(words))
                if not n:
                    continue
                own = dict(zip(words.grams(n), words.rolling(n).view(np.int64).tolist()))
                least = set(sorted(own.values())[:sketch_length(len(own), threshold)])
                for gram, h in own.items():
                    for column, value in zip(out, (item, key, gram, h, n, len(own), h in least)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return items.withColumn("item_key", F.xxhash64("text")).mapInArrow(
        run, "item_id long, item_key long, gram binary, hash long, n_words int, q long, in_sketch boolean")


def _bitmap(shingles: DataFrame) -> bytes:
    """OR of the partitions' bitmaps: one row of at most 2 MB per partition reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << 21, np.uint8)
        for batch in batches:
            bits |= np.frombuffer(hash_filter(batch.column("hash").to_numpy().view(np.uint64)), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(1 << 21, np.uint8)
    for row in shingles.select("hash").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(row.bits, np.uint8)
    return total.tobytes()


def sketch_candidates(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct (grams_key, item_id, item_key, q) of sets that show a sketch hash of an item; pairs (grams_key, gram)."""
    sketch = index.where("in_sketch").select("gram", "item_id", "item_key", "q")
    return pairs.join(sketch, "gram").select("grams_key", "item_id", "item_key", "q").distinct()


def verified(candidates: DataFrame, pairs: DataFrame, index: DataFrame) -> DataFrame:
    """``candidates`` with n_shared, the exact number of the item's shingles in the set."""
    grams = index.select(F.col("item_id").alias("_id"), F.col("item_key").alias("_key"), "gram")
    same = F.col("item_id").eqNullSafe(F.col("_id")) & (F.col("item_key") == F.col("_key"))
    return (candidates.join(grams, same).drop("_id", "_key").join(pairs, ["grams_key", "gram"])
            .groupBy("grams_key", "item_id", "item_key", "q").agg(F.count(F.lit(1)).alias("n_shared")))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE,
                 threshold: float = CONTAINMENT) -> DataFrame:
    """(doc_id, text_key, item_id, n_shared, n_item, containment) per document and item it contains.

    One row for each distinct (document id, text, item); null texts are empty
    and contain nothing; null ids stay null and are matched by text; items
    without words match nothing; of items with equal ids each text is an item
    of its own; empty tables give an empty result; other columns are not read.
    """
    index = cut_lineage(item_shingles(id_and_text(items, item_id_col, item_text_col).distinct(), shingle, threshold))
    orders = sorted(r.n_words for r in index.select("n_words").distinct().collect())  # 1 to shingle at most
    shared_bits = docs.sparkSession.sparkContext.broadcast(_bitmap(index))  # 2 MB always

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_match = filter_test(shared_bits.value)
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = Words(text)
                own = {words.gram(at, n) for n in orders
                       for at in np.flatnonzero(may_match(words.rolling(n))).tolist()}
                if own:
                    rows.append(i)
                    found.append(sorted(own))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_key").take(at),
                 pa.array(found, pa.list_(pa.binary()))], names=["doc_id", "text_key", "grams"])

    hits = (id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
            .mapInArrow(run, "doc_id long, text_key long, grams array<binary>")
            .withColumn("grams_key", F.sha2(F.array_join(F.transform("grams", F.hex), ","), 256)))
    hits = cut_lineage(hits)
    sets = hits.groupBy("grams_key").agg(F.first("grams").alias("grams"))
    pairs = sets.select("grams_key", F.explode("grams").alias("gram"))
    shared = (verified(sketch_candidates(pairs, index), pairs, index)
              .where(F.col("n_shared") / F.col("q") >= threshold))
    return (hits.select("doc_id", "text_key", "grams_key").distinct().join(shared, "grams_key")
            .select("doc_id", "text_key", "item_id", "n_shared", F.col("q").alias("n_item"),
                    (F.col("n_shared") / F.col("q")).alias("containment")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **parameters) -> DataFrame:
    """Rows of ``docs`` that contain no item, all columns as they were."""
    found = (contaminated(docs, items, id_col, text_col, **parameters)
             .select("doc_id", "text_key").distinct())
    same = docs[id_col].cast("long").eqNullSafe(found["doc_id"]) & (text_key(docs[text_col]) == found["text_key"])
    return docs.join(found, same, "left_anti")
