"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into ``max_bits // 2 + 1`` segments, so that
of two fingerprints at most ``max_bits`` bits apart one segment differs by at
most one bit.  Every segment is indexed once per bit with that bit deleted
(set to zero); fingerprints meet by an equality join on (bit, rest of the
segment) and each meeting is verified on all 64 bits.

Work is done on distinct fingerprints, so copies cost one row however many
there are.  A signature shared by more than ``BUCKET`` distinct fingerprints
(a large family of near copies) is not joined pair by pair: its members are
looked up by their radius-one neighbours instead.  Two fingerprints are
within two bits exactly if they have a common neighbour at distance one or
less, so grouping by neighbour finds the same links with 65 rows for each
fingerprint, linear in the family's size.  Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh_name, id_and_text, shuffled, text_key
from .components import connected_components

BITS = 64
BUCKET = 32  # distinct fingerprints of one signature that are joined pair by pair
SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the word shingles (repeats included) of a UTF-8 text; 0 without words."""
    words = text.lower().split()  # on bytes: lower-cases A-Z, splits at ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at:min(at + _CHUNK, n)].tolist(), last[at:min(at + _CHUNK, n)].tolist())
        hashes = np.array([digest(line[s:e], SEED) for s, e in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, fp) per row of ``docs`` (doc_id, text); fp is the fingerprint as BIGINT."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(found.view(np.int64))],
                names=["doc_id", "text_key", "fp"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _signatures(fps: DataFrame, segments: int) -> DataFrame:
    """One row (bit, rest, fp) per deleted bit; rest keeps the bit's own segment only."""
    width = -(-BITS // segments)
    rows = []
    for bit in range(BITS):
        low = bit // width * width
        high = min(low + width, BITS)
        mask = ((1 << high) - (1 << low)) & ~(1 << bit)
        rows.append(F.struct(F.lit(bit).cast("byte").alias("bit"),
                             F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("rest")))
    return fps.select("fp", F.explode(F.array(*rows)).alias("s")).select("s.bit", "s.rest", "fp")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def _by_neighbours(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) that join all fingerprints with a common neighbour at distance <= 1."""
    centres = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(BITS)]
    balls = fps.select("fp", F.explode(F.array(*centres)).alias("centre"))
    least = balls.groupBy("centre").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    return balls.join(shuffled(least), "centre").where("a < fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints whose components are those of all links.

    ``fps`` has one BIGINT column ``fp`` without repeats.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # a fingerprint is 8 bytes but grows to 64 rows: adaptive execution would merge such
    # narrow partitions into a few tasks, so the expansion gets a fixed number of them (by a
    # hash of its own: a repartition on the key that the rows are grouped by is dropped)
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    index = _signatures(fps, max_bits // 2 + 1)
    shared = index.groupBy("bit", "rest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut_lineage(index.join(shuffled(shared), ["bit", "rest"]))
    few = met.where(F.col("n") <= BUCKET)
    pairs = (few.select("bit", "rest", F.col("fp").alias("a"))
             .join(few.select("bit", "rest", F.col("fp").alias("b")), ["bit", "rest"])
             .where((F.col("a") < F.col("b")) & (apart <= max_bits)).select("a", "b").distinct())
    if max_bits < 2:  # one segment: a signature has at most two members
        return pairs
    many = met.where(F.col("n") > BUCKET).select("fp").distinct()
    return pairs.unionByName(_by_neighbours(many)).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, text_key, fp, component_id, root) per row of ``docs``.

    component_id is the smallest doc_id reachable over links (null if the
    whole component has null ids), root its smallest fingerprint.  A null text
    counts as empty; texts without words share fingerprint zero and are linked
    like any other; repeated rows and repeated ids are kept row by row; an
    empty table gives an empty result; other columns are not read.
    """
    rows = cut_lineage(fingerprints(id_and_text(docs, id_col, text_col), shingle))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(links(nodes.select("fp"), max_bits))
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = labelled.join(least, "root").select("fp", "root", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "text_key", "fp", "component_id", "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """Rows of ``docs`` with one row of each component left, all columns as they were.

    The row with the smallest id stays (null ids last, then the smallest text
    hash).  Of equal rows (same id and text) one stays.
    """
    found = simhash_components(docs, id_col, text_col, shingle, max_bits)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    one = found.groupBy("root").agg(F.min(order).alias("k"))
    kept = (found.join(one, "root")
            .where(F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_key") == F.col("k.text_key")))
            .groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies")))
    kept = cut_lineage(kept)
    own_id, own_key = fresh_name(docs, "id_"), fresh_name(docs, "key_")
    keyed = docs.withColumns({own_id: docs[id_col].cast("long"), own_key: text_key(docs[text_col])})
    same = keyed[own_id].eqNullSafe(kept["doc_id"]) & (keyed[own_key] == kept["text_key"])
    single = keyed.join(kept.where("copies = 1"), same, "left_semi")
    repeated = keyed.join(kept.where("copies > 1"), same, "left_semi").dropDuplicates([own_id, own_key])
    return single.unionByName(repeated).drop(own_id, own_key)
