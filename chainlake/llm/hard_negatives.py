"""Hard negatives by inner product, mined with STR-packed R-trees.

For each anchor: its best rows of the same label (the positives), and for each
positive the best rows of other labels whose score lies in a window below the
positive's.  Scores are integer inner products; higher first, ties by the
smaller id.

The index is a forest of R-trees, each over at most about ``PART`` rows that
one task holds.  A tree is packed by sort-tile-recursive: rows are sorted by
the coordinate of the largest variance and cut into slabs, each slab by the
next coordinate, and so on; ``LEAF`` neighbours make a leaf and ``FAN`` boxes
the box above.  A minimum bounding box [lo, hi] bounds the inner product with
an anchor q coordinate by coordinate: each one adds min(q lo, q hi) to the
lower and max(q lo, q hi) to the upper end.  The search takes boxes from a
queue, largest upper end first.  A box is left out if its interval lies above
all windows of the anchor, or if its upper end is below all of them or strictly
below the k-th best score of each (on equality a smaller id may still win).

Anchors meet the trees in blocks of ``BLOCK``; every task returns its k best
rows for each window, and a window function keeps the k best of all tasks.
Nothing else is dropped, so the result is exact whatever the sizes.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, ship_package

PART = 16384
BLOCK = 1024
LEAF = 256
FAN = 16
_EXACT = 1 << 53  # integers below are exact in double precision


class RTree:
    """R-tree over integer vectors; level 0 are the leaves, the last level is the root."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.order = _tile(vectors, leaf)
        self.vectors = vectors[self.order]
        self.leaf, self.fan = leaf, fan
        at = np.arange(0, len(vectors), leaf)
        self.lo, self.hi = [np.minimum.reduceat(self.vectors, at)], [np.maximum.reduceat(self.vectors, at)]
        while len(self.lo[-1]) > 1:
            at = np.arange(0, len(self.lo[-1]), fan)
            self.lo.append(np.minimum.reduceat(self.lo[-1], at))
            self.hi.append(np.maximum.reduceat(self.hi[-1], at))

    def intervals(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(lower, upper) ends of the inner products, (anchors, boxes), for each level."""
        plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return [(plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T) for lo, hi in zip(self.lo, self.hi)]


def _tile(vectors: np.ndarray, leaf: int) -> np.ndarray:
    """Row order of sort-tile-recursive packing."""
    pages = -(-len(vectors) // leaf)
    spread = np.asarray(vectors, np.float64).var(axis=0)
    axes = np.argsort(-spread, kind="stable")[:max(1, int(math.log2(max(pages, 1))))]

    def cut(rows: np.ndarray, axes: np.ndarray) -> list[np.ndarray]:
        if not len(axes) or len(rows) <= leaf:
            return [rows]
        rows = rows[np.argsort(vectors[rows, axes[0]], kind="stable")]
        if len(axes) == 1:
            return [rows]
        slabs = math.ceil((-(-len(rows) // leaf)) ** (1 / len(axes)))
        size = leaf * -(-len(rows) // (leaf * slabs))  # whole leaves
        return [part for low in range(0, len(rows), size) for part in cut(rows[low:low + size], axes[1:])]

    return np.concatenate(cut(np.arange(len(vectors)), axes))


def search(tree: RTree, ids: np.ndarray, allowed: np.ndarray, anchor: np.ndarray, ends: list[tuple[np.ndarray, np.ndarray]],
           windows: list[tuple[float, float]], k: int) -> list[list[tuple[int, int]]]:
    """The k best (-score, id) of each window [low, high] of scores, best first.

    ``ids`` and ``allowed`` are in the tree's row order; ``ends`` are this
    anchor's (lower, upper) ends for each level.  All windows share one queue.
    """
    best: list[list[tuple[int, int]]] = [[] for _ in windows]
    need = [low for low, _ in windows]  # a row below this score cannot enter
    high = max(high for _, high in windows)
    least = min(need)
    top = len(ends) - 1
    queue = [(-ends[top][1][0], ends[top][0][0], top, 0)]
    while queue:
        upper, lower, level, box = heapq.heappop(queue)
        if -upper < least:
            break  # nothing left reaches any window
        if lower > high:
            continue
        if level:
            low = box * tree.fan
            lows, highs = (e[low:low + tree.fan] for e in ends[level - 1])
            for child in np.flatnonzero((highs >= least) & (lows <= high)).tolist():
                heapq.heappush(queue, (-highs[child], lows[child], level - 1, low + child))
            continue
        rows = slice(box * tree.leaf, (box + 1) * tree.leaf)
        scores = tree.vectors[rows] @ anchor
        for i in np.flatnonzero((scores >= least) & (scores <= high) & allowed[rows]).tolist():
            score = int(scores[i])
            for w, (_, end) in enumerate(windows):
                if need[w] <= score <= end:
                    bisect.insort(best[w], (-score, int(ids[rows.start + i])))
                    if len(best[w]) > k:
                        best[w].pop()
                    if len(best[w]) == k:
                        need[w] = max(need[w], -best[w][-1][0])
        least = min(need)
    return best


def _numbers(*parts: pd.Series) -> list[np.ndarray]:
    """Integer matrices of the vectors: doubles where every product is exact in them, else Python integers."""
    matrices = [np.vstack(p.to_list()) for p in parts]
    largest = math.prod(max(-int(m.min()), int(m.max())) for m in matrices)
    exact = largest * matrices[0].shape[1] < _EXACT
    return [m.astype(np.float64 if exact else object) for m in matrices]


def _group_search(key: tuple, rows: pd.DataFrame, anchors: pd.DataFrame, same: bool, k: int) -> Iterator[tuple]:
    """(anchor row, window number, id, score) of one tree and one block of anchors."""
    if not len(rows) or not len(anchors):
        return
    if not len(rows.vec.iloc[0]):  # vectors without components: every score is 0
        vectors, points = np.zeros((len(rows), 1)), np.zeros((len(anchors), 1))
    else:
        vectors, points = _numbers(rows.vec, anchors.vec)
    tree = RTree(vectors)
    ids, row, code = (rows[c].to_numpy()[tree.order] for c in ("vec_id", "row", "code"))
    ends = tree.intervals(points)
    for a, (own, label, lows, highs) in enumerate(zip(anchors.row, anchors.code, anchors.lows, anchors.highs)):
        allowed = (code == label) & (row != own) if same else code != label
        spans = [(-math.inf, math.inf)] if same else list(zip(lows.tolist(), highs.tolist()))
        levels = [(lower[a], upper[a]) for lower, upper in ends]
        for w, found in enumerate(search(tree, ids, allowed, points[a], levels, spans, k)):
            for score, vec_id in found:
                yield own, w, vec_id, -score


def _search_all(trees: DataFrame, anchors: DataFrame, on: list[str], same: bool, k: int) -> DataFrame:
    """(row, window, vec_id, score): the k best per anchor row and window over all trees."""
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(_group_search(key, left, right, same, k))
        return pd.DataFrame(found, columns=["row", "window", "vec_id", "score"]).astype("int64")

    anchors = anchors.toDF(*anchors.columns)  # both sides come from the same rows: give one new column ids
    found = trees.groupBy(*on).cogroup(anchors.groupBy(*on)).applyInPandas(run, "row long, window long, vec_id long, score long")
    ranked = Window.partitionBy("row", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def valid_rows(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part; vec holds floor(scale * x) as integers."""
    vec = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return (rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
            .withColumn("vec", F.transform("vec", lambda x: F.floor(scale * x).cast("long"))))


def mine_hard_negatives(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3,
                        low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id",
                        vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vec_id``.  An anchor's positives are its
    first ``positives`` other rows of the same label; a negative has another
    label and low * positive_score <= 100 * negative_score <= high *
    positive_score.  Rows with a null id, label or vector, or with a null or
    non-finite component take no part; vectors of different lengths never
    meet, and those without components score 0.  Rows that repeat an id are
    rows of their own: each is an anchor, and another copy is an "other row".
    Anchors without positives or negatives give no row; an empty table gives
    an empty result; other columns are not read.  Scores must fit 64 bits.
    """
    ship_package(df.sparkSession)
    rows = valid_rows(df, id_col, vector_col, label_col, scale)
    rows = cut_lineage(rows).withColumn("row", F.monotonically_increasing_id())  # over written rows: stable
    rows = rows.withColumn("dim", F.size("vec")).withColumn("code", F.xxhash64("label"))
    anchors = rows.where(is_anchor)
    nothing = F.lit(None).cast("array<long>")
    # positives: trees of one label, asked by the anchors of that label
    own = _deal(rows, anchors, ["dim", "label"])
    found = _search_all(own[0], own[1].withColumn("lows", nothing).withColumn("highs", nothing),
                        ["dim", "label", "part", "block"], True, positives)
    found = cut_lineage(found.select("row", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
                                     F.col("score").alias("positive_score")))
    # negatives: trees over all labels, each anchor asks for all its windows at once
    wide = "cast(positive_score as decimal(25, 0))"  # its multiples may pass 64 bits
    ceiling = F.expr(f"({low} * {wide} + pmod(-{low} * {wide}, 100)) div 100")
    floor = F.expr(f"({high} * {wide} - pmod({high} * {wide}, 100)) div 100")
    windows = found.groupBy("row").agg(F.array_sort(F.collect_list(  # at most ``positives`` of them
        F.struct("place", ceiling.alias("low"), floor.alias("high")))).alias("w"))
    asking = anchors.join(windows.select("row", F.col("w.low").alias("lows"), F.col("w.high").alias("highs")), "row")
    mixed = _deal(rows, asking, ["dim"])
    close = _search_all(mixed[0], mixed[1], ["dim", "part", "block"], False, negatives)
    close = close.select("row", (F.col("window") + 1).cast("int").alias("place"), F.col("rank").cast("int").alias("rank"),
                         F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return close.join(found, ["row", "place"]).join(names, "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _deal(rows: DataFrame, anchors: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows dealt to trees and anchors to blocks within each group; every tree meets every block of its group."""
    parts = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    blocks = anchors.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = parts.join(blocks, by)

    def place(count: str) -> Column:
        return F.pmod(F.xxhash64("row"), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    trees = rows.join(sizes, by).withColumn("part", place("parts")).withColumn("block", every("blocks"))
    asking = anchors.join(sizes, by).withColumn("block", place("blocks")).withColumn("part", every("parts"))
    return (trees.select(*by, "part", "block", "row", "vec_id", "code", "vec"),
            asking.drop("parts", "blocks", "vec_id"))
