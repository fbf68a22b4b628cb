"""Exact cosine range join of vectors by pivots and the triangle inequality.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so the cosine threshold is
a metric range r.  Each vector belongs to the cell of its nearest pivot and is
copied to every earlier cell j with d(x, p_j) <= d(x, p_home) + 2r: by the
triangle inequality a partner at home in j cannot exist otherwise.  (The
distance to the bisecting hyperplane, at most r, is a second exact bound.)
A pair counts in the cell of the earlier of its two homes, where both are.

A label starts as one cell.  Cells of over ``CELL`` vectors are split by up to
``PIVOTS`` pivots of their own, level by level, so the number of pivots follows
the number of vectors and no task holds more than one cell's pivots.  At each
level a vector either owns its cell (it is at home there) or is a copy; a pair
counts where, at every level, one of the two owns the cell.  A cell is left
whole if its sample says that copies would eat up at least half of the gain
(vectors that are all within about r of each other, or all about equally far
apart as random ones of many dimensions are).  Cells then join independently.

Equal vectors are one class with a count, so copies are never paired.  A cell
is dealt out in blocks of about ``BLOCK`` rows, and a task joins one pair of
blocks; it returns link counts and a spanning forest of its links, never the
pairs, so a family of n near copies costs rows in proportion to n.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, ship_package
from .components import connected_components

CELL = 4096          # cells of more vectors are split
PIVOTS = 64          # at most for one split; further levels give more
PIVOT_SAMPLE = 2000  # vectors of a cell that its pivots are chosen from; only speed depends on it
GAIN = 0.5           # a split is made if it leaves at most this share of the cell's pairs
LEVELS = 60          # bits of ``owns``; each level halves the pairs at least
BLOCK = 1024
_CELL_KEY = ["label", "dim", "cell"]
_SLACK = 1e-9


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vec) of rows that can link: label and vector present, finite and not zero."""
    vec = F.col(vector_col).cast("array<double>")
    good = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False))
    nonzero = F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))
    plain = F.transform(vec, lambda x: x + F.lit(0.0))  # one zero
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), plain.alias("vec"),
                     (good & nonzero & F.col(label_col).isNotNull()).alias("valid"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows far from each other (farthest first, from the first row)."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def cells_of(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and (rows, pivots) whether the cell, home or an earlier one, needs the vector."""
    squared = np.maximum(0, 2 - 2 * x @ pivots.T)
    home = squared.argmin(axis=1)
    near = squared[np.arange(len(x)), home][:, None]
    triangle = np.sqrt(squared) <= np.sqrt(near) + 2 * radius + _SLACK
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[home]
    plane = squared - near <= 2 * radius * apart + _SLACK
    needs = triangle & plane & (np.arange(len(pivots)) <= home[:, None])
    needs[np.arange(len(x)), home] = True
    return home, needs


def join_blocks(left: tuple, right: tuple, levels: int, threshold: float, same: bool) -> pd.DataFrame:
    """(node, links, root) for one pair of blocks, each (class ids, levels owned as bits, copies, vectors)."""
    ids = [np.asarray(b[0]) for b in (left, right)]
    x, y = (np.vstack(b[3]) if len(b[0]) else np.empty((0, 1)) for b in (left, right))
    empty = pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
    if not len(x) or not len(y):
        return empty
    cosine = _unit(x) @ _unit(y).T
    linked = cosine >= threshold
    for i, j in np.argwhere(np.abs(cosine - threshold) < _SLACK):  # decided by the plain formula
        a, b = x[i], y[j]
        linked[i, j] = a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= threshold
    linked &= (np.asarray(left[1], np.int64)[:, None] | np.asarray(right[1], np.int64)[None]) == (1 << levels) - 1
    if same:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return empty
    out = linked @ np.asarray(right[2], np.float64)
    back = np.zeros(len(y)) if same else np.asarray(left[2], np.float64) @ linked
    # spanning forest: everyone takes the smallest class id it is linked to until nothing changes
    big = np.iinfo(np.int64).max
    at_x, at_y = ids[0].copy(), ids[1].copy()
    while True:
        new_x = np.minimum(at_x, np.where(linked, at_y[None], big).min(axis=1))
        new_y = np.minimum(at_y, np.where(linked, new_x[:, None], big).min(axis=0))
        if same:
            new_x = new_y = np.minimum(new_x, new_y)
        if (new_x == at_x).all() and (new_y == at_y).all():
            break
        at_x, at_y = new_x, new_y
    parts = [(ids[0], out, at_x)] + ([] if same else [(ids[1], back, at_y)])
    rows = pd.concat([pd.DataFrame({"node": i, "links": np.rint(n).astype("int64"), "root": r})[n > 0] for i, n, r in parts])
    return rows.astype("int64")


def near_vectors(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``df``.

    Rows link if their labels are equal and not null and their cosine (double
    precision) is at least ``threshold`` > 0.  Null vectors, zero vectors and
    those with null or non-finite components link with nothing: n_links 0 and
    a component of their own.  Vectors of different lengths never link.  Rows
    that repeat an id count one by one and all carry its result per row; null
    ids are kept and never represent others; an empty table gives an empty
    result; other columns are not read.
    """
    ship_package(df.sparkSession)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK
    rows = valid_vectors(df, id_col, vector_col, label_col)
    classes = (rows.where("valid").groupBy("label", "vec")
               .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
               .withColumn("dim", F.size("vec")))
    classes = cut_lineage(classes).withColumn("node", F.monotonically_increasing_id())  # over written rows: stable
    found = cut_lineage(_join_cells(_cells(classes, radius), threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    labelled = (classes.select("node", "label", "vec", "copies", "least")
                .join(links, "node", "left").join(roots, "node", "left")
                .withColumn("root", F.coalesce("root", "node")))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = labelled.join(least, "root").select(
        F.col("label").alias("_label"), F.col("vec").alias("_vec"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = rows.where("valid").join(by_class, (F.col("label") == F.col("_label")) & (F.col("vec") == F.col("_vec")))
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (linked.select("vec_id", "n_links", "component_id").unionByName(alone)
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def _cells(classes: DataFrame, radius: float) -> DataFrame:
    """(label, dim, cell, owns, node, copies, vec) for each cell that needs a class; cells are paths of pivot numbers."""
    level = classes.select("label", "dim", F.lit("0").alias("cell"), F.lit(0).cast("long").alias("owns"), "node", "copies", "vec")
    done = []
    for depth in range(LEVELS):
        large = cut_lineage(level.groupBy(*_CELL_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL))
        if large.isEmpty():
            break
        pivots = cut_lineage(_pivots(level, large, radius))
        if pivots.isEmpty():
            break
        done.append(level.join(pivots.select(*_CELL_KEY), _CELL_KEY, "left_anti"))
        level = cut_lineage(_split(level, pivots, radius, depth))
    for part in done:
        level = level.unionByName(part)
    return level


def _pivots(level: DataFrame, large: DataFrame, radius: float) -> DataFrame:
    """(label, dim, cell, n, pivots) of the large cells that are worth a split."""
    some = Window.partitionBy(*_CELL_KEY).orderBy(F.xxhash64("vec"), "node")
    sample = (level.select(*_CELL_KEY, "node", "vec").join(large, _CELL_KEY)
              .withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= PIVOT_SAMPLE))  # a group limit

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.vstack(group.vec))
        pivots = choose_pivots(x, min(PIVOTS, -(-4 * int(group.n.iloc[0]) // CELL)))
        _, needs = cells_of(x, pivots, radius)
        worth = (needs.sum(axis=0, dtype=np.float64) ** 2).sum() <= GAIN * len(x) ** 2
        own = group[[*_CELL_KEY, "n"]].head(int(worth)).reset_index(drop=True)
        return own.assign(pivots=pd.Series([pivots.ravel()] * int(worth), dtype=object))

    label = level.schema["label"].dataType.simpleString()
    return sample.groupBy(*_CELL_KEY).applyInPandas(
        run, f"label {label}, dim int, cell string, n long, pivots array<double>")


def _split(level: DataFrame, pivots: DataFrame, radius: float, depth: int) -> DataFrame:
    """The rows of the cells with pivots in their new cells; a task takes about ``BLOCK`` rows and their cell's pivots."""
    shares = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = (level.join(pivots.select(*_CELL_KEY, shares.alias("shares")), _CELL_KEY)
            .withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")).drop("shares"))
    shared = pivots.select(*_CELL_KEY, "pivots", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))

    def run(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names = [*_CELL_KEY, "owns", "node", "copies", "vec"]
        if not len(rows):
            return rows.reindex(columns=names)
        home, needs = cells_of(_unit(np.vstack(rows.vec)), own.pivots.iloc[0].reshape(-1, int(rows.dim.iloc[0])), radius)
        row, cell = np.nonzero(needs)
        out = rows.iloc[row].reset_index(drop=True)
        out["cell"] = out["cell"] + "/" + pd.Series(cell).astype(str)
        out["owns"] = out["owns"] | ((cell == home[row]).astype("int64") << depth)
        return out[names]

    by = [*_CELL_KEY, "share"]
    return rows.groupBy(*by).cogroup(shared.groupBy(*by)).applyInPandas(
        run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in level.schema.fields))


def _join_cells(cells: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) per task in which a class has links."""
    sizes = cells.groupBy(*_CELL_KEY).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = (cells.join(sizes, _CELL_KEY)
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, _, cell, low, high = key
        sides = [group[group.block == b] for b in (low, high)]
        sides = [(g.node.to_numpy(), g.owns.to_numpy(), g.copies.to_numpy(), g.vec.to_list()) for g in sides]
        return join_blocks(*sides, cell.count("/"), threshold, low == high)

    return dealt.groupBy(*_CELL_KEY, "low", "high").applyInPandas(run, "node long, links long, root long")
