import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlake.llm import hard_negatives as h


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95, scale=256):
    good = [(i, y, [math.floor(scale * float(c)) for c in x]) for i, x, y in rows
            if i is not None and y is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for a, (anchor, label, q) in enumerate(good):
        if anchor % every:
            continue
        scored = [(-sum(s * t for s, t in zip(q, v)), i, y == label, n != a) for n, (i, y, v) in enumerate(good) if len(v) == len(q)]
        for score, positive, *_ in sorted(s for s in scored if s[2] and s[3])[:positives]:
            window = sorted(s for s in scored if not s[2] and low * -score <= 100 * -s[0] <= high * -score)
            out += [(anchor, positive, k + 1, s[1], -score, -s[0]) for k, s in enumerate(window[:negatives])]
    return sorted(out)


def mined(spark, rows, every=50, **how):
    df = spark.createDataFrame([(i, x, y, "c", 1) for i, x, y in rows],
                               "vec_id long, embedding array<double>, label int, row string, part int").repartition(3)
    return sorted(tuple(r) for r in h.mine_hard_negatives(df, F.col("vec_id") % every == 0, **how).collect())


@pytest.mark.parametrize("part, block", [(16384, 1024), (40, 3)])
@pytest.mark.parametrize("dim", [2, 20])
def test_equals_brute_force(spark, monkeypatch, part, block, dim):
    """Small parts and blocks force many trees, levels and merges."""
    monkeypatch.setattr(h, "PART", part)
    monkeypatch.setattr(h, "BLOCK", block)
    rng = np.random.default_rng(dim)
    rows = [(i, np.round(rng.normal(size=dim) + 1, 1).tolist(), int(rng.integers(4))) for i in range(300)]  # rounded: ties
    x = rows[0][1]
    rows += [(None, x, 1), (400, None, 1), (401, x, None), (402, [math.nan] * dim, 1), (403, [math.inf] * dim, 1),
             (404, [None] * dim, 1), (405, [], 1), (450, [], 0), (455, [], 0), (410, [1.0], 1), (0, x, rows[0][2]), (0, x, 3)]
    want = brute(rows, 10)
    assert mined(spark, rows, 10) == want and want


def test_one_hot_label_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(h, "PART", 64)
    rows = [(i, [1.0, 2.0], 0) for i in range(200)] + [(500 + i, [0.5 + i / 100, 1.0], 1) for i in range(60)]
    want = brute(rows, 50)
    assert mined(spark, rows, 50) == want and want


def test_large_components_are_exact(spark):
    rows = [(i, [float(2 ** 20 + i), -3.0 * 2 ** 18, float(i)], i % 2) for i in range(60)]
    assert mined(spark, rows, 10, scale=1024) == brute(rows, 10, scale=1024)


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []


def test_boxes_bound_all_rows():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-300, 300, (1000, 7)).astype(float)
    anchors = rng.integers(-300, 300, (5, 7)).astype(float)
    tree = h.RTree(vectors, leaf=8, fan=4)
    assert sorted(tree.order.tolist()) == list(range(1000))
    exact = anchors @ tree.vectors.T
    span = tree.leaf
    for lower, upper in tree.intervals(anchors):
        for box in range(lower.shape[1]):
            inside = exact[:, box * span:(box + 1) * span]
            assert (lower[:, [box]] <= inside).all() and (inside <= upper[:, [box]]).all()
        span *= tree.fan
    assert lower.shape[1] == 1


def test_search_skips_boxes():
    """On clustered rows more than half of the leaves are never scored."""
    rng = np.random.default_rng(2)
    centers = rng.integers(-1000, 1000, (40, 3))
    vectors = (centers.repeat(100, 0) + rng.integers(-5, 5, (4000, 3))).astype(float)
    tree = h.RTree(vectors, leaf=32)
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, rows):
            seen.append(rows)
            return super().__getitem__(rows)

    tree.vectors = tree.vectors.view(Counted)
    anchor = np.array([3.0, -2.0, 1.0])
    ends = [(lo[0], hi[0]) for lo, hi in tree.intervals(anchor[None])]
    found, = h.search(tree, tree.order, np.ones(4000, bool), anchor, ends, [(-math.inf, math.inf)], 5)
    scores = vectors @ anchor
    assert found == sorted((-int(s), i) for i, s in enumerate(scores))[:5]
    assert len(seen) < len(vectors) / tree.leaf / 2
