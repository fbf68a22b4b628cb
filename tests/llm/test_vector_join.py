import math

import numpy as np
import pytest

from chainlake.llm import vector_join as v


def brute(rows, threshold):
    def ok(x):
        return x is not None and len(x) > 0 and all(c is not None and math.isfinite(c) for c in x) and any(x)
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(n):
        for b in range(n):
            (_, x, lx), (_, y, ly) = rows[a], rows[b]
            if a != b and lx is not None and lx == ly and ok(x) and ok(y) and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= threshold:
                    links[a] += 1
                    root[find(a)] = find(b)
    least = {}
    for a in range(n):
        if rows[a][0] is not None:
            least[find(a)] = min(least.get(find(a), rows[a][0]), rows[a][0])
    return sorted(((rows[a][0], links[a], least.get(find(a)), rows[a][0] is not None and rows[a][0] == least.get(find(a)))
                   for a in range(n)), key=str)


def run(spark, rows, threshold):
    df = spark.createDataFrame([(i, x, y, "c") for i, x, y in rows],
                               "vec_id long, embedding array<double>, label int, component_id string").repartition(3)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in v.near_vectors(df, threshold).collect()), key=str)


@pytest.mark.parametrize("cell, block", [(4096, 1024), (10, 8)])
@pytest.mark.parametrize("dim", [3, 24])
def test_equals_brute_force(spark, monkeypatch, cell, block, dim):
    """Small cells and blocks force many pivots, replication and split cells."""
    monkeypatch.setattr(v, "CELL", cell)
    monkeypatch.setattr(v, "BLOCK", block)
    rng = np.random.default_rng(dim)
    rows = []
    for i in range(150):
        if i % 3 and rows:
            x = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=dim) * rng.choice([0, 0.02, 0.06])
            x = x * rng.choice([1, 1, 3])
        else:
            x = rng.normal(size=dim)
        rows.append((i, x.tolist(), int(rng.integers(2))))
    rows += [(200, None, 1), (201, [0.0] * dim, 1), (202, [math.nan] * dim, 1), (203, [math.inf] + [1.0] * (dim - 1), 1),
             (204, rows[0][1], None), (205, rows[0][1], rows[0][2]), (205, rows[0][1], rows[0][2]), (None, rows[0][1], rows[0][2]),
             (206, [], 1), (207, [1.0], 1), (208, [2.0], 1), (209, [None] * dim, 1), (None, None, None)]
    assert run(spark, rows, 0.98) == brute(rows, 0.98)


def test_hot_families_and_empty(spark):
    base = np.array([1.0, 2.0, 3.0, 4.0])
    rows = [(i, base.tolist(), 0) for i in range(300)]
    rows += [(1000 + i, (base + 1e-4 * np.eye(4)[i % 4] * i).tolist(), 0) for i in range(100)]
    assert run(spark, rows, 0.98) == brute(rows, 0.98)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert v.near_vectors(empty).count() == 0


def test_cells_follow_the_number_of_vectors(spark, monkeypatch):
    """Four pivots a split: cells are split again until they are small, every link is kept, and one family stays whole."""
    monkeypatch.setattr(v, "CELL", 12)
    monkeypatch.setattr(v, "PIVOTS", 4)
    rng = np.random.default_rng(5)
    spread = rng.normal(size=(220, 3))
    family = np.array([0.0, 0.0, 1.0]) + rng.normal(size=(40, 3)) * 0.002
    rows = [(i, x.tolist(), 1) for i, x in enumerate(np.vstack((spread, family)))]
    assert run(spark, rows, 0.99) == brute(rows, 0.99)
    classes = spark.createDataFrame([(x, 1, 3, i, 1) for i, x, _ in rows], "vec array<double>, label int, dim int, node long, copies long")
    radius = math.sqrt(0.02)
    cells = v._cells(classes, radius).toPandas()
    size = cells.groupby("cell").size()
    depth = size.index.str.count("/")
    assert depth.max() >= 3 and len(size) > 2 * v.PIVOTS
    owned = cells[cells.owns == 2 ** cells.cell.str.count("/") - 1]
    assert sorted(owned.node) == list(range(260))  # each vector is at home in one cell
    assert size.max() < 130 and size.max() >= 40  # the family cannot be split
