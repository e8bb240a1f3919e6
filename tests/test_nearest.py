"""Nearest neighbours among points of very uneven density."""

import numpy as np
import pytest

from pelagia.functions.geo import haversine
from pelagia.operators import nearest


def uneven(n, seed=0):
    """90 % of the points in a ten-thousandth of the extent, a few very far, many at one place, some on a line."""
    rng = np.random.default_rng(seed)
    dense = rng.normal(0, 0.005, (int(n * 0.9), 2))
    thin = rng.uniform(-100, 100, (n - len(dense) - 60, 2))
    return np.concatenate([dense, thin, [[1e4, -1e4]] * 3, [[50.0, 50.0]] * 37, [[float(x), 70.0] for x in range(20)]])


@pytest.mark.parametrize("k", [1, 5])
def test_uneven_points_and_far_queries(spark, k):
    points = uneven(20_000)
    rng = np.random.default_rng(9)
    asked = np.concatenate([rng.uniform(-150, 150, (60, 2)), rng.normal(0, 0.01, (60, 2)), points[::2500], [[3e5, 3e5], [-2e4, 0.0], [50.0, 50.0], [9.5, 70.0]]])
    p = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(points)], "p long, x double, y double")
    q = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(asked)], "q long, x double, y double")
    got = {}
    for r in nearest.k_nearest(q, p, k).collect():
        got.setdefault(r["q"], []).append((r["d2"], r["p"]))
    for n, (x, y) in enumerate(asked):
        d2 = (points[:, 0] - x) * (points[:, 0] - x) + (points[:, 1] - y) * (points[:, 1] - y)
        want = sorted(zip(d2.tolist(), range(len(points)), strict=True))[:k]
        assert sorted(got[n]) == want


def test_few_leaves_are_met_by_each_query(spark):
    points = uneven(40_000, 3)
    asked = np.concatenate([points[::400] + 1e-4, np.random.default_rng(2).uniform(-1000, 1000, (100, 2))])
    p = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(points)], "p long, px double, py double")
    tree, levels = nearest._tree(p)
    counts = [level.count() for level, _ in levels]
    assert counts[0] <= 16 and counts[-1] >= 40_000 / 64 and tree.count() == len(points)
    assert all(n <= most for n, (_, most) in zip(counts, levels, strict=True))
    q = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(asked)], "q long, x double, y double")
    plan = nearest.k_nearest(q, p.withColumnsRenamed({"px": "x", "py": "y"}), 1)
    assert plan.count() == len(asked)
    # walked by hand: leaves that are left for each query
    leaves = levels[-1][0].toPandas()
    met = 0
    for x, y in asked:
        near = np.maximum(np.maximum(leaves.x1 - x, x - leaves.x2), 0) ** 2 + np.maximum(np.maximum(leaves.y1 - y, y - leaves.y2), 0) ** 2
        far_x, far_y = (np.maximum(abs(leaves[f"{c}1"] - v), abs(leaves[f"{c}2"] - v)) for c, v in (("x", x), ("y", y)))
        side_x, side_y = (np.minimum(abs(leaves[f"{c}1"] - v), abs(leaves[f"{c}2"] - v)) for c, v in (("x", x), ("y", y)))
        met += (near <= np.minimum(far_x**2 + side_y**2, side_x**2 + far_y**2).min()).sum()
    assert met < 12 * len(asked)


def test_fewer_points_than_asked_for(spark):
    p = spark.createDataFrame([(2, 0.0, 0.0), (1, 0.0, 0.0), (3, None, 1.0)], "p long, x double, y double")
    q = spark.createDataFrame([(1, 1.0, 0.0), (2, None, 0.0), (3, float("nan"), 0.0), (4, 1.0, 0.0)], "q long, x double, y double")
    assert sorted(tuple(r) for r in nearest.k_nearest(q, p, 3).collect()) == [(1, 1, 1.0, 1), (1, 2, 1.0, 2), (4, 1, 1.0, 1), (4, 2, 1.0, 2)]
    assert nearest.k_nearest(q.limit(0), p, 2).count() == 0 and nearest.nearest(q, p.limit(0)).count() == 0


def test_pairs_of_a_full_bin_are_shared_by_tasks(spark, monkeypatch):
    # all rows about a pole are in one bin; some places have many rows
    monkeypatch.setattr(nearest, "BLOCK_PAIRS", 500)
    monkeypatch.setattr(nearest, "PLACE_ROWS", 4)
    rows = spark.range(300).selectExpr("id", "cast(id * 7 % 90 * 4 as double) x", "89.0 - id * 7 % 90 % 5 y")
    a, b = rows.selectExpr("id a", "x ax", "y ay"), rows.selectExpr("id b", "x bx", "y by")
    d = haversine("ay", "ax", "by", "bx")
    found = nearest.pairs_within(a, b, d, 300.0)
    want = a.crossJoin(b).where(d <= 300.0).select("a", "b")
    assert found.columns == ["a", "ax", "ay", "b", "bx", "by", "distance"]
    assert sorted(tuple(r) for r in found.select("a", "b").collect()) == sorted(tuple(r) for r in want.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__block" in plan and plan.count("__blocks") > 1


def test_tasks_grow_with_pairs_not_with_bytes(spark, monkeypatch):
    # few bytes and many pairs: partitions merged by their bytes would leave a task or two
    monkeypatch.setattr(nearest, "BLOCK_PAIRS", 2000)
    rows = spark.range(400).selectExpr("id", "cast(id % 20 as double) x", "cast(id % 20 as double) y")
    a, b = rows.selectExpr("id a", "x ax", "y ay"), rows.selectExpr("id b", "x bx", "y by")
    d = haversine("ay", "ax", "by", "bx")
    found = nearest.pairs_within(a, b, d, 400.0)
    assert found.rdd.getNumPartitions() >= 20
    want = a.crossJoin(b).where(d <= 400.0).select("a", "b")
    assert sorted(tuple(r) for r in found.select("a", "b").collect()) == sorted(tuple(r) for r in want.collect())


def test_pairs_of_nothing(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "a long, ax double, ay double")
    b = a.selectExpr("a b", "ax bx", "ay by")
    d = haversine("ay", "ax", "by", "bx")
    assert nearest.pairs_within(a.limit(0), b, d, 400.0).count() == nearest.pairs_within(a, b.limit(0), d, 400.0).count() == 0
    assert nearest.pairs_within(a, b, d, 400.0).count() == 1
