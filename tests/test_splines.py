"""Splines against dense solves of their conditions."""

import numpy as np
import pytest

from pelagia.operators import splines


def dense_spline(x, y, at):
    """Interpolating spline with one cubic over the first two and the last two intervals: a dense system for all pieces' coefficients."""
    n = len(x) - 1
    rows, right = [], []

    def row(k, t, order, sign=1.0):
        out = np.zeros(4 * n)
        for p in range(order, 4):
            out[4 * k + p] = sign * np.prod(range(p - order + 1, p + 1)) * t ** (p - order)
        return out

    for k in range(n):
        rows += [row(k, 0.0, 0), row(k, x[k + 1] - x[k], 0)]
        right += [y[k], y[k + 1]]
    for k in range(n - 1):
        for order in (1, 2):
            rows.append(row(k, x[k + 1] - x[k], order) - row(k + 1, 0.0, order))
            right.append(0.0)
    for k in (0, n - 2):
        rows.append(row(k, 0.0, 3) - row(k + 1, 0.0, 3))
        right.append(0.0)
    c = np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0].reshape(n, 4)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 1)
    t = at - x[k]
    return sum(c[k, p] * t**p for p in range(4))


@pytest.mark.parametrize("n", [4, 5, 9])
def test_slopes_are_those_of_a_dense_solve(n):
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.uniform(0.5, 2, n))
    y = rng.normal(size=n)
    got = splines.line_slopes(x, y[None])[0]
    for k in range(n):
        d = 1e-5
        inner = dense_spline(x, y, np.array([x[k] - d, x[k] + d]))
        assert abs(got[k] - (inner[1] - inner[0]) / (2 * d)) < 1e-5
    line = 3 * x + 1
    for m in (1, 2, 3, n):
        assert np.allclose(splines.line_slopes(x[:m], line[None, :m]), 3.0 if m > 1 else 0.0)
    assert np.allclose(splines.line_slopes(x[:3], x[None, :3] ** 2), 2 * x[:3])


def test_blocks_of_a_long_line_equal_the_whole(spark, monkeypatch):
    monkeypatch.setattr(splines, "BLOCK", 100)
    monkeypatch.setattr(splines, "LINES", 2)
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.uniform(0.2, 3, 530))
    values = rng.normal(size=(5, 530))
    df = spark.createDataFrame([(k, line, float(x[k]), float(values[line, k]) if (k, line) != (7, 3) else None) for k in range(530) for line in range(5)], "i int, j int, x double, v double")
    values[3, 7] = 0.0
    got = splines.slopes(df, "v", "s").toPandas().sort_values(["j", "i"]).s.to_numpy().reshape(5, 530)
    assert np.abs(got - splines.line_slopes(x, values)).max() < 1e-12


def test_surface_at_points(spark):
    rng = np.random.default_rng(2)
    x, y = np.cumsum(rng.uniform(0.5, 2, 9)), np.cumsum(rng.uniform(0.5, 2, 7))
    z = rng.normal(size=(9, 7))
    grid = spark.createDataFrame([(i, j, float(x[i]), float(y[j]), float(z[i, j])) for i in range(9) for j in range(7)], "i int, j int, x double, y double, z double")
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(x[0], x[-1], 40), rng.uniform(y[0], y[-1], 40), strict=True))]
    points += [(100, float(x[0]), float(y[-1])), (101, float(x[-1]) + 5, float(y[3])), (102, None, 1.0), (103, float(x[4]), float(y[2]))]
    got = {r["id"]: r["z"] for r in splines.spline_at(spark.createDataFrame(points, "id long, x double, y double"), grid, "z").collect()}
    assert 102 not in got and abs(got[100] - z[0, 6]) < 1e-12 and abs(got[101] - z[8, 3]) < 1e-12 and abs(got[103] - z[4, 2]) < 1e-12
    for k, a, b in points[:40]:
        along = np.array([dense_spline(y, z[i], np.array([b]))[0] for i in range(9)])
        assert abs(got[k] - dense_spline(x, along, np.array([a]))[0]) < 1e-9


def test_mean_sea_level(spark):
    grid = spark.createDataFrame([(i, j, i * 10.0, -20 + j * 10.0, 1.0 + i if i != 3 else None) for i in range(37) for j in range(5)], "i int, j int, lon double, lat double, ssh double")
    points = spark.createDataFrame([(1, -10.0, 0.0), (2, 370.0, 0.0), (3, 0.0, 0.0), (4, 30.0, 10.0), (5, 200.0, 0.0)], "id long, lon double, lat double")
    got = {r["id"]: round(r["ssh"], 6) for r in splines.mean_sea_level(points, grid).collect()}
    assert got == {1: 36.0, 2: 2.0, 3: 0.0, 4: 0.0, 5: 21.0}
