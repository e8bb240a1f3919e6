"""Interpolating cubic splines along grid lines, and their tensor products at any point.

A spline of a line is known by its slopes at the grid points, which solve a tridiagonal system. What a far point adds to a slope falls by more than
half a step, so a line is solved in blocks with ``HALO`` points of its neighbours on either side: equal to the whole line's solution to
the last digits, however long lines are. Bundles of lines are solved at once as arrays. Ends are those of the usual interpolating
spline (one cubic over the first two intervals, and over the last two).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a block, lines of a bundle, and points of the neighbours that a block sees on either side.
BLOCK, LINES, HALO = 1024, 64, 64


def line_slopes(x: np.ndarray, values: np.ndarray, cut: tuple[bool, bool] = (False, False)) -> np.ndarray:
    """Slopes at ``x`` of splines through lines of ``values`` (line, point). Where a line is ``cut`` off, the slope at that end is a guess that fades inside."""
    n = len(x)
    if n == 1:
        return np.zeros_like(values)
    h = np.diff(x)
    d = np.diff(values, axis=1) / h
    if n == 2:
        return np.repeat(d, 2, axis=1)
    if n == 3 and not any(cut):  # one parabola
        bend = (d[:, 1] - d[:, 0]) / (x[2] - x[0])
        return np.stack([d[:, 0] - bend * h[0], d[:, 0] + bend * h[0], d[:, 1] + bend * h[1]], axis=1)
    low, mid, high = np.zeros(n), np.ones(n), np.zeros(n)
    right = np.empty_like(values)
    low[1:-1], mid[1:-1], high[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    right[:, 1:-1] = 3 * (h[1:] * d[:, :-1] + h[:-1] * d[:, 1:])
    right[:, 0], right[:, -1] = d[:, 0], d[:, -1]
    if not cut[0]:
        wide = h[0] + h[1]
        mid[0], high[0] = h[1], wide
        right[:, 0] = ((h[0] + 2 * wide) * h[1] * d[:, 0] + h[0] ** 2 * d[:, 1]) / wide
    if not cut[1]:
        wide = h[-1] + h[-2]
        mid[-1], low[-1] = h[-2], wide
        right[:, -1] = ((h[-1] + 2 * wide) * h[-2] * d[:, -1] + h[-1] ** 2 * d[:, -2]) / wide
    for k in range(1, n):  # forward, for all lines at once
        w = low[k] / mid[k - 1]
        mid[k] -= w * high[k - 1]
        right[:, k] -= w * right[:, k - 1]
    out = np.empty_like(right)
    out[:, -1] = right[:, -1] / mid[-1]
    for k in range(n - 2, -1, -1):
        out[:, k] = (right[:, k] - high[k] * out[:, k + 1]) / mid[k]
    return out


def slopes(df: DataFrame, value: str, out: str, axis: str = "i", position: str = "x", across: str = "j", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``out``: the slopes of splines of ``value`` along ``axis`` over ``position``.

    ``df`` has a row for each (by..., ``axis``, ``across``), whole numbers from 0 without gaps along the axis; positions rise with ``axis`` and are the same on all lines. Null and
    missing values are 0.0, as the mean sea level of land is.
    """
    by = list(by)
    size = df.groupBy(*by).agg(F.max(axis).alias("__last"))
    rows = df.select(*by, F.col(axis).alias("__k"), F.col(across).alias("__line"), F.col(position).cast("double").alias("__x"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("__v"))
    rows = rows.join(F.broadcast(size), by) if by else rows.withColumn("__last", F.lit(size.first()[0]))
    near = F.sequence(F.floor((F.col("__k") - HALO) / BLOCK), F.floor((F.col("__k") + HALO) / BLOCK))
    rows = rows.withColumn("__block", F.explode(near)).where((F.col("__block") >= 0) & (F.col("__block") * BLOCK <= F.col("__last")))
    rows = rows.withColumn("__bundle", F.floor(F.col("__line") / LINES))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        block, last = int(part["__block"].iloc[0]), int(part["__last"].iloc[0])
        first = max(0, block * BLOCK - HALO)
        lines, line = np.unique(part["__line"].to_numpy(), return_inverse=True)
        at = part["__k"].to_numpy() - first
        x = np.full(min(last, block * BLOCK + BLOCK - 1 + HALO) - first + 1, np.nan)
        x[at] = part["__x"].to_numpy()
        values = np.zeros((len(lines), len(x)))
        values[line, at] = part["__v"].to_numpy()
        known = ~np.isnan(x)
        found = np.full(values.shape, np.nan)
        found[:, known] = line_slopes(x[known], values[:, known], (first > 0, first + len(x) - 1 < last))
        mine = (part["__k"] // BLOCK == block).to_numpy()
        return pd.DataFrame({**{c: part[c][mine] for c in by}, "__k": part["__k"][mine], "__line": part["__line"][mine], "__out": found[line, at][mine]})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"__k {kinds['__k']}", f"__line {kinds['__line']}", "__out double"])
    solved = rows.groupBy(*by, "__bundle", "__block").applyInPandas(solve, schema)
    solved = solved.select(*by, F.col("__k").alias(axis), F.col("__line").alias(across), F.col("__out").alias(out))
    return df.join(solved, [*by, axis, across])


def surface(grid: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """A grid (i, j, x, y, value) with ``fx``, ``fy`` and ``fxy``, from which its bicubic spline follows."""
    grid = grid.withColumn("f", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    grid = slopes(grid, "f", "fx", "i", "x", "j", by)
    grid = slopes(grid, "f", "fy", "j", "y", "i", by)
    return slopes(grid, "fy", "fxy", "i", "x", "j", by)


def _intervals(grid: DataFrame, index: str, position: str) -> DataFrame:
    """Rows (index, from, to) of an axis; as many as it is long."""
    axis = grid.select(F.col(index).alias("k"), F.col(position).alias("a")).distinct()
    ahead = axis.select((F.col("k") - 1).alias("k"), F.col("a").alias("b"))
    return axis.join(ahead, "k")


def _placed(points: DataFrame, grid: DataFrame, index: str, position: str, name: str) -> DataFrame:
    """Points with the interval of an axis that holds them (``name``_k, its beginning and its width); those outside are moved to the axis's end."""
    axis = _intervals(grid, index, position)
    low, high, n = axis.agg(F.min("a"), F.max("b"), F.count("*")).first()
    if not n:
        return points.where("false").select("*", *[F.lit(None).cast(t).alias(f"{name}_{c}") for c, t in (("k", "long"), ("a", "double"), ("h", "double"))])
    step = (high - low) / n
    bin_of = lambda c: F.floor((c - low) / step)
    bins = axis.withColumn("bin", F.explode(F.sequence(bin_of(F.col("a")), bin_of(F.col("b")))))
    inside = points.withColumn(name, F.greatest(F.lit(low), F.least(F.lit(high), F.col(name)))).withColumn("bin", bin_of(F.col(name)))
    met = inside.join(bins, "bin").where((F.col(name) >= F.col("a")) & ((F.col(name) < F.col("b")) | ((F.col("b") == high) & (F.col(name) == high))))
    return met.select(*points.columns, F.col("k").cast("long").alias(f"{name}_k"), F.col("a").alias(f"{name}_a"), (F.col("b") - F.col("a")).alias(f"{name}_h"))


def spline_at(points: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """Rows (id, value) of the bicubic spline of a grid (i, j, x, y, value) at points (id, x, y); points outside take the nearest edge's value, null positions give no row."""
    at = _placed(_placed(points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null"), grid, "i", "x", "x"), grid, "j", "y", "y")
    u, v = ((F.col(c) - F.col(f"{c}_a")) / F.col(f"{c}_h") for c in "xy")
    ends = lambda t: [(1 - 3 * t * t + 2 * t * t * t, t - 2 * t * t + t * t * t), (3 * t * t - 2 * t * t * t, t * t * t - t * t)]
    corners: list[Column] = []
    for a, (hu, ku) in enumerate(ends(u)):
        for b, (hv, kv) in enumerate(ends(v)):
            weights = {"wf": hu * hv, "wx": ku * F.col("x_h") * hv, "wy": hu * kv * F.col("y_h"), "wxy": ku * F.col("x_h") * kv * F.col("y_h")}
            corners.append(F.struct((F.col("x_k") + a).alias("i"), (F.col("y_k") + b).alias("j"), *[w.alias(c) for c, w in weights.items()]))
    rows = at.select("id", F.explode(F.array(*corners)).alias("c")).select("id", "c.*")
    known = surface(grid, value).select("i", "j", "f", "fx", "fy", "fxy")
    part = F.col("wf") * F.col("f") + F.col("wx") * F.col("fx") + F.col("wy") * F.col("fy") + F.col("wxy") * F.col("fxy")
    return rows.join(known, ["i", "j"]).groupBy("id").agg(F.sum(part).alias(value))


def mean_sea_level(points: DataFrame, grid: DataFrame, value: str = "ssh") -> DataFrame:
    """Rows (id, value) of a mean sea level (i, j, lon, lat from 0 to 360, value; null is land and 0.0) at points (id, lon, lat), longitudes turned into the grid's; 0.0 at 0 E 0 N, which stands for no position."""
    turn = F.when(F.col("lon") < 0, F.col("lon") + 360.0).when(F.col("lon") > 360, F.col("lon") - 360.0).otherwise(F.col("lon"))
    found = spline_at(points.select("id", turn.alias("x"), F.col("lat").alias("y")), grid.withColumnsRenamed({"lon": "x", "lat": "y"}), value)
    nowhere = points.where("lon = 0 and lat = 0").select("id", F.lit(True).alias("nowhere"))
    return found.join(nowhere, "id", "left").select("id", F.when(F.col("nowhere"), 0.0).otherwise(F.col(value)).alias(value))
