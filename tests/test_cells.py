"""Overlaps of convex cells: sums of areas, poles and date line, sizes far apart, linear fields, corner cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.operators import cells

SCHEMA = "id long, corners array<struct<lon:double,lat:double>>"


def lat_lon(nx, ny, turn=0.0, bend=0.0):
    """Cells of the whole sphere; ``bend`` makes rows wavy, but for those at the poles."""
    def lat(i, j):
        y = -90 + 180 * j / ny
        return y + (bend * math.sin(2 * math.pi * (i % nx) / nx) if 0 < j < ny else 0.0)

    ring = lambda i, j: [(turn + 360 * a / nx, lat(a, b)) for a, b in ((i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1))]
    return [(j * nx + i, ring(i, j)) for j in range(ny) for i in range(nx)]


def octahedron(levels, shift=0.3):
    """Triangles over the whole sphere, turned so that no corner is at a pole; ids from 0."""
    a, b = math.cos(shift), math.sin(shift)
    turn = np.array([[1, 0, 0], [0, a, -b], [0, b, a]]) @ np.array([[a, 0, b], [0, 1, 0], [-b, 0, a]])
    faces = [[np.array([x, 0.0, 0]), np.array([0, y, 0.0]), np.array([0.0, 0, z])] for x in (1, -1) for y in (1, -1) for z in (1, -1)]
    for _ in range(levels):
        new = []
        for p, q, r in faces:
            pq, qr, rp = (x / np.linalg.norm(x) for x in (p + q, q + r, r + p))
            new += [[p, pq, rp], [pq, q, qr], [rp, qr, r], [pq, qr, rp]]
        faces = new
    place = lambda v: (math.degrees(math.atan2(v[1], v[0])), math.degrees(math.asin(max(-1.0, min(1.0, v[2])))))
    return [(k, [place(turn @ v) for v in f]) for k, f in enumerate(faces)]


def frame(spark, rows):
    return spark.createDataFrame([(k, corners and [(float(x), float(y)) for x, y in corners]) for k, corners in rows], SCHEMA)


def test_overlaps_of_a_mesh_and_a_curvilinear_grid_fill_the_sphere(spark):
    source, target = frame(spark, octahedron(3)), frame(spark, lat_lon(18, 9, turn=5.0, bend=4.0))
    links = cells.overlap_links(source, target).toPandas()
    area = cells.areas(target).toPandas().set_index("id").area
    assert abs(area.sum() - 4 * math.pi) < 1e-10
    assert np.abs(links.groupby("dst").w1.sum() - 1).max() < 1e-10 and links.dst.nunique() == 162
    # each source cell is shared out whole, and its moments about its own centre cancel
    links["a"], links["m2"], links["m3"] = (links[c] * links.dst.map(area) for c in ("w1", "w2", "w3"))
    own = cells.areas(source).toPandas().set_index("id").area
    sums = links.groupby("src")[["a", "m2", "m3"]].sum()
    assert np.abs(sums.a / own - 1).max() < 1e-9 and np.abs(sums[["m2", "m3"]]).max().max() < 1e-10
    # frac: a source that covers half of the sphere
    half = cells.overlap_links(source.where("id < 256"), target, normalise="frac").toPandas()
    assert np.abs(half.groupby("dst").w1.sum() - 1).max() < 1e-12


def test_areas_of_known_cells(spark):
    rows = [(1, [(0, 0), (90, 0), (0, 90)]), (2, [(0, 90), (90, 0), (0, 0)]), (3, [(170, 0), (190, 0), (190, 90), (170, 90)]), (4, [(0, 0), (1, 0)]), (5, [(0, 0), (0, 0), (1, 0)]), (6, None)]
    got = {r["id"]: r["area"] for r in cells.areas(frame(spark, rows)).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for k, want in {1: math.pi / 2, 2: math.pi / 2, 3: math.radians(20), 4: 0.0, 5: 0.0}.items():
        assert abs(got[k] - want) < 1e-12


def test_one_cell_over_many_small_ones(spark):
    """A coarse cell over the pole and the date line, small cells under it and far from it, and a source with nothing in common."""
    big = frame(spark, [(1, [(150, 60), (240, 60), (330, 60), (60, 60)]), (2, [(10, -50), (20, -50), (20, -40), (10, -40)]), (None, [(0, 0), (1, 0), (1, 1)])])
    small = frame(spark, lat_lon(90, 45))
    links = cells.overlap_links(small, big).toPandas()
    assert np.abs(links.groupby("dst").w1.sum() - 1).max() < 1e-10 and set(links.dst) == {1, 2}
    back = cells.overlap_links(big, small).toPandas()
    assert len(back) == len(links)
    area = cells.areas(small).toPandas().set_index("id").area
    own = cells.areas(big).toPandas().set_index("id").area
    assert abs((back[back.src == 1].w1 * back[back.src == 1].dst.map(area)).sum() - own[1]) < 1e-10
    empty = cells.overlap_links(big, frame(spark, []))
    assert empty.count() == 0 and cells.overlap_links(frame(spark, []), big).count() == 0
    with pytest.raises(ValueError, match="normalisation"):
        cells.overlap_links(big, small, normalise="none")


def test_second_order_is_exact_for_linear_fields_in_the_plane_and_conserves(spark):
    quads = [(10 * j + i, [(i + 0.1 * j, j), (i + 1 + 0.1 * j, j), (i + 1.1 + 0.1 * j, j + 1), (i + 0.1 + 0.1 * j, j + 1)]) for j in range(10) for i in range(10)]
    source = frame(spark, quads)
    rng = np.random.default_rng(3)
    target = frame(spark, [(k, [(x, y), (x + 1.5, y + 0.2), (x + 0.4, y + 1.3)]) for k, (x, y) in enumerate(rng.uniform(2.5, 6, (20, 2)))])
    centre = cells.areas(source, sphere=False)
    values = centre.select("id", (3 * F.col("cx") - 2 * F.col("cy") + 1).alias("v"), F.lit(None).cast("double").alias("w"))
    near = cells.edge_neighbours(source)
    assert near.where("id = 0").count() == 2 and near.where("id = 55").count() == 4
    inside = cells.gradients(values.join(centre, "id").select("id", F.col("cx").alias("x"), F.col("cy").alias("y"), "v", "w"), near, ["v", "w"]).where("id = 55").first()
    assert abs(inside["v_x"] - 3) < 1e-9 and abs(inside["v_y"] + 2) < 1e-9 and inside["w_x"] == 0
    got = cells.remap(source, values, target, ["v"], order=2, sphere=False).join(cells.areas(target, sphere=False).withColumnRenamed("id", "dst"), "dst").collect()
    assert len(got) == 20 and all(abs(r["v"] - (3 * r["cx"] - 2 * r["cy"] + 1)) < 1e-9 for r in got)
    second = {r["dst"]: r["v"] for r in got}
    first = {r["dst"]: r["v"] for r in cells.remap(source, values, target, ["v"], sphere=False).collect()}
    assert max(abs(first[k] - second[k]) for k in second) > 1e-3


def test_second_order_on_the_sphere(spark):
    source, target = frame(spark, lat_lon(36, 18)), frame(spark, octahedron(2))
    at = cells.areas(source)
    values = at.select("id", (F.col("cx") + 2 * F.col("cz")).alias("v"), "area")
    error = {}
    for order in (1, 2):
        got = cells.remap(source, values, target, ["v"], order=order).join(cells.areas(target).withColumnRenamed("id", "dst"), "dst").toPandas()
        assert abs((got.v * got.area).sum() - values.agg(F.sum(F.col("v") * F.col("area"))).first()[0]) < 1e-9
        error[order] = (got.v - got.cx - 2 * got.cz).abs().max()
    assert error[2] < error[1] / 3


def test_limited_gradients_make_no_new_extremes(spark):
    rows = [(10 * j + i, float(i), float(j), 1.0 if i > 4 else 0.0) for j in range(10) for i in range(10)]
    values = spark.createDataFrame(rows, "id long, x double, y double, v double")
    near = spark.createDataFrame([(10 * j + i, 10 * (j + b) + i + a) for j in range(10) for i in range(10) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= i + a < 10 and 0 <= j + b < 10], "id long, other long")
    for r in cells.gradients(values, near, ["v"]).collect():
        for side in (-0.5, 0.5):
            assert -1e-12 <= r["v"] + side * r["v_x"] <= 1 + 1e-12
    assert max(abs(r["v_x"]) for r in cells.gradients(values, near, ["v"], limited=False).collect()) == 0.5


def test_cells_of_meshes_and_grids(spark):
    nodes = spark.createDataFrame([(k, float(k % 3), float(k // 3)) for k in range(9)], "node long, x double, y double")
    elements = spark.createDataFrame([(7, 0, 1, 4), (8, 0, 4, 3)], "elem long, n1 long, n2 long, n3 long")
    got = {r["id"]: [(c["x"], c["y"]) for c in r["corners"]] for r in cells.of_mesh(nodes, elements).collect()}
    assert got == {7: [(0, 0), (1, 0), (1, 1)], 8: [(0, 0), (1, 1), (0, 1)]}
    wide = spark.createDataFrame([(1, 0.0, math.pi / 2, 0.0, 0.0, 0.0, math.pi / 2)], "k long, x1 double, x2 double, x3 double, y1 double, y2 double, y3 double")
    assert abs(cells.areas(cells.of_corner_columns(wide, "k", ["x1", "x2", "x3"], ["y1", "y2", "y3"], radians=True)).first()["area"] - math.pi / 2) < 1e-12
    grid = spark.createDataFrame([(2, 1, [(0.0, 0.0)] * 4)], "i int, j int, corners array<struct<lon:double,lat:double>>")
    assert cells.structured(grid, 10).first()["id"] == 12
    with pytest.raises(Exception, match="four corners"):
        cells.structured(grid.withColumn("corners", F.slice("corners", 1, 3)), 10).collect()


def test_cells_beyond_the_targets_are_left_out(spark, monkeypatch):
    square = lambda k, x, y, n=1.0: (k, [(x, y), (x + n, y), (x + n, y + n), (x, y + n)])
    kind = "id long, corners array<struct<x:double,y:double>>"
    far = spark.createDataFrame([square(100 * i + j, float(i), float(j)) for i in range(30) for j in range(30)], kind)
    values = far.select("id", (F.floor(F.col("id") / 100) * 2.0 + F.col("id") % 100 * F.col("id") % 100).alias("v"))
    target = spark.createDataFrame([square(0, 10.25, 20.5, 0.5), square(1, 12.5, 21.5, 1.0), square(2, -5.0, -5.0, 1.0)], kind).where("id < 2")
    seen = []
    staged = cells.staged
    monkeypatch.setattr(cells, "staged", lambda df, name: seen.append((name, out := staged(df, name))) or out)
    got = {r["dst"]: r["v"] for r in cells.remap(far, values, target, ["v"], order=2, sphere=False).collect()}
    near = far.where("id between 800 and 1500 and id % 100 between 17 and 25")
    want = {r["dst"]: r["v"] for r in cells.remap(near, values, target, ["v"], order=2, sphere=False).collect()}
    assert got == pytest.approx(want) and all(v > 0 for v in got.values())
    sizes = [df.count() for name, df in seen if name in ("sources", "pieces")]
    assert max(sizes) < 60  # of 900 cells
