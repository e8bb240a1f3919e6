"""Functions that no query exercises."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.functions import geo, physics
from pelagia.grids import Grid
from pelagia.operators import linear, remap, stencils
from pelagia.operators.eddies import Limits
from pelagia.sources import fields, storms


def vector(spark, values):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "idx long, value double")


def numbers(df):
    return [r["value"] for r in df.orderBy("idx").collect()]


def test_cell_corners_of_a_cyclic_grid(spark):
    df = spark.createDataFrame([(i, j, 90.0 * i, 30.0 * j) for i in range(4) for j in range(2)], "i int, j int, lon double, lat double")
    got = {(r["i"], r["j"]): [(c["lon"], c["lat"]) for c in r["corners"]] for r in remap.cell_corners(df, 4).collect()}
    assert got[1, 1] == [(0.0, 0.0), (90.0, 0.0), (90.0, 30.0), (0.0, 30.0)]
    assert [p[0] for p in got[0, 1]] == [270.0, 0.0, 0.0, 270.0]  # the first column's western corners are the last column's
    assert got[2, 0][0][1] == pytest.approx(-90) and got[2, 0][1] == (180.0, pytest.approx(-90)) and got[2, 0][2] == (180.0, 0.0)


def test_remap_between_grids(spark):
    source = Grid(spark.createDataFrame([(0, 1.0, 5.0), (1, 3.0, 7.0)], "i int, v double, w double"), ("i",))
    target = Grid(spark.createDataFrame([(0, 9.0), (1, 9.0), (2, 9.0)], "i int, v double"), ("i",))
    links = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 1, 0.5)], "src int, dst int, w1 double")
    for given in (links, lambda a, b: links):
        got = {r["i"]: (r["v"], r["w"]) for r in target.remap_from(source, given, ["v", "w"]).df.collect()}
        assert got == {0: (1.0, 5.0), 1: (2.0, 6.0), 2: (0.0, 0.0)}


def test_implicit_steps(spark):
    """dx/dt = -k x: one step of the theta method in closed form, and many steps near the exponential."""
    rates = {0: 1.0, 1: 2.0}
    rate = F.when(F.col("idx") == 0, 1.0).otherwise(2.0)
    rhs = lambda x: x.withColumn("value", -rate * F.col("value"))
    solve = lambda x, f, c: f.withColumn("value", F.col("value") / (1 + c * rate))
    x = vector(spark, [1.0, 4.0])
    for theta in (1.0, 0.5):
        got = numbers(linear.theta_step(rhs, solve, x, 0.2, theta))
        assert got == pytest.approx([v * (1 - (1 - theta) * 0.2 * k) / (1 + theta * 0.2 * k) for v, k in ((1.0, rates[0]), (4.0, rates[1]))])
    got = numbers(linear.time_stepper(rhs, solve, x, 0.1, 0.35, 0.5))
    assert got == pytest.approx([math.exp(-0.35), 4 * math.exp(-0.7)], rel=3e-3)


def test_newton_and_continuation(spark):
    """Roots of x^2 = p followed from p = 1 to 4."""
    rhs = lambda x, p: x.withColumn("value", F.col("value") * F.col("value") - p)
    by_p = lambda x, p: x.withColumn("value", F.lit(-1.0))
    def solve(x, p, f):
        return f.withColumnRenamed("value", "f").join(x, "idx").select("idx", (F.col("f") / (2 * F.col("value"))).alias("value"))
    root, size = linear.newton(lambda x: rhs(x, 2.0), lambda x, f: solve(x, 2.0, f), vector(spark, [1.0]))
    assert numbers(root) == pytest.approx([2**0.5]) and size < 1e-7
    x, p = linear.continuation(rhs, by_p, solve, vector(spark, [1.0]), 1.0, 4.0, 1.5)
    assert p == 4.0 and numbers(x) == pytest.approx([2.0])


def test_radius_table_and_masks(spark, tmp_path):
    (tmp_path / "r.txt").write_text("10.0 350.0 2.5 40.0\n10.0 20.0 2.5 41.0\n80.0 5.0 2 1\nnotes\n12 2 2.4 39\n")
    got = sorted((r["lat"], r["lon"], r["radius"]) for r in fields.radius_table(spark, str(tmp_path / "r.txt"), (-12.0, 5.0, 9.0, 13.0)).collect())
    assert got == [(10.0, -10.0, 40.0), (12.0, 2.0, 39.0)]
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, None)], "v double, m int")
    assert [r[0] for r in df.select(fields.masked(F.col("v"), F.col("m"))).collect()] == [1.0, None, None]


def test_small_formulas(spark):
    limits = Limits.for_grid(0.25)
    assert (limits.least_cells, limits.most_cells) == (round(math.pi * 1.6**2), round(math.pi * (4.461 / 0.25) ** 2))
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(physics.Waves.k_from_lambda(F.lit(10.0))) == pytest.approx(2 * math.pi / 10)
    assert value(physics.Waves().omega_from_phase_velocity(F.lit(5.0))) == pytest.approx(physics.GRAVITY / 5)
    with pytest.raises(ValueError, match="deep water"):
        physics.Waves(depth=10.0).omega_from_phase_velocity(F.lit(5.0))
    assert [value(geo.wrap_near(F.lit(x), F.lit(c))) for x, c in ((359.0, 0.0), (-170.0, 175.0), (10.0, 10.0))] == [-1.0, 190.0, 10.0]
    df = spark.createDataFrame([(3.0, 4.0)], "u double, v double")
    assert df.select(stencils.eddy_kinetic("u", "v")).first()[0] == 12.5
    line = spark.createDataFrame([(i, 0, float(i * i)) for i in range(4)], "i int, j int, v double")
    assert [r["c"] for r in stencils.to_centres(line, "v", "i", "c").orderBy("i").collect()] == [0.0, 0.5, 2.5, 6.5]
    t = spark.createDataFrame([("a", 5), ("a", 1), ("b", 2)], "track string, ts int")
    assert sorted(tuple(r) for r in storms.track_index(t).select("track", "ts", "seq").collect()) == [("a", 1, 0), ("a", 5, 1), ("b", 2, 0)]


def test_boxes_on_the_sphere(spark):
    """Boxes in degrees: shares of the destination's area, which goes with the sine of the latitude."""
    a = spark.createDataFrame([(1, 0.0, 90.0, 0.0, 90.0), (2, 90.0, 180.0, 0.0, 30.0)], "id int, x1 double, x2 double, y1 double, y2 double")
    b = spark.createDataFrame([(7, 0.0, 180.0, 0.0, 90.0)], "id int, x1 double, x2 double, y1 double, y2 double")
    got = {r["src"]: r["w1"] for r in remap.box_links(a, b, 60.0, spherical=True).collect()}
    assert got == {1: pytest.approx(0.5), 2: pytest.approx(0.25)}
    assert np.isclose(math.sin(math.radians(30)), 0.5)
