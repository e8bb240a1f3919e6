"""Heights, boundaries, link numbers and altimetry files."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_arrays import netcdf

from pelagia import units
from pelagia.operators import channels, projections, remap, stencils
from pelagia.sources import fields


def test_profiles_on_other_heights(spark):
    rows = [(c, float(z), float(c + z * z), 1.0) for c in (1, 2) for z in (0, 2, 4)]
    p = spark.createDataFrame(rows, "column int, height double, t double, q double")
    got = {(r["column"], r["height"]): r["t"] for r in channels.on_levels(p, [-1.0, 1.0, 3.0, 9.0], ["t", "q"]).collect()}
    assert got == {(c, z): c + v for c in (1, 2) for z, v in ((-1.0, 0.0), (1.0, 2.0), (3.0, 10.0), (9.0, 16.0))}
    nearest = lambda name, x, xp, yp: yp[np.abs(x[:, None] - xp).argmin(axis=1)]
    got = {(r["column"], r["height"]): r["t"] for r in channels.on_levels(p, [0.5, 3.5], ["t"], interpolator=nearest).collect()}
    assert got == {(c, z): c + v for c in (1, 2) for z, v in ((0.5, 0.0), (3.5, 16.0))}
    with pytest.raises(ValueError, match="rise"):
        channels.on_levels(p, [1.0, 1.0], ["t"])


def test_boundaries_are_made_by_their_updaters(spark):
    b = spark.createDataFrame([("west", 0, 1.0), ("east", 0, 2.0), (None, 0, 3.0)], "side string, j int, psi double")
    twice = lambda df: df.withColumn("psi", F.col("psi") * 2)
    got = {r["side"]: r["psi"] for r in channels.update_sides(b, {"west": "interface", "east": "free_slip"}, {"west": twice}).collect()}
    assert got == {"west": 2.0, "east": 2.0, None: 3.0}
    with pytest.raises(KeyError, match="east"):
        channels.update_sides(b, {"east": "interface"}, {"west": twice})
    assert channels.update_sides(b, {}, {}).count() == 3


def test_links_are_numbered_in_order(spark):
    rows = [(k % 7, k % 5, float(k)) for k in range(200)]
    got = remap.numbered(spark.createDataFrame(rows, "src int, dst int, w1 double").repartition(6)).collect()
    assert [(r["dst"], r["src"], r["w1"]) for r in sorted(got, key=lambda r: r["link"])] == sorted((d, s, w) for s, d, w in rows)
    assert sorted(r["link"] for r in got) == list(range(200))


def test_boxes_and_waves(spark):
    assert stencils.sigma_of(20.0, 0.25) == 10.0
    empty = spark.createDataFrame([], "i int, j int, lon double, lat double")
    assert projections.in_box(empty, (0.0, 1.0, 0.0, 1.0)).count() == 0
    grid = spark.createDataFrame([(i, j, i * 2.0, j * 2.0) for i in range(6) for j in range(6)], "i int, j int, lon double, lat double")
    assert tuple(projections.box_indices(grid, (2.9, 7.1, 1.0, 9.0)).first()) == (1, 4, 0, 4)  # of two equally near rows the first
    assert projections.in_box(grid, (2.9, 7.1, 1.0, 9.0), 1).count() == 6 * 6


def test_altimetry_of_both_layouts(spark, tmp_path):
    lon, lat = np.arange(0, 360, 60.0), np.array([-30.0, 0.0, 30.0])
    sla = np.arange(18).reshape(1, 3, 6) / 100
    sla[0, 1, 2] = -9.0
    netcdf(tmp_path / "new.nc", {"time": 1, "lat": 3, "lon": 6}, [("sla", ["time", "lat", "lon"], ">f8", [("_FillValue", -9.0), ("units", "m")], sla), ("lon", ["lon"], ">f8", [], lon), ("lat", ["lat"], ">f8", [], lat)])
    old = (sla[0] * 100).T.copy()
    old[2, 1] = 1e30
    netcdf(tmp_path / "old.nc", {"NbLongitudes": 6, "NbLatitudes": 3}, [("Grid_0001", ["NbLongitudes", "NbLatitudes"], ">f8", [("_FillValue", 1e30)], old), ("NbLongitudes", ["NbLongitudes"], ">f8", [], lon), ("NbLatitudes", ["NbLatitudes"], ">f8", [], lat)])
    df = fields.read_sea_level(spark, str(tmp_path))
    assert units.unit_of(df, "sla") == units.cm
    for name in ("new", "old"):
        got = {(r["i"], r["j"]): (r["lon"], r["lat"], r["sla"]) for r in df.where(F.col("file").endswith(f"{name}.nc")).collect()}
        assert len(got) == 18 and got[2, 1][2] is None and got[5, 2][:2] == (300.0, 30.0) and got[5, 2][2] == pytest.approx(17.0)
    over = fields.read_sea_level(spark, str(tmp_path / "new.nc"), (-70.0, 70.0, -10.0, 40.0))
    assert sorted({r["lon"] for r in over.collect()}) == [-60.0, 0.0, 60.0] and {r["lat"] for r in over.collect()} == {0.0, 30.0}
    filled = {(r["i"], r["j"]): r["sla"] for r in fields.read_sea_level(spark, str(tmp_path / "*.nc"), fill=True).where("file like '%old.nc'").collect()}
    assert filled[2, 1] == pytest.approx((2 + 14) / 2)


@pytest.mark.parametrize("centre", ["linear", "parabolic", "cubic"])
def test_displaced_pole_there_and_back(spark, centre):
    from pelagia.functions.poles import DisplacedPole

    pole = DisplacedPole(centre=centre)
    grid = pole.grid(spark, 13, 17, -90.0, 89.0, -180.0, 180.0)
    lat, lon = pole.backward("lat", "lon")
    back = grid.select("grid_lat", "grid_lon", lat.alias("back_lat"), lon.alias("back_lon"))
    # the interval is halved for whole batches: steps of a lambda are interpreted, row by row
    assert "lambdafunction" not in back._jdf.queryExecution().optimizedPlan().toString()
    for r in back.collect():
        assert r["back_lat"] == pytest.approx(r["grid_lat"], abs=1e-7)
        assert (r["back_lon"] - r["grid_lon"] + 180) % 360 - 180 == pytest.approx(0, abs=1e-6)
