"""Published check values, analytic cases and round trips of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from pelagia import units
from pelagia.functions import calendars, geo, physics
from pelagia.functions.poles import DisplacedPole


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


# Check values of Fofonoff & Millard (1983).
@pytest.mark.parametrize(
    "column, wanted, digits",
    [
        (lambda: physics.density(35.0, 5.0), 1027.67547, 5),
        (lambda: physics.density(35.0, 25.0, 10000.0), 1062.53817, 5),
        (lambda: physics.density(0.0, 5.0), 999.96675, 5),
        (lambda: physics.sound_speed(40.0, 40.0, 10000.0), 1731.995, 3),
        (lambda: physics.heat_capacity(40.0, 40.0, 10000.0), 3849.500, 3),
        (lambda: physics.lapse_rate(40.0, 40.0, 10000.0), 3.255976e-4, 10),
        (lambda: physics.potential_temperature(40.0, 40.0, 10000.0), 36.89073, 5),
        (lambda: physics.freezing_point(40.0, 500.0), -2.588567, 6),
        (lambda: physics.depth(10000.0, 30.0), 9712.653, 3),
        (lambda: physics.salinity(1.888091, 40.0, 10000.0), 40.0, 4),
        (lambda: physics.conductivity_ratio(40.0, 40.0, 10000.0), 1.888091, 5),
    ],
)
def test_sea_water(spark, column, wanted, digits):
    assert value(spark, column()) == pytest.approx(wanted, abs=0.6 * 10**-digits)


def test_density_slopes(spark):
    d = 1e-4
    for f, step in ((physics.density_by_t, (0, d)), (physics.density_by_s, (d, 0))):
        up = value(spark, physics.density(35 + step[0], 12 + step[1], 3000.0)) - value(spark, physics.density(35 - step[0], 12 - step[1], 3000.0))
        assert value(spark, f(35.0, 12.0, 3000.0)) == pytest.approx(up / (2 * d), rel=1e-5)


def test_waves(spark):
    for w in (physics.Waves(20.0), physics.Waves(), physics.Waves(20.0, shallow=True), physics.Waves(20.0, tension=0.074)):
        k, d = 0.3, 1e-6
        slope = (value(spark, w.omega(F.lit(k + d))) - value(spark, w.omega(F.lit(k - d)))) / (2 * d)
        assert value(spark, w.group_velocity(F.lit(k))) == pytest.approx(slope, rel=1e-6)
        assert value(spark, w.k_from_omega(w.omega(F.lit(k)))) == pytest.approx(k, rel=1e-9)


def test_octant_and_haversine(spark):
    whole = 4 * math.pi * geo.EARTH_KM**2
    assert value(spark, geo.sphere_triangle_area_points((0.0, 0.0), (0.0, 90.0), (90.0, 0.0))) == pytest.approx(whole / 8)
    assert value(spark, geo.haversine(0.0, 0.0, 0.0, 180.0, 1.0)) == pytest.approx(math.pi)
    lat, lon = geo.azimuthal_inverse(*geo.azimuthal(41.0, 12.5, 40.0, 12.0), 40.0, 12.0)
    assert (value(spark, lat), value(spark, lon)) == (pytest.approx(41.0), pytest.approx(12.5))


def test_wind_formula(spark):
    y = 0.3
    wanted = math.cos(2 * math.pi * (y - 0.5)) + 2 * math.sin(math.pi * (y - 0.5))
    assert value(spark, physics.gyre_wind(F.lit(y), 1.0)) == pytest.approx(wanted)


@pytest.mark.parametrize("centre", ["linear", "parabolic", "cubic"])
def test_displaced_pole_round_trip(spark, centre):
    pole = DisplacedPole(centre=centre)
    g = pole.grid(spark, 12, 12, 12.0, 80.0, 5.0, 365.0)
    lat, lon = pole.backward("lat", "lon")
    for r in g.withColumns({"b_lat": lat, "b_lon": lon}).collect():
        assert r["b_lat"] == pytest.approx(r["grid_lat"], abs=1e-8)
        assert math.cos(math.radians(r["b_lon"] - r["grid_lon"])) == pytest.approx(1, abs=1e-12)


def test_units(spark):
    df = spark.createDataFrame([(3.0, 2.0)], "a double, b double")
    df = units.with_unit(units.with_unit(df, "a", units.km), "b", units.hour)
    df = units.product(df, "v", "a", "b", -1)
    assert units.in_unit(df, "v", units.m / units.s).first()["v"] == pytest.approx(1500 / 3600)
    assert units.unit_of(df, "v") == units.km / units.hour
    assert units.Unit.read(str(units.Pa)) == units.Pa
    with pytest.raises(units.UnitError):
        units.total(df, "x", "a", "b")
    assert (units.km / units.m).plain
    assert units.psu.factor == pytest.approx(35.16504 / 35)


def test_calendars(spark):
    assert value(spark, calendars.calendar_360(F.lit((5 * 360 + 31) * 86400 + 3))) == "00050202"
    assert value(spark, calendars.tenths(F.lit(" 870W"))) == -87.0
    assert value(spark, calendars.tenths(F.lit("x"))) is None
    assert str(value(spark, calendars.hour_stamp(F.lit("2005082806")))) == "2005-08-28 06:00:00"
    assert value(spark, calendars.hour_stamp(F.lit("2005139906"))) is None
    assert value(spark, calendars.number_or_zero(F.lit(""))) == 0.0
    assert str(value(spark, calendars.day_stamp(F.lit("20050828")))) == "2005-08-28"
