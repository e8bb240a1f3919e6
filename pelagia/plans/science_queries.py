"""Queries of scalar functions: sea water, waves, winds, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, physics
from ..functions.poles import DisplacedPole
from .views import nodes, query, rounded, sea, table


def _poly(coefficients: list[float], x: str) -> str:
    out = repr(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = f"({out} * {x} + {c!r})"
    return out


# The published coefficients of the 1980 equation of state, with powers of t in order; written apart from those of the functions under test.
_SURFACE = f"""({_poly([999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9], 't')} + s * ({_poly([8.24493e-1, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9], 't')})
    + s * sqrt(s) * ({_poly([-5.72466e-3, 1.0227e-4, -1.6546e-6], 't')}) + 4.8314e-4 * s * s)"""
_MODULUS = f"""({_poly([19652.21, 148.4206, -2.327105, 1.360477e-2, -5.155288e-5], 't')} + s * ({_poly([54.6746, -0.603459, 1.09987e-2, -6.1670e-5], 't')}) + s * sqrt(s) * ({_poly([7.944e-2, 1.6483e-2, -5.3009e-4], 't')})
    + (p / 10) * ({_poly([3.239908, 1.43713e-3, 1.16092e-4, -5.77905e-7], 't')} + s * ({_poly([2.2838e-3, -1.0981e-5, -1.6078e-6], 't')}) + 1.91075e-4 * s * sqrt(s))
    + (p / 10) * (p / 10) * ({_poly([8.50935e-5, -6.12293e-6, 5.2787e-8], 't')} + s * ({_poly([-9.9348e-7, 2.0816e-8, 9.1697e-10], 't')})))"""
_RHO = f"{_SURFACE} / (1 - (p / 10) / {_MODULUS})"
_X = "(p / 10)"
_SOUND = f"""{_poly([1402.388, 5.03711, -5.80852e-2, 3.3420e-4, -1.47800e-6, 3.1464e-9], 't')} + {_X} * ({_poly([0.153563, 6.8982e-4, -8.1788e-6, 1.3621e-7, -6.1185e-10], 't')})
    + pow({_X}, 2) * ({_poly([3.1260e-5, -1.7107e-6, 2.5974e-8, -2.5335e-10, 1.0405e-12], 't')}) + pow({_X}, 3) * ({_poly([-9.7729e-9, 3.8504e-10, -2.3643e-12], 't')})
    + s * ({_poly([1.389, -1.262e-2, 7.164e-5, 2.006e-6, -3.21e-8], 't')} + {_X} * ({_poly([9.4742e-5, -1.2580e-5, -6.4885e-8, 1.0507e-8, -2.0122e-10], 't')})
      + pow({_X}, 2) * ({_poly([-3.9064e-7, 9.1041e-9, -1.6002e-10, 7.988e-12], 't')}) + pow({_X}, 3) * ({_poly([1.100e-10, 6.649e-12, -3.389e-13], 't')}))
    + s * sqrt(s) * (-1.922e-2 - 4.42e-5 * t + {_X} * (7.3637e-5 + 1.7945e-7 * t)) + s * s * (1.727e-3 - 7.9836e-6 * {_X})"""
_HEAT = f"""{_poly([4217.4, -3.720283, 0.1412855, -2.654387e-3, 2.093236e-5], 't')} + s * ({_poly([-7.643575, 0.1072763, -1.38385e-3], 't')}) + s * sqrt(s) * ({_poly([0.1770383, -4.07718e-3, 5.148e-5], 't')})
    + {_X} * ({_poly([-4.9592e-1, 1.45747e-2, -3.13885e-4, 2.0357e-6, 1.7168e-8], 't')} + s * ({_poly([4.9247e-3, -1.28315e-4, 9.802e-7, 2.5941e-8, -2.9179e-10], 't')}) + s * sqrt(s) * ({_poly([-1.2331e-4, -1.517e-6, 3.122e-8], 't')}))
    + pow({_X}, 2) * ({_poly([2.4931e-4, -1.08645e-5, 2.87533e-7, -4.0027e-9, 2.2956e-11], 't')} + s * ({_poly([-2.9558e-6, 1.17054e-7, -2.3905e-9, 1.8448e-11], 't')}) + 9.971e-8 * s * sqrt(s))
    + pow({_X}, 3) * ({_poly([-5.422e-8, 2.6380e-9, -6.5637e-11, 6.136e-13], 't')} + s * ({_poly([5.540e-10, -1.7682e-11, 3.513e-13], 't')}) - 1.4300e-12 * t * s * sqrt(s))"""


@query(f"SELECT id, round({_RHO}, 5) AS density, round({_RHO} - 1000, 5) AS sigma FROM sea", "sea")
def eos80_density(spark, sf_dir):
    return rounded(sea(spark, sf_dir).select("id", physics.density("s", "t", "p").alias("density"), physics.sigma("s", "t", "p").alias("sigma")), 5, "density", "sigma")


@query(f"SELECT id, round({_SOUND}, 5) AS sound, round({_HEAT}, 4) AS heat FROM sea", "sea")
def eos80_sound_heat(spark, sf_dir):
    out = sea(spark, sf_dir).select("id", physics.sound_speed("s", "t", "p").alias("sound"), physics.heat_capacity("s", "t", "p").alias("heat"))
    return rounded(rounded(out, 5, "sound"), 4, "heat")


@query(
    """SELECT id, round((-0.0575 + 1.710523e-3 * sqrt(s) - 2.154996e-4 * s) * s - 7.53e-4 * p, 8) AS freezing,
    round((((-1.82e-15 * p + 2.279e-10) * p - 2.2512e-5) * p + 9.72659) * p / (9.780318 * (1 + (5.2788e-3 + 2.36e-5 * x) * x) + 1.092e-6 * p), 6) AS depth
    FROM (SELECT *, pow(sin(radians(t)), 2) AS x FROM sea)""",
    "sea",
)
def eos80_freezing_depth(spark, sf_dir):
    out = sea(spark, sf_dir).select("id", physics.freezing_point("s", "p").alias("freezing"), physics.depth("p", "t").alias("depth"))
    return rounded(rounded(out, 8, "freezing"), 6, "depth")


@query(f"WITH a AS (SELECT id, {_RHO.replace('t)', 't)')} AS rho, s, t, p FROM sea) SELECT id, round(1 / rho - 1 / r0, 12) AS anomaly FROM a JOIN (SELECT id, {_RHO} AS r0 FROM (SELECT id, 35.0 AS s, 0.0 AS t, p FROM sea)) USING (id)", "sea")
def eos80_volume_anomaly(spark, sf_dir):
    return rounded(sea(spark, sf_dir).select("id", physics.volume_anomaly("s", "t", "p").alias("anomaly")), 12, "anomaly")


@query("SELECT id, round(1000 * (1 - 2e-4 * (t - 10) + 7.6e-4 * (s - 35)), 6) AS density FROM sea", "sea")
def eos_linear(spark, sf_dir):
    return rounded(sea(spark, sf_dir).select("id", physics.linear_density("s", "t").alias("density")), 6, "density")


@query()
def eos80_derived(spark, sf_dir):
    """Expansion, contraction, potential temperature and a salinity round trip; tests hold the published check values."""
    out = sea(spark, sf_dir).select(
        "id", physics.thermal_expansion("s", "t", "p").alias("alpha"), physics.haline_contraction("s", "t", "p").alias("beta"), physics.potential_temperature("s", "t", "p").alias("theta"),
        physics.salinity(physics.conductivity_ratio("s", "t", "p"), "t", "p").alias("s_back"), physics.lapse_rate("s", "t", "p").alias("lapse"),
    )
    return rounded(rounded(out, 6, "theta", "s_back"), 12, "alpha", "beta", "lapse")


_WAVES = "SELECT p_partkey AS id, 0.001 + p_size / 100.0 AS k FROM part"


@query(
    f"""WITH w AS ({_WAVES}) SELECT id, round(sqrt(9.81 * k * tanh(k * 50)), 8) AS omega, round(sqrt(9.81 * k), 8) AS deep, round(k * sqrt(9.81 * 50), 8) AS shallow,
    round(sqrt((9.81 * k + 0.074 / 1000 * k ** 3) * tanh(k * 50)), 8) AS capillary, round(sqrt(9.81 * k * tanh(k * 50)) / k, 8) AS phase,
    round((9.81 * tanh(k * 50) + 9.81 * k * 50 * (1 - tanh(k * 50) ** 2)) / (2 * sqrt(9.81 * k * tanh(k * 50))), 8) AS wave_group, round(k, 8) AS k_back FROM w"""
)
def dispersion(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (0.001 + F.col("p_size") / 100.0).alias("k"))
    water, deep, shallow, capillary = physics.Waves(50.0), physics.Waves(), physics.Waves(50.0, shallow=True), physics.Waves(50.0, tension=0.074)
    out = w.select(
        "id", water.omega("k").alias("omega"), deep.omega("k").alias("deep"), shallow.omega("k").alias("shallow"), capillary.omega("k").alias("capillary"),
        water.phase_velocity("k").alias("phase"), water.group_velocity("k").alias("wave_group"), deep.k_from_omega(deep.omega("k")).alias("k_back"),
    )
    return rounded(out, 8, *[c for c in out.columns if c != "id"])


@query("SELECT id, round(2 * (2 * pi() / 86164.0905) * sin(radians(lat)), 12) AS f, round(2 * (2 * pi() / 86164.0905) / 6371008.8 * cos(radians(lat)), 18) AS beta FROM nodes", "nodes")
def coriolis(spark, sf_dir):
    out = nodes(spark, sf_dir).select("id", physics.coriolis("lat").alias("f"), physics.coriolis_beta("lat").alias("beta"))
    return rounded(rounded(out, 12, "f"), 18, "beta")


@query(
    """SELECT id, round(-1 / pi() * cos(pi() * y), 9) + 0.0 AS single, round(cos(2 * pi() * (y - 0.5)) + 2 * sin(pi() * (y - 0.5)), 9) + 0.0 AS jans, round(-cos(2 * pi() * y), 9) + 0.0 AS dijkstra FROM (SELECT id, (lat + 80) / 160 AS y FROM nodes)""",
    "nodes",
)
def gyre_winds(spark, sf_dir):
    y = F.col("lat") + 80
    return nodes(spark, sf_dir).select("id", *[(F.round(physics.gyre_wind(y, 160.0, kind), 9) + 0.0).alias(kind) for kind in ("single", "jans", "dijkstra")])


@query("SELECT id, round(0.5 * exp(-(lat * lat) / 800), 9) AS bubble FROM nodes", "nodes")
def bubble(spark, sf_dir):
    return nodes(spark, sf_dir).select("id", F.round(physics.gaussian_bubble("lat", 20.0), 9).alias("bubble"))


@query("SELECT id, round(lon * cos(0.3) - lat * sin(0.3), 8) AS u, round(lon * sin(0.3) + lat * cos(0.3), 8) AS v FROM nodes", "nodes")
def rotated_vectors(spark, sf_dir):
    u, v = geo.rotate("lon", "lat", F.lit(0.3))
    return nodes(spark, sf_dir).select("id", F.round(u, 8).alias("u"), F.round(v, 8).alias("v"))


@query("SELECT id, k, round(lat + (-lat - lat) * k / 4.0, 8) AS lat, round(lon + (0 - lon) * k / 4.0, 8) AS lon FROM (SELECT id, lat, lon, unnest([0, 1, 2, 3, 4]) AS k FROM nodes)", "nodes")
def transect_points(spark, sf_dir):
    t = nodes(spark, sf_dir).select("id", F.posexplode(geo.transect("lat", "lon", -F.col("lat"), F.lit(0.0), 4)).alias("k", "p"))
    return rounded(t.select("id", "k", "p.lat", "p.lon"), 8, "lat", "lon")


@query(
    """WITH p AS (SELECT id, radians(lat / 2) AS lat, radians(lon / 4) AS lon, k * pi() / 2 AS b, 2e5 / 6371315.0 AS d, k FROM (SELECT *, unnest([0, 1, 2, 3]) AS k FROM nodes)),
    q AS (SELECT *, asin(sin(lat) * cos(d) + cos(lat) * sin(d) * cos(b)) AS lat2 FROM p)
    SELECT id, k, round(degrees(lat2), 7) AS lat, round(degrees(lon + atan2(sin(b) * sin(d) * cos(lat), cos(d) - sin(lat) * sin(lat2))), 7) AS lon FROM q""",
    "nodes",
)
def circle_points(spark, sf_dir):
    c = nodes(spark, sf_dir).select("id", F.posexplode(geo.circle(F.col("lat") / 2, F.col("lon") / 4, 2e5, 4)).alias("k", "p"))
    return rounded(c.select("id", "k", "p.lat", "p.lon"), 7, "lat", "lon")


@query(
    """WITH s AS (SELECT id, 6371.0088 AS r, radians(lat) AS la, radians(lon) AS lo FROM nodes),
    d AS (SELECT id, r, 2 * asin(least(1, sqrt(sin(0.05) ** 2))) AS a,
      2 * asin(sqrt(sin(0.05) ** 2 + cos(la) * cos(la + 0.1) * sin(0.1) ** 2)) AS b, 2 * asin(sqrt(cos(la) * cos(la) * sin(0.1) ** 2)) AS c FROM s)
    SELECT id, round(4 * r * r * atan(sqrt(greatest(0, tan((a + b + c) / 4) * tan((b + c - a) / 4) * tan((a + c - b) / 4) * tan((a + b - c) / 4)))), 1) AS area FROM d""",
    "nodes",
)
def sphere_triangles(spark, sf_dir):
    step = 5.729577951308232
    corners = [("lat", "lon"), (F.col("lat") + step, F.col("lon")), ("lat", F.col("lon") + 2 * step)]
    return nodes(spark, sf_dir).select("id", F.round(geo.sphere_triangle_area_points(*corners), 1).alias("area"))


# The joining latitude is 10 N, the pole 75 N, 320 E; the centre moves as the square.
@query(
    """WITH p AS (SELECT id, lat, lon, tan(radians(90 - lat)) / tan(radians(80)) AS r, tan(radians(15)) / tan(radians(80)) AS a, radians(lon - 320) AS t FROM nodes),
    q AS (SELECT *, 2 * atan(tan(atan2(sin(t), cos(t)) / 2) * exp(2 * a * (r - 1 - ln(r)))) AS s FROM p WHERE lat > 10),
    z AS (SELECT *, a * (1 - r) ** 2 + r * cos(s) AS x, r * sin(s) AS y FROM q),
    f AS (SELECT id, lat, lon, 90 - degrees(atan(sqrt(x * x + y * y) * tan(radians(80)))) AS flat, degrees(atan2(y, x)) + 320 AS flon FROM z)
    SELECT id, round(flat, 6) AS lat, round(flon - 360 * floor(flon / 360), 6) AS lon, round(lat, 6) AS back_lat, round(lon - 360 * floor(lon / 360), 6) AS back_lon FROM f
    UNION ALL SELECT id, round(lat, 6), round(lon, 6), round(lat, 6), round(lon, 6) FROM nodes WHERE lat <= 10""",
    "nodes",
)
def displaced_pole_grid(spark, sf_dir):
    """Nodes on the displaced-pole grid, and back again, where they were."""
    pole = DisplacedPole()
    lat, lon = pole.forward("lat", "lon")
    out = nodes(spark, sf_dir).select("id", lat.alias("lat"), lon.alias("lon"))
    back_lat, back_lon = pole.backward("lat", "lon")
    out = rounded(out.withColumns({"back_lat": back_lat, "back_lon": back_lon}), 6, "lat", "lon", "back_lat", "back_lon")
    return out.withColumn("back_lon", F.when(F.col("back_lat") > 10, F.pmod("back_lon", F.lit(360.0))).otherwise(F.col("back_lon")))
