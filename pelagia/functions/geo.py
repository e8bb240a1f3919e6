"""Spherical and planar geometry as Column expressions; angles in degrees unless a name says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean radius of the Earth (km), and the radius (m) that eddy distances use.
EARTH_KM, EDDY_EARTH_M = 6371.0088, 6371315.0


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in units of ``radius``."""
    lat1, lon1, lat2, lon2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def sphere_triangle_area(a, b, c, radius: float = EARTH_KM) -> Column:
    """Area of a spherical triangle from the lengths of its sides (L'Huilier)."""
    a, b, c = (_c(x) / radius for x in (a, b, c))
    half = (a + b + c) / 2
    t = F.tan(half / 2) * F.tan((half - a) / 2) * F.tan((half - b) / 2) * F.tan((half - c) / 2)
    return F.lit(4 * radius**2) * F.atan(F.sqrt(F.greatest(t, F.lit(0.0))))


def sphere_triangle_area_points(p1: tuple, p2: tuple, p3: tuple, radius: float = EARTH_KM) -> Column:
    """The same from three (lat, lon) corners."""
    sides = [haversine(*p, *q, radius) for p, q in ((p1, p2), (p2, p3), (p3, p1))]
    return sphere_triangle_area(*sides, radius)


def plane_triangle_area(x1, y1, x2, y2, x3, y3) -> Column:
    """Signed area, positive for corners against the clock."""
    x1, y1, x2, y2, x3, y3 = (_c(x) for x in (x1, y1, x2, y2, x3, y3))
    return ((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2


def overlap(a1, a2, b1, b2) -> Column:
    """Length that two intervals share, 0 if none."""
    return F.greatest(F.lit(0.0), F.least(_c(a2), _c(b2)) - F.greatest(_c(a1), _c(b1)))


def wrap_360(lon) -> Column:
    """Longitude in [0, 360)."""
    return F.pmod(_c(lon), F.lit(360.0))


def wrap_180(lon) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(_c(lon) + 180.0, F.lit(360.0)) - 180.0


def wrap_near(lon, centre) -> Column:
    """Longitude within half a turn of ``centre``."""
    return _c(centre) + wrap_180(_c(lon) - _c(centre))


def azimuthal(lat, lon, lat0, lon0, radius: float = EDDY_EARTH_M) -> tuple[Column, Column]:
    """x and y of the azimuthal equidistant projection about (lat0, lon0), on a sphere."""
    lat, lon, lat0, lon0 = (F.radians(_c(x)) for x in (lat, lon, lat0, lon0))
    cos_c = F.sin(lat0) * F.sin(lat) + F.cos(lat0) * F.cos(lat) * F.cos(lon - lon0)
    c = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_c)))
    k = F.when(F.sin(c) == 0, F.lit(1.0)).otherwise(c / F.sin(c)) * radius
    return k * F.cos(lat) * F.sin(lon - lon0), k * (F.cos(lat0) * F.sin(lat) - F.sin(lat0) * F.cos(lat) * F.cos(lon - lon0))


def azimuthal_inverse(x, y, lat0, lon0, radius: float = EDDY_EARTH_M) -> tuple[Column, Column]:
    """(lat, lon) of a point of :func:`azimuthal`."""
    x, y, lat0 = _c(x), _c(y), F.radians(_c(lat0))
    rho = F.hypot(x, y)
    c = rho / radius
    arg = F.cos(c) * F.sin(lat0) + F.when(rho == 0, F.lit(0.0)).otherwise(y * F.sin(c) * F.cos(lat0) / rho)
    lon = F.atan2(x * F.sin(c), rho * F.cos(lat0) * F.cos(c) - y * F.sin(lat0) * F.sin(c))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), arg)))), _c(lon0) + F.when(rho == 0, F.lit(0.0)).otherwise(F.degrees(lon))


def mercator(lat, lon, lon0: float = 0.0, radius: float = EDDY_EARTH_M) -> tuple[Column, Column]:
    """x and y of the Mercator map used to compare nearby positions."""
    return F.radians(_c(lon) - lon0) * radius, F.log(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2)) * radius


def destination(lat, lon, distance, bearing, radius: float = EDDY_EARTH_M) -> tuple[Column, Column]:
    """(lat, lon) after ``distance`` along the great circle that starts with ``bearing``."""
    lat, lon, bearing = (F.radians(_c(x)) for x in (lat, lon, bearing))
    d = _c(distance) / radius
    lat2 = F.asin(F.sin(lat) * F.cos(d) + F.cos(lat) * F.sin(d) * F.cos(bearing))
    lon2 = lon + F.atan2(F.sin(bearing) * F.sin(d) * F.cos(lat), F.cos(d) - F.sin(lat) * F.sin(lat2))
    return F.degrees(lat2), F.degrees(lon2)


def circle(lat, lon, distance, points: int = 36) -> Column:
    """Array of ``points`` (lat, lon) structs around a centre."""

    def at(k: Column) -> Column:
        y, x = destination(lat, lon, distance, k * (360.0 / points))
        return F.struct(y.alias("lat"), x.alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def transect(lat1, lon1, lat2, lon2, steps: int) -> Column:
    """Array of ``steps`` + 1 (lat, lon) structs on the straight line between two points."""
    lat1, lon1, lat2, lon2 = (_c(x) for x in (lat1, lon1, lat2, lon2))

    def at(k: Column) -> Column:
        w = k / F.lit(float(steps))
        return F.struct((lat1 + (lat2 - lat1) * w).alias("lat"), (lon1 + (lon2 - lon1) * w).alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), at)


def rotate(u, v, angle) -> tuple[Column, Column]:
    """Vector components turned by ``angle`` radians."""
    u, v, angle = _c(u), _c(v), _c(angle)
    return u * F.cos(angle) - v * F.sin(angle), u * F.sin(angle) + v * F.cos(angle)


def inside_polygon(x, y, ring: Column) -> Column:
    """Whether a point is inside a closed ring, an array of (x, y) structs (first equal to last), by the even-odd rule."""
    x, y = _c(x), _c(y)
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        spans = (p["y"] > y) != (q["y"] > y)
        at = p["x"] + (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) * (q["x"] - p["x"])
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(edges, crosses), F.lit(0), lambda a, b: a + b) % 2 == 1
